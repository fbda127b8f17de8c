"""The corpus operators: against libraries, brute force and literals, on small tables with every awkward case."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import oracle
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrylight.llm import bpe, components, embed_dedup, hnsw, html_text, langid, licenses, minhash, packing, quality, queries, warc

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "Of the wind. " * 9000
TEXTS = [(1, None), (2, ""), (3, "Hello world, été 123!"), (4, LONG), (5, "Hello world, été 123!"), (5, "Hello world, été 123!"), (None, "null id"), (6, "<|endoftext|> x<|endoftext|>"), (7, "   \n\n  ")]


@pytest.fixture(scope="module")
def texts(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame([(i, t, "x", 1.0, 2) for i, t in TEXTS], "doc_id long, text string, id string, score double, class int")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


# BPE


def test_bpe_equals_the_library(library):
    m = bpe.model(PATH)

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.text(max_size=60), st.text(alphabet="ab", max_size=80), st.text(alphabet="thingerand \n'.", max_size=80)))
    def run(text):
        ids = library.encode(text, add_special_tokens=False).ids
        assert m.encode(text) == ids and m.decode(ids) == library.decode(ids, skip_special_tokens=False)
        assert m.ranked(text) == m.encode_packed(text)

    run()


def test_bpe_over_unicode(library):
    m = bpe.model(PATH)
    for at in range(0, 0x3000, 16):
        text = " ".join(f"a{chr(c)} {chr(c)}{chr(c)}1" for c in range(at, at + 16))
        assert m.encode(text) == library.encode(text, add_special_tokens=False).ids and m.ranked(text) == m.encode_packed(text)


def test_bpe_long_words(library):
    m = bpe.model(PATH)
    for text in ("a" * 20000, " " * 20000, "ab" * 10000):
        assert m.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_operators(spark, texts, nothing, library):
    got = sorted(map(tuple, bpe.round_trip(texts, PATH).collect()), key=repr)
    want = []
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    back = bpe.decode(bpe.encode(texts, PATH), PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(((i, t or "") for i, t in TEXTS), key=repr)
    assert bpe.round_trip(nothing, PATH).count() == 0


# Language ID


def test_languages_on_held_out_rows(spark):
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.col("lang").alias("said"))
    held = got.join(docs, "doc_id").where("held_out")
    assert held.where("lang_pred = said").count() >= 0.97 * held.count()
    assert got.where("rejected").count() <= 0.01 * got.count()
    rows = got.select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_languages_of_awkward_rows(spark, texts, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = langid.fit(docs)
    got = {(r.doc_id, r.lang_pred, r.rejected) for r in langid.identify(texts, m).collect() if r.lang_pred == "und"}
    assert got == {(1, "und", True), (2, "und", True), (7, "und", True)}
    assert all(0 <= r.score <= 1 for r in langid.identify(texts, m).collect())
    assert langid.identify(nothing, m).count() == 0
    assert {r.lang_pred for r in langid.identify(texts, langid.fit(nothing)).collect()} == {"und"}
    assert langid.keep_identified(nothing, m).columns == nothing.columns
    some = spark.createDataFrame([("en", "The wind. " * 50, 1), (None, "x y", 2), ("fr", None, 3)], "lang string, text string, doc_id long")
    assert list(langid.fit(some).dictionaries) == ["en"]


def test_languages_equal_compression_written_out():
    """Totals over all chunks with each dictionary, by the library alone."""
    import zstandard

    r = random.Random(2)
    words = {"aa": ["wind", "solar", "turbine", "the", "of"], "bb": ["viento", "energia", "el", "de", "la"], "cc": ["vent", "soleil", "le", "du", "des"]}
    m = langid.LanguageModel({k: " ".join(r.choice(w) for _ in range(800)).encode() for k, w in words.items()}, chunk=256)
    for _ in range(40):
        text = " ".join(r.choice(words[r.choice("aa aa aa bb cc".split())]) for _ in range(r.randrange(20, 200)))
        data = langid.folded(text)
        size = {}
        for k, d in m.dictionaries.items():
            p = zstandard.ZstdCompressionParameters.from_level(m.level, write_content_size=0, write_checksum=0, write_dict_id=0)
            size[k] = sum(len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p).compress(data[i : i + 256])) for i in range(0, len(data), 256))
        first, second = sorted(size.values())[:2]
        if first < second:
            lang, score, rejected = m.predict(text)
            assert size[lang] == first and score == min(1.0, (second - first) / first) and rejected == (score < m.narrow)


def test_language_sample_is_bounded_and_from_everywhere(spark):
    long = " ".join(f"word{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(2000))
    rows = [(i, long[i * 100 :], "en") for i in range(30)] + [(100 + i, "un mot", f"x{i:03d}") for i in range(40)] + [(1, "", "en"), (None, "some text", "en")]
    m = langid.fit(spark.createDataFrame(rows, "doc_id int, text string, lang string"), dict_bytes=3000, pieces=50, piece=200, languages=5)
    assert sorted(m.dictionaries) == ["en", "x000", "x001", "x002", "x003"] and 2000 < len(m.dictionaries["en"]) <= 3000
    at = sorted(long.find(p) for p in m.dictionaries["en"].decode().replace("  ", "\n").strip().split("\n") if p in long)
    assert at[-1] > len(long) / 2  # not only what stands first


def test_language_fit_on_one_id(spark):
    """Many texts under one id are drawn like any others, copies count once, and what comes to the driver is bounded."""
    base = spark.range(6000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("the words of text "), F.md5(F.col("id").cast("string"))).alias("text"), F.lit("en").alias("lang"))
    other = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("immer dieselben Worte").alias("text"), F.lit("de").alias("lang"))
    m = langid.fit(base.union(other), pieces=100)
    assert set(m.dictionaries) == {"en", "de"} and m.dictionaries["en"].count(b"the words") == 100 and m.dictionaries["de"].count(b"immer") == 1
    assert m.predict("the words of text")[0] == "en"
    assert langid.fit(base.repartition(7).union(other), pieces=100).dictionaries == m.dictionaries


# HTML

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{x}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>
<div class="ad">Buy</div><!-- no <p>x</p> --><article><h1>Head &amp; line</h1><p><b>One  two<br>three<p>Fish&nbsp;&lt;b&gt; caf&eacute;</p><div class="related">More</div><p>End</article>
<section id="comments"><p>First!</p></section><aside>Side</aside><form>Mail</form><footer>&copy; x</footer></body></html>"""


def test_html_article():
    assert html_text.extract(PAGE) == "Head & line\nOne two three\nFish <b> café\nEnd"


def test_html_without_article():
    body = "<p>" + "A sentence of the text that goes on. " * 5 + "</p>"
    page = f"<body><div id=nav><a href=a>Home</a></div><div>Tiny</div><div class='cookie-notice'>We use cookies on this page, which is long enough to be a text of its own, and so on and on.</div><div>{body}<h2>Mid</h2>{body}</div><div class=footer>Imprint</div>"
    text = html_text.extract(page)
    assert "A sentence" in text and "Mid" in text and not re.search("Home|cookies|Imprint", text)


def naive_spans(lengths, threshold, window, running):
    """Line by line: i is in a range if a surge comes before the next dive and text stands on both sides."""
    n = len(lengths)
    sums = [sum(lengths[i : i + window]) for i in range(n)]
    in_range, on = [False] * n, False
    for i in range(n):
        on = on and sums[i] > 0 or sums[i] >= max(1, threshold)
        in_range[i] = on
    found = []
    for i in range(n):
        if in_range[i] and (not i or not in_range[i - 1]):
            end = next((k for k in range(i, n) if not in_range[k]), n)
            first = min(k for k in range(i, n) if lengths[k])
            last = max(k for k in range(first, min(n, end + 1)) if lengths[k])
            while running[first - 1 : first] == [True] and lengths[first - 1] and (not found or first > found[-1][1]):
                first -= 1
            found.append((first, last + 1))
    return found


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 0, 0, 1, 5, 30, 90]), st.booleans()), max_size=24), st.sampled_from([1, 20, 80]), st.integers(1, 4))
def test_spans_equal_the_naive_ones(rows, threshold, window):
    lengths, running = [r[0] for r in rows], [r[1] for r in rows]
    assert html_text.spans(lengths, threshold, window, running) == naive_spans(lengths, threshold, window, running)


TEXT = "A sentence of the text that goes on and on, as it does."


def test_html_windows_decide():
    """Without an article: short lines between long ones stay, as does a link between them; menus of links and far short lines go."""
    menu = "".join(f"<li><a href=x>Entry {i}</a></li>" for i in range(6))
    page = f"<body><div>Contact us</div><ul>{menu}</ul><h2>Head</h2><p>Short.</p><p>{TEXT}</p><div><a href=x>One link</a></div><p>{TEXT}</p><p>So.</p><p>{TEXT}</p><ul>{menu}</ul><div>Imprint</div></body>"
    want = ["Head", "Short.", TEXT, "One link", TEXT, "So.", TEXT]
    assert html_text.extract(page).split("\n") == want
    nonzero = [x.text for x in html_text.lines(page) if x.length and not x.off]
    assert nonzero != want and "Imprint" in nonzero and "One link" not in nonzero
    assert html_text.extract(page, window=1).split("\n") != want
    # and in an article: a run of links is a menu, one link is not
    page = f"<article><ul>{menu}</ul><h1>Head</h1><p>a</p><div><a href=x>One link</a></div><p>b</p><ul>{menu}</ul></article>"
    assert html_text.extract(page).split("\n") == ["Head", "a", "One link", "b"]


LINKS = "".join(f"<li><a href=x>Source {i}</a></li>" for i in range(4))
SOURCES = "\n".join(f"Source {i}" for i in range(4))


@pytest.mark.parametrize("page, want", [
    ("<html><head><title>T</title><body><article><p>Real text</p></article>", "Real text"),
    ("<html><head><title>T</title><meta x=y><link rel=z><p>Real text", "Real text"),
    ("<head><title>T</title>Bare text<p>More</p>", "Bare text\nMore"),
    ("<body><nav><a href=x>Menu</a><article><p>Body</p></article><nav><a href=x>More</a></nav>", "Body"),
    ("<body><form><input name=q><article><p>Body</p></article>", "Body"),
    ("<body><form id=all><article><p>Body</p></article></form>", "Body"),
    ("<main><p>Body</p></main><aside><article><p>Teaser</p></article></aside>", "Body"),
    ("<article><p>Body</p></article><section id=comments><article class=comment><p>Reader says hi</p></article></section>", "Body"),
    ("<article><p>Body</p><article class='user-comment'><p>Reader</p></article></article>", "Body"),
    ("<article><p>Body</p></article><section class=related><article><p>Teaser</p></article></section>", "Body"),
    ("<div class='comments-layout'><article><p>Only one</p></article></div>", "Only one"),
    *[(f"<article><p>Body</p><div class={name}><p>Not this</p></div><p>End</p></article>", "Body\nEnd") for name in ("google-ads", "story-ad", "related-articles", "user-comments", "reader-comments")],
    ("<article><p>Body</p><pre><code><span class='token comment'># why</span> x = 1</code></pre></article>", "Body\n# why x = 1"),
    (f"<article><p>Body</p><ul>{LINKS}</ul><p>End</p></article>", f"Body\n{SOURCES}\nEnd"),
    (f"<body><div>Paris, 3 May</div><div>By A. Writer</div><p>{'A long first block of the text. ' * 5}</p>", f"Paris, 3 May\nBy A. Writer\n{('A long first block of the text. ' * 5).strip()}"),
])
def test_html_of_ordinary_pages(page, want):
    assert html_text.extract(page) == want


def test_html_keeps_what_is_shown():
    long = " ".join([TEXT] * 12)
    for page, want in [
        ("<article><p>Einstein: <math><mi>E</mi>=<mi>mc</mi></math> holds</p></article>", "Einstein: E=mc holds"),
        ("<article><p>a</p><object data=x>no player<p>b</p><p>c</p></article>", "a\nno player\nb\nc"),
        ("<article><script>x<p>b</p><select><p>c</p></article>", "b\nc"),
        ("<article><noscript><p>Turn it on</p></noscript><select><option>One</select><p>c</p></article>", "c"),
        ("<article><div class='article-header'><h1>Head</h1></div><div class='post-header'><p>By me</p></div><p class='share-price'>Up</p></article>", "Head\nBy me\nUp"),
        ("<article><div class='elementor-widget-container'><p>b</p></div><div class='related-posts'><p>r</p></div><div class='ad-slot'>Buy</div><div id=comments><p>c</p></div></article>", "b"),
        (f"<div class='widget'><p>{long}</p></div><div class='widget'>Weather</div>", long),
        (f"<div class='comments'><p>{long}</p></div><p>{TEXT} {TEXT}</p>", f"{TEXT} {TEXT}"),
    ]:
        assert html_text.extract(page) == want


@pytest.mark.parametrize("piece", ["<div>x", "<div>", "<span>x", "<i><div><span></i>", "x</p>", "<title>", "<select>x", "<b>x</i>", "<div class=widget>x", "<!--", "<a b='"])
def test_html_is_linear(piece):
    import time

    began = time.time()
    html_text.extract("<i><div>" + "<span>" * 1000 + piece * 100_000)
    assert time.time() - began < 20


def test_html_layout_classes_are_no_sidebars():
    text = "A sentence of the text that goes on. " * 5
    assert html_text.extract(f'<div class="content has-sidebar"><p>{text}</p></div><div class="left-sidebar"><p>{text}</p></div>') == text.strip()


def test_html_awkward(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain &amp; simple"), (4, "u", "<article><p>cut &am"), (5, "u", "<article><p>cut</p><p cl"), (6, "u", "<script>x"), (None, "u", "<p>a</p><p>a</p>"), (6, "u", "<script>x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.text, r.n_chars) for r in html_text.main_text(df).collect()}
    assert got == {(1, "", 0), (2, "", 0), (3, "plain & simple", 14), (4, "cut &am", 7), (5, "cut", 3), (6, "", 0), (None, "a\na", 3)}
    assert html_text.main_text(df).count() == 8 and html_text.main_text(df.limit(0)).count() == 0


def test_html_keeps_the_documents(spark):
    """Pages of the table are made from documents: their article is the document."""
    docs = {r.doc_id: " ".join(r.text.split()) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    seen = same = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        m = re.search(r"/(\d+)(?:[?#].*)?$", r.url)
        text = html_text.extract(r.html)
        if m and int(m[1]) in docs and text.startswith(docs[int(m[1])][:20]):
            seen += 1
            same += " ".join(text.split("\n", 1)[1].split()) == docs[int(m[1])]
    assert seen > 50 and same >= 0.95 * seen


def test_html_windows_find_the_article(spark):
    """The given pages without the marks of article and footer, and with the menu repeated in between: the windows alone drop the imprint, which has a length as the text has, wherever it is shorter than a surge."""
    same = plain = n = short = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        menu = re.search(r"<ul>.*?</ul>", r.html)[0]
        page = re.sub(r"<(/?)(?:article|footer)>", r"<\1div>", r.html.replace("</article>", "</article>" + menu))
        n += 1
        short += html_text.lines(page)[-1].length < html_text.SURGE
        same += html_text.extract(page) == html_text.extract(r.html)
        plain += "\n".join(x.text for x in html_text.lines(page) if x.length and not x.off) == html_text.extract(r.html)
    assert plain == 0 and n / 4 < short <= same, (plain, short, same, n)


# Quality


def test_quality_on_held_out_rows(spark):
    got = queries.op4_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.97


def test_quality_awkward(spark, texts, nothing):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (None, 0), (5, None)], "doc_id long, quality int")
    m = quality.fit(texts, labels)
    s = quality.score(texts, m).collect()
    assert len(s) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in s)
    assert all(r.score == 0.5 for r in quality.score(texts, quality.fit(texts, labels.limit(0))).collect())
    assert quality.score(nothing, m).count() == 0 and quality.keep_good(nothing, m).columns == nothing.columns


def naive_score(m, text):
    """The network written out: every chunk, position and filter on its own."""
    data = text.encode()
    x = list(data) + [0] * (quality.CHUNK - len(data))
    seen = [any(p >= lag and p + quality.RUN <= len(data) and data[p : p + quality.RUN] == data[p - lag : p - lag + quality.RUN] for lag in quality.LAGS) for p in range(len(x))]
    sym = [b + 256 * s for b, s in zip(x, seen)]
    starts = [*range(0, len(x) - quality.CHUNK, quality.CHUNK - quality.OVERLAP), len(x) - quality.CHUNK]
    h = []
    for at in starts:
        places = range(at, at + quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)
        h.append([max(0.0, max(sum(float(m.embedding[sym[p + w]][d]) * float(m.filters[w * quality.DIM + d][f]) for w in range(quality.WIDTH) for d in range(quality.DIM)) + float(m.filter_bias[f]) for p in places)) for f in range(quality.FILTERS)])
    pooled = [max(c) for c in zip(*h)] + [sum(c) / len(h) for c in zip(*h)]
    return 1 / (1 + math.exp(-sum(w * v for w, v in zip(m.weights.tolist(), pooled)) - m.bias))


def test_scores_equal_the_network_written_out(monkeypatch):
    m = quality.initial(3)
    m.weights, m.bias = np.random.default_rng(4).normal(0, 0.3, 2 * quality.FILTERS), 0.1
    texts = ["", "short é", "abc abc abc abc abc abc abc! " * 3 + "é" * 300, "word " * 100 + "q" * 13]
    want = [naive_score(m, t) for t in texts]
    assert np.allclose(m.score_all(texts), want, atol=1e-5)
    monkeypatch.setattr(quality, "LONG", 0)
    assert np.allclose(m.score_all(texts), want, atol=1e-5)
    again = quality.QualityModel.unpacked(m.packed())
    assert np.array_equal(again.score_all(texts), m.score_all(texts))


def test_blocks_of_a_long_text_are_its_chunks():
    data = ("one and two and two and two " * 500 + "".join(random.Random(1).choices("abcdef ", k=20_000))).encode()
    whole, starts = quality.symbols(data), quality._starts(len(data))
    got = np.concatenate(list(quality.chunk_blocks(data, 7)))
    assert np.array_equal(got, whole[starts[:, None] + np.arange(quality.CHUNK)])


def test_quality_sample_is_bounded(spark):
    """One id of 50,000 rows counts once, and what goes to training is bounded by rows and by bytes."""
    many = spark.range(50_000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("good text "), F.col("id").cast("string")).alias("text"))
    rest = spark.createDataFrame([(i, "### !!! " * (5 if i < 40 else 20_000)) for i in range(2, 60)], "doc_id int, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1)] + [(i, 0) for i in range(3, 60)], "doc_id int, quality int")
    m = quality.fit(many.union(rest), labels, sample_rows=10)
    assert 0 <= m.score_all(["good text 5"])[0] <= 1
    assert quality.fit(many.union(rest), labels, sample_bytes=0).score_all(["x"])[0] == 0.5


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 900, 960, 961, 5000])
def test_chunks_cover_the_text(n):
    data = random.Random(n).randbytes(n).replace(b"\0", b"\1")
    got = quality.chunks(data) % 256
    starts = [next(k for k in range(max(1, n - 511)) if bytes(c.astype(np.uint8)) == data[k : k + 512]) for c in got] if n >= 512 else [0]
    assert n < 512 or sorted({k + j for k in starts for j in range(512)}) == list(range(n))


def test_training_follows_the_gradient():
    texts, labels = ["abc def " * 20, "### !!! " * 20] * 20, [1, 0] * 20
    s = quality.train(texts, labels, epochs=6).score_all(texts)
    assert s[0] > 0.7 and s[1] < 0.3


# WARC


def test_warc_round_trip(spark):
    big = "é" * 200_000
    rows = [(3, "http://a b", big), (1, None, big), (1, None, big), (2, "u", None), (4, "u", "short"), (5, "u", "short"), (None, "u", "q" * 200), (7, "u", "q" * 200), (8, "u", "a\r\n\r\nb" * 50)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, payload string, record_id int").repartition(3)
    manifest, folder = warc.archive(df)
    got = sorted(((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_records(manifest, folder).collect()), key=repr)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(None if i is None else str(i), "revisit" if i == 3 else "response", "1" if i == 3 else None, len((h or "").encode()), sha(h)) for i, _, h in rows]
    assert got == sorted(want, key=repr)
    chunks = warc.read_chunks(manifest, folder).orderBy("record_id", "chunk_no").collect()
    whole = collections.defaultdict(bytes)
    for c in chunks:
        if c.record_id == "8":
            whole["8"] += bytes(c.data)
            assert c.bytes_so_far == len(whole["8"]) and c.sha256_so_far == hashlib.sha256(whole["8"]).hexdigest()
    assert whole["8"] == ("a\r\n\r\nb" * 50).encode() and max(len(c.data) for c in chunks) <= warc.CHUNK
    assert warc.read_records(*warc.archive(df.limit(0))).count() == 0


@pytest.mark.parametrize("most", [100, 0])
def test_warc_records_by_broadcast_and_by_join(spark, most):
    rows = [(i, "u", f"payload {i % 7} " * 20) for i in range(40)] + [(None, "u", "payload 1 " * 20), (3, "v", "payload 3 " * 20), (50, "u", "x"), (51, "u", "x")]
    got = warc.plan_records(spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, first long, last long"), broadcast_rows=most).collect()
    want = [(None if i is None else str(i), "revisit" if i is not None and 7 <= i < 40 else "response", str(i % 7) if i is not None and 7 <= i < 40 else None) for i, _, _ in rows]
    assert sorted(((r.record_id, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert all((len(r.payload) == 0) == (r.record_type == "revisit") for r in got)


def test_chunked_is_bounded(spark):
    df = spark.createDataFrame([("a", bytearray(200_001)), ("b", bytearray())], "record_id string, payload binary")
    assert [(r.record_id, r.chunk_no, len(r.data)) for r in warc.chunked(df).orderBy("record_id", "chunk_no").collect()] == [("a", 0, 65536), ("a", 1, 65536), ("a", 2, 65536), ("a", 3, 200_001 - 3 * 65536), ("b", 0, 0)]


# Components


@pytest.mark.parametrize("least", [256, 3])
def test_components_equal_union_find(spark, monkeypatch, least):
    monkeypatch.setattr(components, "LEAST_SPLIT", least)
    monkeypatch.setattr(components, "HUB_SHARE", 256 if least > 3 else 20)
    r = random.Random(3)
    for edges in ([(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(0, i) for i in range(50)] + [(i, i + 1) for i in range(400, 460)], [], [(1, 1), (None, 2)]):
        up = {}

        def find(x):
            up.setdefault(x, x)
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            if a is not None and b is not None and a != b:
                a, b = find(a), find(b)
                up[max(a, b)] = min(a, b)
        got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for x in up}


# Embeddings


def vectors(n=400, seed=1):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, 16))
    near = base[:60] + r.normal(scale=0.09, size=(60, 16))
    x = np.concatenate([base, near, base[:40], np.repeat(base[:1], 30, 0)]).astype(np.float32)
    return [(int(i), [float(v) for v in row], int(i % 2 if i < n else (i - n) % 2 if i < n + 60 else 0)) for i, row in enumerate(x)]


AWKWARD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [None] * 16, 1), (9005, [float("inf")] + [1.0] * 15, 1), (9006, [1.0] * 16, None), (9007, [], 1), (9008, [1.0, 2.0], 1)]


def test_embedding_links_equal_brute_force(spark):
    rows = vectors() + AWKWARD
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, cls string, n int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df, block=16).collect()}
    n, up = collections.Counter(), {r[0]: r[0] for r in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    x = {i: np.array(v, np.float64) for i, v, _ in vectors()}
    lab = {i: k for i, _, k in rows}
    for a in x:
        for b in x:
            if a < b and lab[a] == lab[b] and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.93:
                n[a] += 1
                n[b] += 1
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    assert got == {i: (n[i], find(i), find(i) == i) for i in up}
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0
    twice = embed_dedup.near_duplicates(df.where("vec_id = 5").union(df.where("vec_id = 5"))).collect()
    assert [(r.n_links, r.component_id) for r in twice] == [(1, 5), (1, 5)]


def test_embedding_groups_of_thousands_of_links(spark):
    """A group of 1,200 different vectors that are nearly all linked, a looser one and a hot copy: every link counts once, whatever blocks and tables show it."""
    r = np.random.default_rng(8)
    tight, loose = (r.normal(size=(1, 24)) + r.normal(scale=s, size=(n, 24)) for s, n in ((0.12, 1200), (0.35, 400)))
    x = np.concatenate([tight, loose, np.repeat(tight[:1], 300, 0), r.normal(size=(200, 24))])
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(6)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.93
    np.fill_diagonal(link, False)
    got = {v.vec_id: (v.n_links, v.component_id) for v in embed_dedup.near_duplicates(df, block=128).collect()}
    root = embed_dedup._local_roots(len(x), *np.nonzero(link))
    want = {i: (int(link[i].sum()), int(root[i])) for i in range(len(x))}
    missed = sum(n for n, _ in want.values()) - sum(n for n, _ in got.values())
    assert link.sum() > 500_000 and 0 <= missed <= 0.001 * link.sum()
    assert all(0 <= want[i][0] - got[i][0] <= 0.02 * want[i][0] + 1 for i in want) and {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}


def test_hnsw_against_brute_force(spark):
    rows = vectors(900, 2) + AWKWARD
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, rank int")
    got = collections.defaultdict(list)
    for r in hnsw.nearest(df, F.col("vec_id") % 20 == 0, shard=300).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = {i: np.array(v, np.float64) for i, v, _ in vectors(900, 2)}
    hit = total = 0
    for q in [i for i in x if i % 20 == 0]:
        want = sorted((math.sqrt(((x[i] - x[q]) ** 2).sum()), i) for i in x if i != q)[:10]
        assert len(got[q]) == 10 and got[q] == sorted(got[q], key=lambda p: (p[1], p[0]))
        assert all(abs(s - math.sqrt(((x[i] - x[q]) ** 2).sum())) < 1e-12 for i, s in got[q])
        hit += len({i for i, _ in got[q]} & {i for _, i in want})
        total += 10
    assert hit >= 0.9 * total and 9008 not in got
    assert got[0][:3] == [(960, 0.0), (1000, 0.0), (1001, 0.0)]  # copies first, smaller ids first
    few = hnsw.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert len(few) == 3 and hnsw.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_keys_grow_with_the_labels():
    assert embed_dedup.layout(5000) == (10, 24) and embed_dedup.layout(0)[0] == 10
    for n in (10**6, 10**8, 10**11):
        bits, tables = embed_dedup.layout(n)
        assert (n >> bits <= 64 or bits == 24) and (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** tables <= 0.0004


@pytest.mark.parametrize("shard", [4096, 40, 7])
def test_ties_go_to_the_smaller_ids(spark, shard):
    """More vectors tie than a search returns, in one shard and in several; among them copies, which are one node."""
    r = np.random.default_rng(5)
    far = [[0.5 * (j == i // 2) * (-1) ** i for j in range(100)] for i in r.permutation(200).tolist()]  # all at distance 0.5 of the origin's neighbour
    rows = [(0, [0.0] * 99 + [0.0, 3.0])] + [(i + 1, v + [3.0]) for i, v in enumerate(far)] + [(500 + i, far[i] + [3.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hnsw.nearest(df, F.col("vec_id") == 0, shard=shard).orderBy("rank").collect()
    assert [(x.vec_id, x.score) for x in got] == [(i, 0.5) for i in range(1, 11)]


def test_ties_of_copies_and_text_ids(spark):
    rows = [(f"k{i:02d}", [1.0, float(i % 3), 0.0]) for i in range(60)]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id string, embedding array<double>"), F.col("vec_id") == "k05", k=3).orderBy("rank").collect()
    assert [(x.vec_id, x.score) for x in got] == [("k02", 0.0), ("k08", 0.0), ("k11", 0.0)]


# Licenses


def test_license_phrases_and_diagonals(spark):
    mit = dict((k, t) for k, t in licenses.TEMPLATES if k == "mit" and len(t) > 60)["mit"]
    edited = mit.replace("any person", "any one person").replace("free of charge, ", "")
    rows = [(1, None), (2, "Released under the MIT\n License! under the mit license"), (3, "a b"), (None, "cc by-nc"), (4, "x " * 50 + edited), (5, "under theK mit license"), (6, "Permission to go"), (6, "Permission to go"), (7, LONG)]
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan(spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, labels string")).collect()), key=repr)
    n4 = 50 + len(licenses.template_words(edited))
    want = [(1, 0, 0, None, None, "", ""), (2, 9, 2, 1, 5, "mit", "mit"), (3, 2, 0, None, None, "", ""), (None, 3, 1, 0, 0, "cc-by-nc", "cc-by-nc"), (4, n4, 0, None, None, "", "mit"), (5, 4, 0, None, None, "", ""), (6, 3, 0, None, None, "", ""), (6, 3, 0, None, None, "", ""), (7, 27000, 0, None, None, "", "")]
    assert got == sorted(want, key=repr)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_notices_with_repeated_parts(spark):
    gpl, tail = "This work is licensed under the GNU General Public License, version 3.", " GNU General Public License, version 3."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    edited = gpl.replace("the GNU", "the free GNU")
    rows = [(1, gpl + tail * 2), (2, mpl + " Mozilla Public License, v. 2.0." * 2), (3, tail * 5), (4, gpl + tail * 5000), (5, edited + tail * 3), (6, gpl), (7, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.spans) for r in licenses.scan(d).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "gpl-3", 2: "mpl-2", 3: "", 4: "gpl-3", 5: "gpl-3", 6: "gpl-3", 7: ""}
    assert [tuple(x) for x in got[1][1]] == [("gpl-3", 0, 11, 1.0)] and [tuple(x) for x in got[6][1]] == [("gpl-3", 0, 11, 1.0)]
    c = duckdb.connect()
    c.register("documents", d.toPandas())
    want = c.execute(queries.oracle_sql()["op7_licenses"]).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in licenses.scan(d).drop("spans").collect())


def test_license_plan_stays_in_the_jvm(spark, capsys):
    licenses.scan(spark.read.parquet(f"{SF}/documents.parquet")).explain("formatted")
    plan = capsys.readouterr().out
    assert not re.search("Python|Arrow|Pandas", plan) and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


# Near-duplicates


def test_prob_minhash_estimates_probability_jaccard():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 300, dtype=np.uint64)
    other = base.copy()
    other[:60] = r.integers(0, 2**63, 60, dtype=np.uint64)
    items = [(np.sort(base), np.ones(300, np.int32)), (np.sort(other), np.ones(300, np.int32)), (np.sort(base), r.integers(1, 9, 300).astype(np.int32))]
    sig = minhash.prob_minhash(items, 4096)
    for k in (1, 2):
        true = minhash.probability_jaccard(items[0][0], minhash.weight(items[0][1]), items[k][0], minhash.weight(items[k][1]))
        assert abs((sig[0] == sig[k]).mean() - true) < 0.03


def test_probability_jaccard_is_the_double_sum():
    r = np.random.default_rng(1)
    for _ in range(30):
        a, b = (np.unique(r.integers(0, 40, 25).astype(np.uint64)) for _ in "ab")
        aw, bw = (r.integers(1, 5, len(x)).astype(float) for x in (a, b))
        x, y = dict(zip(a.tolist(), aw)), dict(zip(b.tolist(), bw))
        want = sum(1 / sum(max(x.get(z, 0) / x[k], y.get(z, 0) / y[k]) for z in x.keys() | y.keys()) for k in x.keys() & y.keys())
        assert math.isclose(minhash.probability_jaccard(a, aw, b, bw), want)


def brute_classes(rows):
    number = minhash.Words()
    w = [(i, minhash.shingles(number.all(minhash.words(t)))) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(w):
        for j, b in w[:k]:
            if len(a[0]) and len(b[0]) and len(a[0]) * 0.4 < len(b[0]) < len(a[0]) * 2.6 and minhash.similarity_of(*a, *b) >= 0.8:
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i in up}


def copies(seed=4, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(80))) for i in range(20)]
    base = rows[0][1].split()
    for k in range(n):  # a chain of near copies, more than a bucket lists
        own = base[:]
        for _ in range(r.randrange(3)):
            own[r.randrange(len(own))] = r.choice(vocab)
        rows.append((100 + k, " ".join(own)))
        if k % 10 == 9:
            base = own
    return rows


def groups_apart(seed=9):
    """Texts of 700 common words and 140 of their own, so that all meet in buckets and none is linked with all; some are copies of each other."""
    r = random.Random(seed)
    shared = [f"c{i}" for i in range(700)]
    out = []
    for k in range(40):
        own = shared + [f"o{k}x{i}" for i in range(70 + 3 * k)]
        out.append((k, " ".join(own)))
        if k % 5 == 0:
            own[r.randrange(700)] = "changed"
            out.append((100 + k, " ".join(own)))
    return out


@pytest.mark.parametrize(("likely", "dense"), [(4, 32 << 20), (0, 32 << 20), (0, 4000)])
def test_classes_equal_brute_force(spark, monkeypatch, likely, dense):
    """By candidates, by dense blocks of a count, and by dense blocks of a size."""
    for name, value in {"BLOCK": 16, "PIECE": 8, "LIKELY": likely, "DENSE_BYTES": dense}.items():
        monkeypatch.setattr(minhash, name, value)
    rows = copies() + copies(5, 40)[20:] + [(1000 + i, t) for i, t in groups_apart()]
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    got = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_classes_of_awkward_rows(spark, texts, nothing):
    got = sorted(map(tuple, minhash.classes(texts).collect()), key=repr)
    assert got == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 3, False), (5, 3, False), (None, None, True), (6, 6, True), (7, 7, True)], key=repr)
    assert minhash.classes(nothing).count() == 0
    kept = minhash.keep_first(texts)
    assert kept.columns == texts.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 6, 7, None], key=repr)
    line = "is it on the line of here "
    far = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta " + line * 300), (2, "uno due tre quattro cinque sei sette otto " + line * 300)], "doc_id long, text string")
    assert {r.class_id for r in minhash.classes(far).collect()} == {1, 2}  # a line that both repeat makes no copies of them


def test_columns_that_clash_with_helpers(spark):
    names = "__kept_id__ __nth_copy__ rep k1 k2 id class sig flat nth".split()
    df = spark.createDataFrame([(i, "a b c d e f", *(100 * i + j for j in range(len(names)))) for i in (1, 2)], ", ".join(["doc_id long", "text string", *(f"{n} long" for n in names)]))
    assert [tuple(r) for r in minhash.keep_first(df).collect()] == [(1, "a b c d e f", *(100 + j for j in range(len(names))))]
    assert sorted(map(tuple, minhash.classes(df).collect())) == [(1, 1, True), (2, 1, False)]


def test_rows_are_kept_by_id_and_text(spark):
    t, other = "the words of a text that several rows have", "and one that no other row has at all"
    rows = [(1, t), (5, t), (5, other), (5, other + "!"), (5, other), (None, t), (None, t), (None, None), (None, ""), (7, None), (7, None)]
    got = sorted(map(tuple, minhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert [r for r in got if r[0] in (1, 7)] == [(1, t), (7, None)] and [r[1].rstrip("!") for r in got if r[0] == 5] == [other]
    assert sorted((r for r in got if r[0] is None), key=repr) == sorted([(None, t), (None, None), (None, "")], key=repr)
    said = {(r.doc_id, r.class_id, r.kept) for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert said == {(1, 1, True), (5, 1, False), (5, 5, True), (None, None, True), (7, 7, True)}


def repeated_line_pair(k):
    """Two texts of 600 common words and a line of 60 own ones that repeats 100 times: plain similarity over 0.8, weighted one under 0.5."""
    shared = " ".join(f"s{k}x{i}" for i in range(600))
    return [shared + 100 * (" " + " ".join(f"{own}{k}x{i}" for i in range(60))) for own in "ab"]


def test_copies_with_different_repeated_lines(spark):
    rows = [(2 * k + n, t) for k in range(8) for n, t in enumerate(repeated_line_pair(k))]
    assert {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {i: i - i % 2 for i, _ in rows} == brute_classes(rows)


def test_passages_repeated_in_one_of_two(spark):
    """Plain similarity 0.97, weighted one 0.5: all are found."""
    rows = []
    for k in range(80):
        text = " ".join(f"p{k}x{i}" for i in range(1000))
        passage = " ".join(f"p{k}x{i}" for i in range(200, 230))
        rows += [(2 * k, text), (2 * k + 1, text + 400 * (" " + passage))]
    assert {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {i: i - i % 2 for i, _ in rows}


def test_blocks_compare_both_sketches():
    import pandas as pd
    import pyarrow as pa

    texts = repeated_line_pair(0)
    b = next(minhash._sketch_batches([pa.RecordBatch.from_pydict({"id": [0, 1], "text": texts})], 120, 5)).to_pydict()
    number = minhash.Words()
    s = [minhash.shingles(number.all(minhash.words(t))) for t in texts]
    pdf = pd.DataFrame({"band": 0, "key": 0, "block": 0, "class": b["class"], "comp": b["class"], "sig": b["sig"], "flat": b["flat"], "items": [x.astype("<u8").tobytes() for x, _ in s], "counts": [n.astype("<i4").tobytes() for _, n in s]})
    assert len(minhash._block_links(pdf, 24, 5, 0.8)) == 1
    assert minhash._candidates(pdf, 24, 5, 0.8) == [(*sorted(b["class"]), None, None)]


# Packing


def check_packed(rows, library, texts, capacity):
    ids = {}
    by_seq = collections.defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        ids.setdefault(r.doc_id, []).append(r)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for i, t in texts:
        want = library.encode(t or "", add_special_tokens=False).ids + [2]
        got = sorted(ids[i], key=lambda r: r.piece)[: len(set(r.piece for r in ids[i]))] if len(ids[i]) == len({r.piece for r in ids[i]}) else None
        if got:
            assert [r.start for r in got] == list(np.cumsum([0] + [r.length for r in got[:-1]])) and sum(r.length for r in got) == len(want)
            for r in got:
                assert r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes())
    return len(by_seq), sum(r.length for r in rows)


def test_packing(spark, texts, nothing, library):
    rows = packing.pack(texts, PATH).collect()
    check_packed(rows, library, [t for t in TEXTS if t[0] != 5], 1024)
    assert sum(r.doc_id == 5 for r in rows) == 2 and packing.pack(nothing, PATH).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n, total = check_packed(packing.pack(docs.repartition(5), PATH).collect(), library, [], 1024)
    assert n <= -(-total // 1024) * 1.01 + 1


def naive_best_fit(lengths, capacity):
    room = []
    for x in sorted(lengths, reverse=True):
        fit = [k for k, r in enumerate(room) if r >= x]
        if fit:
            room[min(fit, key=lambda k: room[k])] -= x
        else:
            room.append(capacity - x)
    return len(room)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 12), max_size=12))
def test_plan_is_best_fit_over_counts(histogram):
    ranges = packing.plan(histogram, 40)
    seqs = collections.defaultdict(list)
    for length, n in histogram.items():
        own = [r for r in ranges if r[0] == length]
        assert sorted(k for r in own for k in range(r[1], r[2] + 1)) == list(range(n))
        for _, first, last, seq, per, at in own:
            for k in range(first, last + 1):
                seqs[seq + (k - first) // per].append((at + (k - first) % per * length, length))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 40
    assert len(seqs) <= naive_best_fit([k for k, n in histogram.items() for _ in range(n)], 40) + 1


# Queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    c = oracle.connect("/root/testdata/sf0.01")
    assert oracle.rows_of(queries.queries()[name](spark, "/root/testdata/sf0.01")) == oracle.sql_rows(c, queries.oracle_sql()[name])


COLUMNS = {
    "op1_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op2_language_id": "doc_id held_out lang_pred score", "op3_main_text": "page_id url text n_chars", "op4_quality": "doc_id held_out score predicted", "op5_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op6_embedding_dedup": "vec_id n_links component_id kept", "op7_licenses": "doc_id n_words n_base first_word last_word base_labels labels score", "op8_probminhash": "doc_id class_id kept", "op9_hnsw": "query_id rank vec_id score", "op10_best_fit": "doc_id piece start length ids_crc32 sequence_id offset",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    assert queries.queries()[name](spark, SF).columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()


def test_pipeline_equals_its_stages_by_brute_force(spark, library):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    m = queries.language_model(docs)
    rows = [r for r in docs.collect() if not m.predict(r.text)[2]]
    left = spark.createDataFrame(rows, docs.schema)
    q = queries.quality_model(left, labels)
    rows = [r for r, s in zip(rows, quality.scores(q, [r.text for r in rows])) if s >= 0.3]
    cls = brute_classes([(r.doc_id, r.text) for r in rows])
    kept = [(r.doc_id, r.text) for r in rows if cls[r.doc_id] == r.doc_id]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == {i for i, _ in kept}
    check_packed(got, library, kept, 1024)


def test_pipeline_stages_keep_the_columns(spark, nothing):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.names == docs.schema.names
        assert stage(spark, nothing, SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, SF).count() == 0


def test_large_bucket_deals_its_main_component_once(spark):
    """2000 classes of a bucket, all but ten one component: dealt rows stay near 2000 (eight times that before), and every pair of different components meets exactly once."""
    from pyspark.sql import functions as F

    from quarrylight.llm import minhash

    m = spark.range(2000).select(F.lit(3).alias("band"), F.lit(7).cast("long").alias("key"), F.lit(2000).cast("long").alias("n"), F.format_string("c%04d", "id").alias("class"), F.when(F.col("id") < 10, F.format_string("c%04d", "id")).otherwise("main").alias("comp"))
    apart = minhash._apart(m)
    rows = minhash._deal(minhash._by_bucket(m, apart), F.lit(minhash.BLOCK)).select("class", "comp", "block", "i", "j").collect()
    assert apart.select("main", "in_main").collect() == [("main", 1990)] and len(rows) < 2200
    met = {}
    for r in rows:
        met.setdefault((r.i, r.j), []).append(r)
    pairs = [tuple(sorted((x["class"], y["class"]))) for (i, j), g in met.items() for a, x in enumerate(g) for y in g[:a] if x.comp != y.comp and {x.block, y.block} == {i, j}]
    assert len(pairs) == len(set(pairs)) == 45 + 10 * 1990
