"""Office and PDF readers on files made here; providers with answers made here."""

import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quarrylight.sources import files, office, providers

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
R = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def zipped(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("--", "."), text)
    return out.getvalue()


def word_file() -> bytes:
    para = lambda *runs: "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"
    cell = lambda t: f"<w:tc>{para(t)}</w:tc>"
    return zipped(**{"word__document--xml": f"<w:document {W}><w:body>{para('Wind ', 'power')}{para(' ')}<w:tbl><w:tr>{cell('a')}{cell('')}{cell('b')}</w:tr><w:tr>{cell('')}</w:tr></w:tbl>{para('End é')}</w:body></w:document>"})


def slide_file() -> bytes:
    shape = lambda t, kind="": f'<p:sp><p:nvSpPr><p:nvPr>{f"""<p:ph type="{kind}"/>""" if kind else ""}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = lambda *s: f"<p:sld {P}><p:cSld><p:spTree>{''.join(s)}</p:spTree></p:cSld></p:sld>"
    rel = lambda *r: f"<Relationships {R}>" + "".join(f'<Relationship Id="{i}" Type="http://x/{k}" Target="{t}"/>' for i, k, t in r) + "</Relationships>"
    return zipped(**{
        "ppt__presentation--xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="1" r:id="r2"/><p:sldId id="2" r:id="r1"/><p:sldId id="3" r:id="r3"/></p:sldIdLst></p:presentation>',
        "ppt___rels__presentation--xml--rels": rel(("r1", "slide", "slides/s1.xml"), ("r2", "slide", "slides/s2.xml"), ("r3", "slide", "slides/s3.xml")),
        "ppt__slides__s1--xml": slide(shape("One"), f"<p:grpSp>{shape('In a group')}</p:grpSp>"), "ppt__slides__s2--xml": slide(shape("Two  first")), "ppt__slides__s3--xml": slide(),
        "ppt__slides___rels__s1--xml--rels": rel(("n", "notesSlide", "../notesSlides/n1.xml")), "ppt__notesSlides__n1--xml": slide(shape("Said aloud", "body"), shape("7", "sldNum")),
    })


def pdf_file() -> bytes:
    one = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Wind pow-) Tj T* (er \\(now\\)) Tj 0 -14 Td [(A) -20 (B) -400 (C)] TJ ET")
    two = b"BT /F2 12 Tf <00010002> Tj ET"
    table = b"beginbfchar <0001> <00E9> endbfchar 1 beginbfrange <0002> <0003> <0041> endbfrange"
    stream = lambda d, extra=b"": b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(d), extra, d)
    bodies = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R 9 0 R] /Count 3 /Resources << /Font << /F1 7 0 R /F2 8 0 R >> >> >>", b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R] >>",
        stream(one, b"/Filter /FlateDecode "), stream(two), b"<< /Type /Font /BaseFont /Helvetica >>", b"<< /Type /Font /ToUnicode 10 0 R >>", b"<< /Type /Page /Parent 2 0 R >>", stream(table),
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, b) for n, b in enumerate(bodies, 1)) + b"trailer << /Root 1 0 R >>"


def test_readers():
    assert office.docx(word_file()) == [(None, "Wind power\nEnd é\na | b")]
    assert office.pptx(slide_file()) == [(1, "Two first"), (2, "One\nIn a group\nSaid aloud")]
    assert office.pdf(pdf_file()) == [(1, "Wind power (now)\nAB C"), (2, "éA")]


def test_pages_of_a_folder(spark, tmp_path):
    for name, data in {"a.docx": word_file(), "b.pptx": slide_file(), "c.PDF": pdf_file(), "d.txt": b"plain", "e.bin": b"x", "f.docx": b"broken", "g.pdf": b"no pdf"}.items():
        (tmp_path / name).write_bytes(data)
    got = {(r.path.rsplit("/", 1)[-1], r.page): r.text for r in files.pages(spark, str(tmp_path)).collect()}
    assert set(got) == {("a.docx", None), ("b.pptx", 1), ("b.pptx", 2), ("c.PDF", 1), ("c.PDF", 2), ("d.txt", None)}


def test_recognised_lines(spark):
    d = spark.createDataFrame([([("Wind  power", 0.9), ("noise", 0.1), (" ", 0.9), ("sure", None), (None, 0.9)],), ([],), (None,)], "r array<struct<text string, confidence double>>")
    assert [x.t for x in d.select(office.recognised(F.col("r")).alias("t")).collect()] == ["Wind power\nsure", "", ""]


@pytest.mark.parametrize("name", [p.name for p in providers.BUILT_IN])
def test_requests_and_answers(name):
    s = providers.Settings(name, "key", "engine", "https://x.org/s?q={query}&k={api_key}", 3)
    p = providers.provider_for(s)
    r = p.request(s, "wind & sun")
    assert p.name == name and p.ready(s) and r.url.startswith("https://") and ("wind & sun" in [*r.params.values(), *(r.body or {}).values()] or "wind+%26+sun" in r.url)
    assert p.ready(providers.Settings(name)) == (name == "duckduckgo")
    if p.path != ("results",):
        payload = [{"url": "https://a.org"}, "odd"]
        for key in reversed(p.path):
            payload = {key: payload}
        assert p.results(payload) == [{"url": "https://a.org"}]
    assert p.results(None) == p.results({}) == []


def test_topics_are_flattened():
    t = [{"Topics": [{"FirstURL": "u1", "Text": "A - of b"}, {"Topics": [{"FirstURL": "u2", "Text": "C"}]}]}, {"FirstURL": "", "Text": "x"}, {"FirstURL": "u3", "Text": "D - e - f"}]
    assert [(x["title"], x["url"]) for x in providers.flattened(t)] == [("A", "u1"), ("C", "u2"), ("D", "u3")]


def test_search_merges_the_answers_of_a_question(spark):
    def send(request):
        q = request.params["q"]
        if q == "fails":
            raise OSError("no network")
        return json.dumps({"web": {"results": [{"url": f"https://www.a.org/{q}/", "title": q, "description": "d"}, {"url": "http://same.org/?utm_x=1", "title": ""}, {"url": "ftp://no.org"}]}}) if q != "odd" else "<html>"

    q = spark.createDataFrame([(1, "one"), (1, "two"), (2, "fails"), (3, "odd"), (4, None), (5, "five")], "qid long, query string").coalesce(1)
    got = [tuple(r) for r in providers.search(q, providers.Settings("Brave", "k", most=3), send).orderBy("qid", "rank").collect()]
    assert got == [(1, 1, "https://www.a.org/one/", "one", "d"), (1, 2, "http://same.org/?utm_x=1", "http://same.org/?utm_x=1", ""), (1, 3, "https://www.a.org/two/", "two", "d"), (5, 1, "https://www.a.org/five/", "five", "d"), (5, 2, "http://same.org/?utm_x=1", "http://same.org/?utm_x=1", "")]
    assert providers.search(q, providers.Settings("brave"), send).count() == 0 and providers.search(q.limit(0), providers.Settings("brave", "k"), send).count() == 0


def test_registries():
    assert providers.provider_for(providers.Settings("no such")).name == "tavily" and "google_cse" in providers.available()
    assert providers.generator("extractive").answer("Where is wind power?", [("S1", "Sun is hot. Wind power is here")]) == "Wind power is here. [S1]"
    with pytest.raises(ValueError, match="no text generator"):
        providers.generator("none")
