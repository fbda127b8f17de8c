"""Operators on small tables, against literals and plain loops."""

import datetime as dt
import functools
import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import answers, evaluate, extract, graph, order, segment, state, tables, verify, web
from quarrylight.operators import retrieval as R
from quarrylight.plans import questions as P
from quarrylight.sources import files, sinks
from quarrylight.streaming import conversation, events


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<string>' if isinstance(v, list) else 'double'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).collect()[0].x


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "wind power wind"), (2, "solar power"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.bm25 for r in R.bm25(docs, spark.createDataFrame([(9, "wind power")], "qid long, question string")).collect()}
    n, avgdl = 3, 5 / 3
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda df, tf, dl: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    assert set(got) == {1, 2}
    assert math.isclose(got[1], part(1, 2, 3) + part(2, 1, 3), rel_tol=1e-12) and math.isclose(got[2], part(2, 1, 2), rel_tol=1e-12)


def test_rank_fusion(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "qid long, id long, rank int, score double")
    got = R.fused(rows((1, 5, 1, 0.9), (1, 6, 2, 0.5)), rows((1, 6, 1, 0.6), (1, 7, 2, 0.4)), 10).orderBy("rank").collect()
    assert [r.id for r in got] == [6, 5, 7] and [r.retrieval for r in got] == ["bm25+dense", "dense", "bm25"]
    assert math.isclose(got[0].fused, round(28 * (1 / 62 + 1 / 61) + 0.25 * 0.6, 6))


def test_text_functions(spark):
    assert one(spark, T.tokens(F.col("t")), t="Foo-bar a b9 x") == ["foo-bar", "b9"]
    assert one(spark, T.query_terms(F.col("t")), t="What's the price of the 'Big' price?") == ["what's", "price", "big"]
    assert one(spark, T.compact(F.col("t"), 6), t="abc  defghi") == "abc d..."
    assert one(spark, T.corrected_digits(F.col("t")), t="1O2 I3l4 5S6") == "102 I314 556"
    assert one(spark, T.american(F.col("t")), t="optimise colour") == "optimize color"
    assert one(spark, T.labels_in(F.col("t")), t="a [S1] b [W2] [S1]") == ["S1", "W2"]
    assert one(spark, T.stem_key(F.col("t")), t="a/B c-1.PDF") == "bc1"
    for f in (T.squeezed, T.normalized, T.clean_extracted):
        assert one(spark, f(F.col("t")), t=None) == ""


def test_normalisers_are_idempotent(spark):
    @settings(max_examples=15, deadline=None)
    @given(st.lists(st.text(alphabet="ab .\n\t-A1é", max_size=30), min_size=1, max_size=20))
    def run(texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        for f in (T.squeezed, T.normalized, T.clean_extracted):
            assert df.where(f(f(F.col("t"))) != f(F.col("t"))).count() == 0

    run()


def loop_packed(parts, size, joint):
    out, cur = [], ""
    for p in parts:
        grown = p if not cur else cur + joint + p
        if len(grown) <= size or not cur:
            cur = grown
        else:
            out.append(cur)
            cur = p
    return out + ([cur] if cur else [])


def test_packing_is_the_greedy_fold(spark):
    parts = ["a" * n for n in (3, 4, 9, 1, 1, 12, 2, 5)]
    assert one(spark, segment.packed(F.col("p"), 10, "\n\n"), p=parts) == loop_packed(parts, 10, "\n\n")


def test_sliding_windows_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(2500))
    got = one(spark, segment.sliding(F.col("t")), t=text)
    assert got[0] == text[:1000] and all(text[k * 880 : k * 880 + 1000] == c for k, c in enumerate(got)) and got[-1].endswith(text[-1])


def test_formula_and_claims(spark):
    assert one(spark, extract.formula_score(F.col("t")), t="y = beta0 + beta1 x_i + epsilon") >= 0.55
    assert one(spark, extract.formula_score(F.col("t")), t="A quiet walk in the park.") < 0.2
    assert one(spark, extract.calendar_dates(F.col("t")), t="On 3rd May 2021, May 4 2021, 2021-13-01 and 2021-05-03; May 2021.") == ["2021-5-3", "2021-5-4"]
    c = extract.claims(spark.createDataFrame([(1, "Wind power is growing fast. Hm.\n- It has 1200 turbines in use [S1]\nlet me know if it is fine")], "doc_id long, text string")).collect()
    assert [(r.claim_id, r.claim, r.claim_type) for r in c] == [("C1", "Wind power is growing fast.", "identity"), ("C2", "It has 1200 turbines in use.", "date")]


def test_verdicts(spark):
    c = spark.createDataFrame([(1, "wind turbines are tall", ["S2"]), (2, "nothing shared", [])], "claim_id long, claim string, cited array<string>")
    s = spark.createDataFrame([("S1", "tall wind turbines stand here"), ("S2", "wind")], "label string, text string")
    got = {r.claim_id: r for r in verify.verified(c, verify.support(c, s)).collect()}
    assert got[1].verdict == "supported" and got[1].supporting == "S1,S2" and got[2].verdict == "unsupported" and got[2].best == 0


def test_web(spark):
    assert one(spark, web.url_key(F.col("u")), u="https://www.Example.org:443/a//b/index.html?utm_source=x&b=2&a=1#top") == "example.org/a/b?a=1&b=2"
    assert one(spark, web.authority(F.lit("web"), F.col("u"), F.lit("")), u="https://arxiv.org/abs/1") == "scientific_paper"
    assert one(spark, files.public_url(F.col("u")), u="http://127.0.0.1/x") is False and one(spark, files.public_url(F.col("u")), u="https://example.org/") is True


def test_graph_reach_and_orphans(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")], "src string, dst string")
    got = {(r.node, r.hops) for r in graph.reach(e, spark.createDataFrame([("a",)], "id string"), 2).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    n = spark.createDataFrame([("a",), ("z",)], "entity_id string")
    assert [r.entity_id for r in graph.orphans(n, spark.createDataFrame([], "entity_id string"), e).collect()] == ["z"]


def test_state_and_order(spark):
    d = spark.createDataFrame([(i, i % 3) for i in range(50)], "k long, v long")
    assert [r.n for r in order.numbered(d, ["k"], "n", 5).orderBy("k").collect()] == list(range(1, 51))
    b = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    n = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    assert {(r.path, r.status) for r in state.manifest_diff(b, n).collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "new")}
    assert one(spark, tables.formatted(F.col("x")), x=545000.0) == "545,000" and one(spark, tables.formatted(F.col("x")), x=2.5) == "2.50"
    assert sinks.should_roll_back(10, 0, 3, 0) and sinks.should_roll_back(10, 4, 3, 1) and not sinks.should_roll_back(10, 4, 3, 0)


def test_metrics_of_nothing(spark):
    r = evaluate.hit_at(spark.createDataFrame([], "qid long, rank int, id long"), spark.createDataFrame([], "qid long, id long")).collect()[0]
    assert (r.n, r.hit_at_1, r.not_found_accuracy) == (0, 0.0, 0.0)


def test_winner_needs_grounding(spark):
    rows = [(1, "a", "high", 0, None, 1.0), (1, "b", "low", 1, None, 1.0), (2, "a", "high", 0, None, 1.0), (3, "a", "high", 2, 0.5, 9.0), (3, "b", "high", 2, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "q long, mode string, confidence string, n_sources long, faithfulness double, latency double")
    assert {r.q: r.winner for r in evaluate.winner(df, "q").collect()} == {1: "b", 2: "", 3: "b"}


def test_variants(spark):
    assert one(spark, P.variants(F.col("t")), t="How large is Lake Garda") == ["How large is Lake Garda", "large lake garda", "How Lake Garda large lake garda", "large lake garda How Lake Garda"]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes("é".encode())
    (tmp_path / "in/b.md").write_bytes(b"\xe9")
    (tmp_path / "in/c.bin").write_bytes(b"x")
    assert {r.text for r in files.pages(spark, str(tmp_path / "in")).collect()} == {"é"}
    assert files.files(spark, str(tmp_path / "in")).count() == 2
    path = str(tmp_path / "t")
    assert sinks.replace(spark.range(5), path) == 5
    try:
        sinks.replace(spark.range(1), path, least_rows=3)
        raise AssertionError
    except ValueError:
        assert spark.read.parquet(path).count() == 5
    raw = spark.createDataFrame([('{"results": [{"link": "https://a.b/c", "name": "T", "snippet": "s"}, {"url": "javascript:x"}]}',)], "payload string")
    assert [tuple(r) for r in files.web_results(raw).collect()] == [("W1", "https://a.b/c", "T", "s")]


def test_numbers_of_many_wide_rows(spark):
    """More rows than range partitioning samples, in several partitions, read through different columns."""
    n = 2_000_000
    d = spark.range(0, n, 1, 4).select((F.col("id") * 7919 % n).alias("k"), F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.lit(1).alias("n"))
    got = order.numbered(d, ["k"], "nth", 4)
    assert got.where("nth != k + 1").agg(F.count("*"), F.max("text")).collect()[0][0] == 0
    assert got.count() == n and got.columns == ["k", "text", "n", "nth"]
    assert order.numbered(d.limit(0), ["k"], "nth", 4).count() == 0


def test_conversations_without_id_or_text(spark):
    rows = [(None, 1, "user", "ask Maria Rossi"), (None, None, None, None), (2, 1, "user", None)] + [(3, i, "user", f"Meet Anna Nr{chr(97 + i)}x") for i in range(26)]
    got = {r.conv_id: r for r in conversation.state(spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn int, role string, text string, nth int")).collect()}
    assert (got[None].turns, got[None].last_role, got[None].entities) == (2, "user", "Maria Rossi")
    assert (got[2].turns, got[2].entities) == (1, "") and got[3].turns == 26
    assert conversation.state(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_conversation_fold(spark):
    c = spark.createDataFrame([(1, 2, "assistant", "The president Maria Rossi spoke."), (1, 1, "user", "hi")], "conv_id long, turn long, role string, text string")
    r = conversation.state(c).collect()[0]
    assert (r.turns, r.last_role, r.roles) == (2, "assistant", "president=Maria Rossi")
    assert conversation.resolved("Where was the president born?", {"president": "Maria Rossi"}) == "Where was Maria Rossi born?"


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=7 * i), i % 3, "click" if i % 2 else "view", float(i)) for i in range(60)]
    schema = "ts timestamp, user_id long, event_type string, value double"
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "e"))
    want = {tuple(r) for r in events.tumbling(df).collect()}
    q = events.tumbling(stream).writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("tumbling").collect()} == want
    seen = []
    events.ingest(stream, lambda b, n: seen.append((n, b.count())), str(tmp_path / "cp")).awaitTermination(60)
    assert sum(n for _, n in seen) == 60
    q = events.once(stream, ["user_id", "event_type"], "1 day").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("once").count() == 6


def test_formula_repair(spark):
    assert one(spark, answers.repaired_formula(F.col("t")), t="y=beta0+beta_1*x <= sigma^2") == "y = β₀ + β₁ * x ≤ σ²"
    assert one(spark, answers.field_target(F.col("t")), t="When does it expire?") == "expiry_date"


def test_names_and_variables(spark):
    assert one(spark, answers.requested_names(F.col("t")), t="Summarize report-1.pdf and b.TXT, not the file other") == ["report-1.pdf", "b.TXT"]
    assert one(spark, answers.requested_names(F.col("t")), t="summary of annual-report, file these") == ["annual-report"]
    assert one(spark, answers.formula_variables(F.col("t"), F.lit("Here x_i is the dose.")), t="y = a + x_i") == {"y": "not defined in nearby text", "a": "not defined in nearby text", "x_i": "the dose"}


def test_evidence_comes_from_all_documents(spark, tmp_path):
    from quarrylight.queries import QUERIES

    sf = str(tmp_path)
    spark.createDataFrame([(1, "tall turbines of the northern coast")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = [(7, "Here stand tall turbines of the northern coast.", "en", "a", 47), (41, "nothing in common", "en", "b", 17), (81, "a coast", "en", "c", 7)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, [1.0, 0.0]), (7, [1.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{sf}/embeddings.parquet")
    assert [r.item for r in QUERIES["evidence_rank"](spark, sf).orderBy("rank").collect()] == [7, 81]
    assert QUERIES["answer_payload"](spark, sf).collect()[0].citations == "S7,S81"


def test_documents_are_ranked_by_all_of_their_text(spark, tmp_path):
    from quarrylight.queries import QUERIES

    sf = str(tmp_path)
    spark.createDataFrame([(1, "turbine")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = [(1, "ab cd " * 100 + "turbine " * 20, "en", "x", 760), (2, "ab cd", "en", "y", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    assert [(r.document, r.rank) for r in QUERIES["rank_documents"](spark, sf).collect()] == [(1, 1)]


def test_names_of_others_are_nowhere():
    from pathlib import Path

    top = Path(__file__).resolve().parent.parent
    word = "veri" + "lume"
    assert not [p for p in [*top.rglob("*.py"), top / "README.md"] if re.search(word, p.read_text(), re.I)]


def test_interpretation_of_follow_ups(spark):
    """Cases of questions beside a state: what is asked, and where it may be looked up."""
    from quarrylight.plans import interpret

    rows = [
        ("The president of the country", ("", "", "", "", ""), "clarification", "The president of the country", (False, False, False)),
        ("The president of the country", ("Democratic Republic of the Congo", "", "", "", ""), "government", "Who is the President of the Democratic Republic of the Congo?", (True, True, True)),
        ("The smallest country in Europe", ("", "", "", "", ""), "public_knowledge", "The smallest country in Europe", (True, False, True)),
        ("Where is Alex from", ("", "", "", "", ""), "general", "Where is Alex from", (True, False, True)),
        ("Which ones have erupted in history?", ("", "", "", "", "volcanic lakes"), "public_knowledge", "Which volcanic lakes have erupted in history?", (True, False, True)),
        ("When did the president come into power?", ("France", "A B", "President", "A B", ""), "government", "When did A B become President of France?", (True, True, True)),
        ("which document mentions wind?", ("", "", "", "", ""), "local_document", "which document mentions wind?", (True, False, False)),
        (None, ("", "", "", "", ""), "general", "", (True, False, True)),
    ]
    d = spark.createDataFrame([(n, r[0], *r[1], "x") for n, r in enumerate(rows)], "qid int, question string, country string, person string, role string, holder string, topic string, intent_ string")
    got = {r.qid: (r.intent, r.resolved, (r.use_local, r.use_web, r.use_model)) for r in interpret.interpreted(d.drop("intent_")).collect()}
    assert got == {n: r[2:] for n, r in enumerate(rows)}
    assert interpret.interpreted(d.drop("intent_").limit(0)).count() == 0


def test_decisions_by_stream(spark):
    s = spark.createDataFrame([(1, "local", "S1", "supports", 0.5), (1, "web", "W1", "supports", 0.9), (2, "local", "S1", "supports", 0.5), (2, "web", "W1", "supports", 0.4), (3, "ai", "A", "supports", 0.6), (4, "web", "W1", "contradicts", 0.9), (4, "local", "S2", "supports", 0.4), (5, "web", "W9", "unclear", 0.3)], "claim_id int, stream string, label string, support string, confidence double")
    f = spark.createDataFrame([(1, "dynamic", "x"), (2, "stable", "local_only"), (3, "stable", "x"), (4, "stable", "x"), (5, "news", "x"), (6, "news", "x")], "claim_id int, fact_type string, policy string")
    assert {r.claim_id: (r.winner, r.conflict) for r in verify.decisions(s, f).collect()} == {1: ("web", False), 2: ("local", False), 3: ("ai", False), 4: ("local", True), 5: ("unsupported", False), 6: ("unsupported", False)}


def test_normal_forms(spark):
    from quarrylight.plans import normal

    d = spark.createDataFrame([(1, "How big is France's area?"), (2, "what is the size of France"), (3, "population of new york"), (4, None), (5, "Who is Luc Frieden?")], "qid int, question string")
    got = {r.qid: (r.intent, r.entities, r.key_terms) for r in normal.normal(d).collect()}
    assert got[1] == ("how", ["France's"], ["area", "france", "france's"])  # a possessive is taken off the words, not off the names
    assert got[2] == ("what", ["France"], ["area", "france"]) and got[3] == ("statement", ["New York"], ["population", "new", "york"])
    assert got[4] == ("statement", [], []) and got[5] == ("who", ["Luc Frieden"], ["luc", "frieden"])
    forms = {r.qid: r.forms for r in normal.search_forms(normal.normal(d)).collect()}
    assert forms[2] == ["what is the size of france", "area france", "france area", "area information", "france area square kilometers", "france total area"] and forms[4] == []


def state_of(**known):
    from quarrylight.operators import dialog

    none = {**dict.fromkeys(dialog.TEXTS, ""), **{x: [] for x in dialog.LISTS}, "roles": {}}
    return tuple((none | known).values())


def test_states_are_merged_and_taken_over(spark):
    from quarrylight.operators import dialog

    schema = f"base {dialog.SCHEMA}, state {dialog.SCHEMA}"
    rows = [(state_of(country="France", role="President", roles={"president": "A B"}, topics=["x", "Y"]), state_of(topics=["y", "z"], entities=[" ", "E"], country="Norway")), (None, state_of(person="P")), (state_of(topic="t"), None)]
    got = [r.m.asDict() for r in spark.createDataFrame(rows, schema).select(dialog.merged(F.col("base"), F.col("state")).alias("m")).collect()]
    assert (got[0]["country"], got[0]["person"], got[0]["topics"], got[0]["entities"], got[0]["roles"]) == ("Norway", "A B", ["y", "z", "x"], ["E"], {"president": "A B"})
    assert got[1]["person"] == "P" and got[2]["topic"] == "t"

    found = [("Norway", "Country", None), ("Anna", "person", "King"), ("Berta", "person", "king"), ("wind", "topic", ""), (" ", "topic", ""), ("f.txt", "file", "")]
    d = spark.createDataFrame([(state_of(country="France", person="Q", roles={"king": "old", "queen": "C"}, topics=["old"]), "general", found), (state_of(country="France", topic="t", roles={"king": "old"}), "person", []), (None, None, None)], f"state {dialog.SCHEMA}, intent string, found array<struct<name string, type string, role string>>")
    got = [r.s.asDict() for r in d.select(dialog.taken_over(F.col("state"), F.col("intent"), F.lit("r?"), F.col("found"), F.array(F.lit("Reuters"))).alias("s")).collect()]
    assert (got[0]["country"], got[0]["person"], got[0]["topic"], got[0]["topics"], got[0]["document"]) == ("Norway", "Berta", "wind", ["wind", "Norway government", "old"], "f.txt")
    assert got[0]["roles"] == {"king": "Berta", "queen": "C"} and got[0]["entities"] == ["f.txt", "wind", "Berta", "Anna", "Norway"] and got[0]["sources"] == ["Reuters"]
    assert (got[1]["country"], got[1]["topic"], got[1]["roles"], got[1]["intent"]) == ("", "", {}, "person") and got[2]["last_question"] == "r?"


def test_registered_roles(spark):
    from quarrylight.operators import dialog

    dialog.register_role("Mayor", "Mayor")
    try:
        assert one(spark, dialog.role_of(F.col("t")), t="Who is the mayor of Rome?") == "Mayor" and one(spark, dialog.role_of(F.col("t")), t="the president") == "President"
    finally:
        dialog._roles.clear()


def test_questions_that_lean_on_others(spark):
    from quarrylight.operators import dialog

    rows = [("What about wind", "x", 1, False, 0.1, True), ("Is it so?", "x", 1, False, 0.1, True), ("Is it so?", "x", 0, False, 0.0, False), ("Is it so?", "is it so", 1, False, 1.0, False), ("thanks for that", "x", 1, True, 0.1, False), ("Where is Rome in the world", "x", 2, False, 0.1, False), (None, "x", 1, False, 0.0, False)]
    d = spark.createDataFrame([(n, *r[:5]) for n, r in enumerate(rows)], "n int, q string, b string, k int, s boolean, r double")
    got = {x.n: x.w for x in d.select("n", dialog.wants_rewriting(*(F.col(c) for c in "qbksr")).alias("w")).collect()}
    assert got == {n: r[5] for n, r in enumerate(rows)}


def test_sentences_keep_digits_that_are_their_own_number(spark):
    text = "Zero the 1. 1 one 1. 2 two, which is long enough for a summary of seven words. 3 three"
    assert one(spark, T.sentences(F.col("t")), t=text) == ["Zero the 1.", "1 one 1.", "2 two, which is long enough for a summary of seven words.", "3 three"]
    assert one(spark, T.sentences_capital(F.col("t")), t="0 a. 1 b. B 2. C") == ["0 a.", "1 b.", "B 2.", "C"]
    assert one(spark, segment.summary(F.col("t")), t=text) == "2 two, which is long enough for a summary of seven words."
    assert one(spark, segment.semantic(F.col("t")), t="0 a\n\n1 b\n\nc 2") == ["0 a\n\n1 b\n\nc 2"]


def test_snippet_keeps_the_digits_of_its_sentence(spark):
    from quarrylight.operators import people

    assert one(spark, people.first_sentence_with(F.col("t"), F.lit("the")), t="Nothing. 11 of the 41") == "11 of the 41"


def test_benchmark_winner_at_the_bound_and_without_user(spark, tmp_path):
    """Means of exactly 60 whose doubles add up to a little more in this order; a null user has no winner, as in the SQL's join."""
    import oracle

    from quarrylight.queries import QUERIES, SQL

    draw = random.Random(1)
    cents = ([draw.randrange(12000) for _ in range(9)] for _ in range(1000))
    over = next(v for v in ([x / 100 for x in [*c, 60000 - sum(c)]] for c in cents) if functools.reduce(float.__add__, v, 0.0) / 10 > 60)
    rows = [(1, "a", x) for x in over] + [(1, "b", 50.0)] * 10 + [(None, "a", 70.0)] * 3
    spark.createDataFrame(rows, "user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    names, got = oracle.rows_of(QUERIES["benchmark_winner"](spark, str(tmp_path)))
    assert (names, got) == (["user_id", "winner"], [(1, "b"), (None, "")])
    null = [r for r in oracle.sql_rows(oracle.connect(tmp_path), SQL["benchmark_winner"])[1] if r[0] is None]
    assert null == [(None, "")]


def test_best_sentences_shuffle_nothing(spark, monkeypatch):
    """Claims go to the sources; the same rows as by the join, which repeated labels still take."""
    claims = spark.createDataFrame([(1, "Wind power is not cheap."), (2, "solar solar wind"), (3, "zebra"), (4, None)], "claim_id long, claim string")
    texts = [("S1", "Solar wind. Wind power is cheap! wind power"), ("S2", None), ("S3", "Nothing here. Cheap power. Cheap not wind."), ("S4", ""), ("S5", "of the. Solar.")]
    sources = spark.createDataFrame(texts, "label string, text string")
    rows = lambda df: sorted(map(tuple, df.select("claim_id", "label", "overlap", "low", "neg").collect()))
    fast, joined = verify.best_sentences(claims, sources), verify._best_by_join(claims, sources)
    assert rows(fast) == rows(joined) and len(rows(fast)) == 5
    assert "hashpartitioning" not in fast._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(verify, "STEP_WORDS", 1)
    assert rows(verify.best_sentences(claims, sources)) == rows(joined)
    twice = sources.union(sources)
    assert rows(verify.best_sentences(claims, twice)) == rows(verify._best_by_join(claims, twice))


def test_surest_of_a_task():
    import pyarrow as pa

    b = lambda *r: pa.RecordBatch.from_pylist([dict(zip(("claim_id", "stream", "label", "support", "confidence"), x)) for x in r])
    got = list(verify._surest_of_task(iter([b((1, "web", "S9", "supports", 0.5), (1, "web", "S2", "unclear", 0.5), (1, "ai", "S1", "unclear", 0.1)), b((1, "web", "S1", "supports", 0.4), (1, "web", "S10", "supports", 0.5), (1, "web", "S5", "supports", 0.9))])))
    assert len(got) == 1 and sorted(got[0].column("label").to_pylist()) == ["S1", "S10", "S2", "S5"]
