"""The stored index, the block joins and the set joins against scoring everything."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import nearest as N
from quarrylight.operators import overlap as O
from quarrylight.operators import postings as P
from quarrylight.operators import retrieval as R


def corpus(n, seed=1):
    """Texts with common and rare words, some of them copies, some very long, one empty and one null."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    texts = [" ".join(r.choices(words, weights, k=r.choice([1, 5, 30, 200]))) for _ in range(n)]
    texts[5:15] = [texts[4]] * 10
    texts[20] = " ".join(r.choices(words, weights, k=9000))
    return [(i, t) for i, t in enumerate(texts)] + [(n, None), (n + 1, "")]


def brute(rows, questions, k):
    """Best documents by BM25, straight from the formula."""
    toks = [(i, (t or "").lower().split()) for i, t in rows]
    toks = [(i, [w for w in ws if len(w) > 1]) for i, ws in toks]
    n, mean = len(toks), sum(len(ws) for _, ws in toks) / len(toks)
    df = {}
    for _, ws in toks:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    out = set()
    for qid, q in questions:
        scored = []
        for i, ws in toks:
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / max(1, mean))) for w in q.split() if w in ws)
            if s:
                scored.append((-round(s, 5), i, s))
        out |= {(qid, rank + 1, str(i), round(s, 4)) for rank, (_, i, s) in enumerate(sorted(scored)[:k])}
    return out


QUESTIONS = [(1, "w0 w1 w2 w300"), (2, "w5 w5 w390 w7 w200 w9"), (3, "unknown"), (4, "w0"), (5, " ".join(f"w{i}" for i in range(0, 400, 9))), (6, "")]


def hits(found):
    return {(r.qid, r["rank"], r.doc_id, round(r.bm25, 4)) for r in found.hits.collect()}


def test_index_equals_scoring_everything(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, term string, level int").repartition(5)
    q = spark.createDataFrame(QUESTIONS, "qid int, question string")
    index = P.build(docs)
    found = index.topk(q, 7)
    assert hits(found) == brute(rows, QUESTIONS, 7)
    again = P.PostingsIndex(spark, index.path).topk(q, 3)  # another reader of the same files
    assert hits(again) == brute(rows, QUESTIONS, 3)
    assert P.build(docs.limit(0)).topk(q, 3).hits.count() == 0
    assert index.topk(q.limit(0), 3).hits.count() == 0


def test_index_reads_less(spark):
    rows = corpus(6000, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    q = spark.createDataFrame([(1, "w0 w1 w2 w3 w350 w360"), (2, "w0 w4 w370 w6")], "qid int, question string")
    found = P.build(docs).topk(q, 5)
    assert hits(found) == brute(rows, [tuple(r) for r in q.collect()], 5)
    work = {r.qid: r for r in found.work.collect()}
    assert all(w["read"] < 0.75 * w.postings and w.scored < 0.5 * w.candidates for w in work.values()), work


@pytest.mark.parametrize("most", [500_000, 0])
def test_index_scores_few_documents(spark, monkeypatch, most):
    """What was seen of the k-th best document is reached by few others, however many the first score lets through."""
    monkeypatch.setattr(P, "MOST_TERMS", most)
    rows = corpus(3000, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n, 200, 7))) for n in range(4)], "qid int, question string")
    found = P.build(docs).topk(q, 5)
    assert hits(found) == brute(rows, [tuple(r) for r in q.collect()], 5)
    work = found.work.collect()
    assert len(work) == 4 and all(w.scored <= 100 for w in work), work


def test_sums_in_small_pieces(spark, monkeypatch):
    """A segment's postings and a batch's documents are added up in tasks, however few cells and pairs are held at once; no pair of question and document is grouped by shuffle."""
    monkeypatch.setattr(P, "CELLS", 1500)
    monkeypatch.setattr(P, "PAIRS", 40)
    rows = corpus(700, 8)
    index = P.build(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    index.delete(spark.createDataFrame([(i,) for i in range(0, 700, 9)], "doc_id long"))
    found = index.topk(spark.createDataFrame(QUESTIONS, "qid int, question string"), 7)
    assert hits(found) == brute([r for r in rows if r[0] % 9 or r[0] >= 700], QUESTIONS, 7)
    plan = found.hits._jdf.queryExecution().toString()
    assert "sum(" not in plan and "MapInArrow" in plan


def test_blocks_hold_every_posting(spark):
    """Blocks are made where the documents are, also where a segment goes on in another batch; no shuffle of postings."""
    rows = corpus(500, 6)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        index = P.build(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    places = lambda t: sorted(map(tuple, t.select("segment", "key", "dl", F.inline("terms")).collect()))
    blocks = index._read("blocks")
    spread = blocks.select("segment", "term", "level", "top", "n", "docs").collect()
    assert places(index._read("forward")) == sorted((b.segment, d.key, d.dl, b.term, d.tf) for b in spread for d in b.docs)
    base = index.totals().base
    for b in spread:
        worth = [d.tf / (d.tf + 1.5 * (0.25 + 0.75 * d.dl / base)) for d in b.docs]
        assert b.n == len(b.docs) and max(worth) == pytest.approx(b.top) and {min(15, int(w * 16)) for w in worth} == {b.level}


@pytest.mark.parametrize("size", [1, 60, 4 << 20])
def test_terms_are_those_of_the_pattern(spark, monkeypatch, size):
    """Terms are counted in Arrow batches, whatever stands at the borders of texts and slices."""
    from quarrylight.functions import text as T

    monkeypatch.setattr(P, "SLICE_BYTES", size)
    r = random.Random(9)
    texts = [None, "", "-", "a", "a-", "-a", "--ab", "_a_B", "ab", "\u00e9", "\u212aab"] + ["".join(r.choices("aBz09_- .\u00f1\u00e9\n'K\U0001f600", k=r.choice([0, 2, 5, 40]))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    got = P._counted(docs, "doc_id", "text")
    assert "regexp" not in got._jdf.queryExecution().toString()
    want = docs.select("doc_id", T.counted(T.tokens(F.coalesce("text", F.lit("")))).alias("terms")).collect()
    assert {x.doc_id: (x.terms, x.dl) for x in got.collect()} == {str(x.doc_id): (x.terms, sum(t.n for t in x.terms)) for x in want}


def test_index_follows_changes(spark):
    rows = dict(corpus(400))
    index = P.build(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    q = spark.createDataFrame(QUESTIONS, "qid int, question string")
    change = {3: "w300 w300 w1", 7: None, 1000: "w390 w390 w5 w0"}
    index.delete(spark.createDataFrame([(4,), (6,), (999,), (None,)], "doc_id long")).upsert(spark.createDataFrame(list(change.items()), "doc_id long, text string"))
    now = {i: t for i, t in (rows | change).items() if i not in (4, 6)}
    assert hits(index.topk(q, 6)) == brute(list(now.items()), QUESTIONS, 6)
    index.delete(spark.createDataFrame([(1000,)], "doc_id long")).upsert(spark.createDataFrame([(4, "w0 w1 back again w300")], "doc_id long, text string"))
    now = {i: t for i, t in (now | {4: "w0 w1 back again w300"}).items() if i != 1000}
    assert hits(index.topk(q, 6)) == brute(list(now.items()), QUESTIONS, 6)
    made = index.compact()
    assert hits(made.topk(q, 6)) == brute(list(now.items()), QUESTIONS, 6) and made.totals().dead == 0
    assert index.live().count() == len(now)


@pytest.mark.parametrize("name", ["extractive_answer", "rare_terms"])
def test_texts_are_not_shuffled_to_what_was_found(spark, name):
    """Found documents are few and go to the texts."""
    from quarrylight.queries import QUERIES

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for texts that are many
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    joins = [line for line in plan.splitlines() if "Join" in line and "doc_id" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins), plan


def test_changes_do_not_shuffle_the_index(spark):
    """Ids of a change go to the forward table, which holds all terms."""
    rows = corpus(300)
    index = P.build(spark.createDataFrame(rows, "doc_id long, text string"))
    ids = spark.createDataFrame([(str(i),) for i in range(0, 300, 7)] + [(None,), ("7",)], "doc_id string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        named = index._named(ids)
        assert "hashpartitioning" not in named._jdf.queryExecution().executedPlan().toString()
        assert sorted(int(r.doc_id) for r in named.collect()) == list(range(0, 300, 7))
        alive = index.delete(ids).live()
        assert alive.count() == len(rows) - 43 and "hashpartitioning" not in alive._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# Neighbours


def brute_nearest(vectors, queries, k):
    def unit(v):
        ok = v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)
        return np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None

    out = set()
    for qid, q in queries:
        a, scored = unit(q), []
        for i, v in vectors:
            b = unit(v)
            s = 0.0 if a is None or b is None or len(a) != len(b) else min(1.0, max(0.0, float(a @ b)))
            scored.append((-round(s, 6), i))
        out |= {(qid, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("sent", [16 << 20, 0])
def test_nearest_equals_every_pair(spark, monkeypatch, sent):
    """With query blocks sent to all tasks and with a grid of both sides' blocks; ties, copies and vectors without a direction."""
    monkeypatch.setattr(N, "SENT_BYTES", sent)
    monkeypatch.setattr(N, "BLOCK", 50)
    monkeypatch.setattr(N, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(2)
    v = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(300)]
    v += [(i, [1.0] * 6) for i in range(300, 420)] + [(500, None), (501, []), (502, [0.0] * 6), (503, [float("nan")] * 6), (504, [None] + [1.0] * 5), (505, [1.0] * 4), (506, [float("inf")] + [1.0] * 5)]
    q = [(n, x) for n, (_, x) in enumerate(v[::17])] + [(100, None), (101, [1.0] * 4), (102, [1.0] * 6)]
    vectors = spark.createDataFrame([(*r, "x") for r in v], "vec_id long, embedding array<double>, score string").repartition(4)
    got = N.nearest(vectors, spark.createDataFrame(q, "qid int, qv array<double>"), 9)
    want = brute_nearest(v, q, 9)
    assert {(r.qid, r["rank"], r.vec_id, r.score + 0.0) for r in got.collect()} == {(a, b, c, s + 0.0) for a, b, c, s in want}
    assert N.nearest(vectors.limit(0), spark.createDataFrame(q, "qid int, qv array<double>"), 3).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan


def test_blocks_of_long_vectors_are_small(spark):
    """A block's bytes do not grow with the length of its vectors."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=1024)]) for i in range(600)] + [(600, None), (601, [None] * 1024), (602, [1.0])]
    blocks = N.packed(spark.createDataFrame(rows, "id long, v array<double>").coalesce(1), N.BLOCK, "b").collect()
    assert sorted(i for b in blocks for i in b.b_ids) == list(range(603)) and {i for b in blocks if not b.b_dim for i in b.b_ids} == {600, 601}
    assert max(len(b.b_vectors) for b in blocks) <= 2 * 8 * N.BLOCK * 64
    assert all(len(b.b_vectors) == 8 * b.b_dim * len(b.b_ids) for b in blocks)


# Sets


def brute_partners(left, right, k, also, extra):
    out = set()
    for lid, a in left:
        scored = []
        for rid, b in right:
            n = len(set(a) & set(b))
            if n:
                s = min(1.0, n * (0.78 / len(a) + 0.22 / max(1, min(len(b), 4 * len(a)))))
                scored.append((-round(min(1.0, s + (extra if (lid, rid) in also else 0)), 6), rid, n))
        out |= {(lid, rid, n, -s) for s, rid, n in sorted(scored)[:k]}
    return out


@pytest.mark.parametrize("most", [500_000, 0])
def test_partners_equal_every_pair(spark, monkeypatch, most):
    """With the asked terms sent to all tasks, and with both sides shuffled and common terms met in pieces."""
    from quarrylight.operators.verify import CITED, support_slope

    monkeypatch.setattr(O, "MOST_TERMS", most)
    monkeypatch.setattr(O, "PIECE", 40)
    monkeypatch.setattr(O, "SEED_POSTINGS", 20)
    r = random.Random(7)
    words, weights = [f"t{i}" for i in range(120)], [1 / (i + 1) for i in range(120)]
    sets = lambda n, sizes: [(i, sorted(set(r.choices(words, weights, k=r.choice(sizes))))) for i in range(n)]
    left, right = sets(40, [1, 4, 25]) + [(90, ["nowhere"]), (91, [])], [(f"S{i}", t) for i, t in sets(500, [1, 3, 20, 100])] + [("S900", [])]
    also = {(n, f"S{n * 3}") for n in range(0, 40, 2)} | {(3, "S9999")}
    found = O.best_partners(spark.createDataFrame(left, "lid int, terms array<string>"), spark.createDataFrame(right, "rid string, terms array<string>").repartition(3), 3, support_slope, spark.createDataFrame(sorted(also), "lid int, rid string"), CITED)
    assert {(x.lid, x.rid, x.both, x.score) for x in found.pairs.collect()} == brute_partners(left, right, 3, also, CITED)
    w = found.work.collect()[0]
    assert w.postings <= w.all_postings and w.scored < 40 * 500
