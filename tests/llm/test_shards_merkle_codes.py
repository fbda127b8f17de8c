"""Sharding, the Merkle manifest and vector codes against plain Python on small tables with every awkward case."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import merkle, pq, queries, sharding

LONG = "Of the Wind. " * 9000
TEXTS = [(1, None), (2, ""), (3, "Hello world, été 123!"), (4, LONG), (5, "Twice"), (5, "Twice"), (5, "Other"), (None, "null id"), (None, "null id"), (None, None), (-6, "ÀÉ AZ")]


# Sharding


def brute_times(doc_id, weights):
    key = "-" if doc_id is None else f"{len(str(doc_id))}:{doc_id}"
    return [-math.log((int(hashlib.md5(f"{n}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w if w else math.inf for n, w in enumerate(weights)]


def brute_shard(doc_id, weights):
    t = brute_times(doc_id, weights)
    return t.index(min(t))


@pytest.fixture(scope="module")
def texts(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame([(i, t, 3, "x", 1, 2.0) for i, t in TEXTS], "doc_id long, text string, shard int, slot string, number long, size double")


def test_shards_of_awkward_rows(spark, texts):
    got = sharding.digest(texts, [1.0] * 8, [1.0] * 9)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = got.collect()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", brute_shard(i, [1] * 8), brute_shard(i, [1] * 9)) for i, t in TEXTS]
    assert sorted((tuple(r)[:5] + (r.grown_shard,) for r in rows), key=repr) == sorted(want, key=repr)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.digest(texts.limit(0), [1.0] * 8, [1.0] * 9).count() == 0


def test_weights_and_moves(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    old, grown, gone = [1.0, 2.0, 0.0, 1.0], [1.0, 2.0, 0.0, 1.0, 4.0], [1.0, 0.0, 0.0, 1.0]
    n = {r["shard"]: r["count"] for r in sharding.assigned(df, ["doc_id"], old).groupBy("shard").count().collect()}
    assert set(n) == {0, 1, 3} and abs(n[1] / 20000 - 0.5) < 0.02 and abs(n[0] / n[3] - 1) < 0.1
    moved = sharding.moves(df, ["doc_id"], old, grown).collect()
    assert {r.grown_shard for r in moved if r.shard != r.grown_shard} == {4} and sum(r.rows for r in moved) == 20000
    assert abs(sum(r.rows for r in moved if r.grown_shard == 4) / 20000 - 0.5) < 0.02
    assert {r.shard for r in sharding.moves(df, ["doc_id"], old, gone).collect() if r.shard != r.grown_shard} == {1}
    heavier = sharding.moves(df, ["doc_id"], old, [1.0, 2.0, 0.0, 2.0]).collect()
    assert {r.grown_shard for r in heavier if r.shard != r.grown_shard} == {3}
    assert {r.doc_id: r.shard for r in sharding.assigned(df.limit(50), ["doc_id"], old).collect()} == {i: brute_shard(i, old) for i in range(50)}
    for bad in ([], [0.0], [-1.0, 1.0], [math.inf]):
        with pytest.raises(ValueError):
            sharding.assigned(df, ["doc_id"], bad)


def test_keys_of_several_columns_do_not_run_together(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "abc"), ("1:a", None), ("-", "2:bc")], "a string, b string").select(sharding.key_text("a", "b").alias("k"))
    assert len({r.k for r in df.collect()}) == 5


def test_slots_of_a_hot_shard_are_cut_into_ranges(spark):
    df = spark.range(30000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text")).repartition(4)
    rows = sharding.digest(df, [1.0] * 8, [1.0] * 9)
    assert rows.agg(F.min("slot"), F.max("slot"), F.countDistinct("slot"), F.countDistinct("shard")).collect()[0] == (0, 29999, 30000, 1)
    ordered = sharding.slotted(sharding.saved(df.select(F.lit(0).alias("shard")), "t"), [])
    sizes = [len(p) for p in ordered.rdd.glom().collect() if p]
    assert len(sizes) > 1 and max(sizes) < 20000


def test_sharding_is_native(spark, texts):
    plan = sharding.digest(texts, [1.0] * 8, [1.0] * 9)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_written_shards(spark, texts, tmp_path):
    path = sharding.write_shards(texts, ["doc_id"], [1.0] * 3, f"file://{tmp_path}/out", files=2)
    got = spark.read.parquet(path)
    assert sorted(((r.doc_id, r.text, r.shard) for r in got.collect()), key=repr) == sorted(((i, t, brute_shard(i, [1] * 3)) for i, t in TEXTS), key=repr)
    assert {"slot", "number", "size"} <= set(got.columns)


# Merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(digests, fanout):
    """The root, and each leaf's siblings by level as (place, run)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        runs = [level[k : k + fanout] for k in range(0, len(level), fanout)]
        for path, k in zip(paths, at):
            path.append((k % fanout, runs[k // fanout]))
        at, level = [k // fanout for k in at], [h(*r) for r in runs]
    return level[0], paths


def brute_manifest(rows, fanout=16):
    """rows: doc_id, source, lang, n_chars, text."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0], brute_leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {g: brute_tree([x[2] for x in sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2]))], fanout) for g in names}
    root, outer = brute_tree([inner[g][0] for g in names], fanout)
    out = []
    for n, g in enumerate(names):
        for (_, doc_id, leaf, row), path in zip(sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2])), inner[g][1]):
            path = path + outer[n]
            low = None if row[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
            now = brute_leaf((*row[:4], low)) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 else leaf
            own = now
            for at, run in path:
                own = h(*run[:at], own, *run[at + 1 :])
            out.append((doc_id, leaf, inner[g][0], root, h(*(x for at, run in path for k, x in enumerate(run) if k != at)), own, own == root))
    return out


def merkle_rows(spark, rows, fanout=16):
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, grp int, path string").repartition(3)
    got = merkle.tamper_check(df, queries.LEAF, {"text": F.translate("text", queries.UPPER, queries.LOWER)}, F.crc32(F.col("doc_id").cast("string")) % 5 == 0, fanout=fanout)
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("sizes, fanout", [((1,), 16), ((16, 1), 16), ((17, 33, 1, 2), 3), ((90, 5, 1, 1, 1, 1, 1), 4)])
def test_manifest(spark, sizes, fanout):
    rows = [(1000 * g + i, [None, "é", "B", "a", "~", "", "z"][g], ["en", None][i % 2], i, ["Text A", None, "", "all low", LONG][i % 5]) for g, n in enumerate(sizes) for i in range(n)]
    assert merkle_rows(spark, rows, fanout) == sorted(brute_manifest(rows, fanout), key=repr)


def test_manifest_of_awkward_rows(spark):
    rows = [(i, "s", None, None, t) for i, t in TEXTS] + [(i, None, "en", 5, "A" * i) for i in range(40)] + [(7, "t", "x", 1, "Same")] * 40 + [(None, "u", None, None, None)] * 3
    got = merkle_rows(spark, rows)
    assert got == sorted(brute_manifest(rows), key=repr)
    assert {r[6] for r in got} == {True, False} and len({r[3] for r in got}) == 1
    assert merkle_rows(spark, rows[:1]) == brute_manifest(rows[:1]) and merkle_rows(spark, []) == []


def test_manifest_root_and_paths(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], f"T{i}") for i in range(50)], "doc_id long, source string, text string")
    m = merkle.build(df, merkle.leaf_digest(F.col("doc_id"), F.col("text")))
    assert m.root() == merkle.build(df.repartition(5), merkle.leaf_digest(F.col("doc_id"), F.col("text"))).root() != merkle.build(df.where("doc_id > 0"), merkle.leaf_digest(F.col("doc_id"), F.col("text"))).root()
    paths = merkle.proofs(m)
    assert paths.where(merkle.fold(F.col("leaf"), F.col("path")) == m.root()).count() == 50 and paths.where(merkle.fold(F.lit("0" * 64), F.col("path")) == m.root()).count() == 0
    assert {(r["at"], len(r["run"])) for p in paths.collect() for r in p.path[-1:]} == {(0, 2), (1, 2)}
    assert merkle.build(df.limit(0), merkle.leaf_digest(F.col("doc_id"))).root() is None


# Codes


def brute_codes(vectors, books):
    """(parts, n) the first nearest entry."""
    parts = np.array(vectors).reshape(len(vectors), books.shape[0], -1)
    far = ((parts[:, :, None] - books[None]) ** 2).sum(3)
    return far.argmin(2).T, far.min(2).sum(1)


def brute_books(vectors, first, parts, rounds):
    books = np.array(first).reshape(len(first), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        codes, _ = brute_codes(vectors, books)
        new = books.copy()
        for q in range(parts):
            x = np.array(vectors).reshape(len(vectors), parts, -1)[:, q]
            for e in range(books.shape[1]):
                own = x[codes[q] == e]
                if len(own):
                    new[q, e] = own.sum(0) // len(own)
        books = new
    return books


@pytest.mark.parametrize("n, d, entries, spread", [(1, 1, 3, 4), (17, 2, 5, 2), (700, 3, 9, 3), (3000, 4, 64, 200), (500, 2, 64, 1)])
def test_walk_equals_every_distance(n, d, entries, spread):
    """Small values make ties of entries, of distances and of whole parts."""
    rng = np.random.default_rng(n)
    vectors, books = rng.integers(-spread, spread + 1, (n, 4 * d)).astype(np.int32), rng.integers(-spread, spread + 1, (4, entries, d))
    books[:, -1] = books[:, 0]
    t = pq.build(vectors, 4)
    counts, sums, codes, single = pq.walk(t, books, True)
    want, far = brute_codes(vectors.astype(np.int64), books)
    assert (codes == want).all() and (pq.errors(t, books, codes) == far).all() and counts.sum() == 4 * n and single <= 4 * n
    for q in range(4):
        assert (counts[q] == np.bincount(want[q], minlength=entries)).all()
        for e in range(entries):
            assert (sums[q, e] == vectors.reshape(n, 4, d)[want[q] == e, q].sum(0)).all()


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(5)
    middles = rng.integers(-1000, 1000, (8, 8))
    vectors = (middles[rng.integers(0, 8, 4000)] + rng.integers(-3, 4, (4000, 8))).astype(np.int32)
    *_, single = pq.walk(pq.build(vectors, 2), middles.reshape(8, 2, 4).transpose(1, 0, 2))
    assert single < 800  # of 8000 parts


def floats(whole):
    return [float(x) / 256 for x in whole]


def test_compress_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    whole = rng.integers(-300, 300, (400, 32))
    whole[100:240] = whole[100]  # one vector of a third of all rows
    rows = [(int(i), floats(v), [None, 1, 2][i % 3]) for i, v in enumerate(whole)]
    rows += [(7, rows[7][1], 5), (7, rows[7][1], 5), (None, floats(whole[3]), 1), (500, None, 1), (501, [float("nan")] * 32, 1), (502, [float("inf")] + [0.0] * 31, 1), (503, [None] + [0.0] * 31, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, id string, code int").repartition(5)
    kept = [r for r in rows if r[0] is None or r[0] < 500]
    vectors = np.array([[math.floor(256 * x) for x in r[1]] for r in kept])
    books = brute_books(vectors, whole[:64], 16, 2)
    codes, far = brute_codes(vectors, books)
    total = collections.Counter()
    for r, e in zip(kept, far):
        total[r[2]] += int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    want = sorted(((r[0], "".join(f"{x:02x}" for x in codes[:, k]), int(far[k]), total[r[2]], digest) for k, r in enumerate(kept)), key=repr)
    got = pq.compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    _, trees, trained = pq.train(df)
    assert (trained == books).all() and trees.count() > 1
    back = {r.vec_id: r.approximate for r in pq.decode(got, books).where("vec_id is not null").collect()}
    assert all(abs(x - y) < 1.5 for x, y in zip(back[50], rows[50][1]))


def test_compress_awkward(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert pq.compress(spark.createDataFrame([], kind)).count() == 0
    assert pq.compress(spark.createDataFrame([(1, None, 1)], kind)).count() == 0
    rows = [(1, [0.5] * 5, 1), (2, [-0.001] * 16, 1), (3, [2.0] * 32, 1), (4, [], None), (5, [3e38] * 16, None), (6, [0.5] * 16, None)]
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in pq.compress(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: (None, None, 0), 2: ("00" * 16, 0, 0), 3: (None, None, 0), 4: (None, None, 0), 5: (None, None, 0), 6: ("01" * 16, 0, 0)}
    none = pq.compress(spark.createDataFrame([(None, [1.0] * 16, 1)], kind)).collect()
    assert [tuple(r)[:4] for r in none] == [(None, None, None, None)]


@pytest.mark.parametrize("name, columns", [("op11_rendezvous", "doc_id size text_crc32 law shard slot grown_shard"), ("op12_merkle", "doc_id leaf subroot root proof_sha256 folded_root verified"), ("op13_filtering_lloyd", "vec_id code error label_error codebooks_sha256")])
def test_contract_columns(spark, name, columns):
    assert queries.queries()[name](spark, "/root/testdata/sf0.001").columns == columns.split()
