"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine verification, components.

Equal vectors of a label are one *class*. Each class gets a key of some signs in each table; classes of one label that
share a key of a table meet in a bucket. Buckets are cut into blocks of at most about ``BLOCK`` classes and compared block
against block by the classes' signatures, all their signs, which are all that travels once a table. Each class also has a
home block of its label; where a bucket shows a pair that agrees in enough signs, the two go into the table of rows of the
pair of their home blocks. Those rows get their vectors, once for each pair of home blocks however many tables showed it, and
the cosines of a block against another are one matrix product in double precision, from which only each class's number of
links and what connects the blocks leave the task, never the pairs. A pair of classes has one pair of home blocks, so it
counts once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import saved
from quarrylight.llm.components import components

COSINE = 0.93
#: Bits of a key at least and at most; between them as many as leave about FILL vectors of the largest label a key.
BITS = 10
MOST_BITS = 24
FILL = 64
#: Probability at most that a pair at the threshold shares no key; it gives the number of tables.
MISS = 0.0004
BLOCK = 512
#: Standard deviations by which two signatures may agree less than a pair at the threshold does on average.
SIGMAS = 5.5
SEED = 11


def layout(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """Bits of a key and number of tables for labels of up to ``n`` vectors. Two vectors at an angle agree in a sign with probability 1 - angle / pi: 0.880 at 0.93, so in one of 24 keys of 10 bits with 0.9996."""
    bits = min(MOST_BITS, max(BITS, math.ceil(math.log2(max(1, n) / FILL))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-agree)))


def planes(dim: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """(dim, tables * bits) normal vectors, the same on every machine."""
    return np.random.default_rng([seed, dim]).normal(size=(dim, tables * bits))


def keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(vectors, tables) int32."""
    signs = (x @ planes(x.shape[1], bits, tables) > 0).reshape(len(x), tables, bits)
    return (signs @ (1 << np.arange(bits))).astype("<i4")


def valid(vector: str = "v"):
    """Not null, not empty, no null or non-finite component, not all zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _keyed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """``cls``, ``label``, ``rep``, ``n``, ``dim``, ``vec`` (doubles, as bytes), ``sig`` (keys, as bytes)."""

    def run(batches):
        for b in batches:
            vectors = [np.array(v, np.float64) for v in b.column(4).to_pylist()]
            sig: list[bytes] = [b""] * len(vectors)
            for dim in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == dim]
                for i, row in zip(at, keys(np.stack([vectors[i] for i in at]), bits, tables)):
                    sig[i] = row.tobytes()
            cols = [b.column(k) for k in range(4)] + [pa.array([len(v) for v in vectors], pa.int32()), pa.array([v.astype("<f8").tobytes() for v in vectors], pa.binary()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["cls", "label", "rep", "n", "dim", "vec", "sig"])

    kinds = dict(classes.dtypes)
    return classes.mapInArrow(run, f"cls {kinds['cls']}, label {kinds['label']}, rep {kinds['rep']}, n long, dim int, vec binary, sig binary")


def least_agreement(bits: int, cosine: float = COSINE) -> int:
    """Signs of ``bits`` in which two vectors at ``cosine`` agree, less SIGMAS standard deviations."""
    p = 1 - math.acos(cosine) / math.pi
    return math.floor(bits * p - SIGMAS * math.sqrt(bits * p * (1 - p)))


def _near(sig: np.ndarray, left: np.ndarray, right: np.ndarray, bits: int, least: int) -> np.ndarray:
    """(left, right) which pairs of signatures (rows, tables) agree in ``least`` signs or more."""
    wide = ((sig[:, :, None] >> np.arange(bits)) & 1).astype(np.float32).reshape(len(sig), -1) * 2 - 1
    return (wide[left] @ wide[right].T + wide.shape[1]) / 2 >= least


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches by the edges i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(apart: bool, first: np.ndarray, vec: np.ndarray, n: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of one pair of blocks (``apart``: ``first`` tells them apart; else one block against itself): each row's links, copies counted, and the first row that it reaches here."""
    x = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    left = np.flatnonzero(first) if apart else np.arange(len(x))
    right = np.flatnonzero(~first) if apart else left
    links, root = np.zeros(len(x), np.int64), np.arange(len(x))
    if not len(left) or not len(right):
        return links, root
    link = x[left] @ x[right].T >= cosine
    if not apart:
        np.fill_diagonal(link, False)
    if link.any():
        a, b = np.nonzero(link)
        a, b = left[a], right[b]
        np.add.at(links, a, n[b])
        if apart:
            np.add.at(links, b, n[a])
        root = _local_roots(len(x), a, b)
    return links, root


def _groups(batches, columns: list[str]):
    """The groups of equal values in ``columns`` of batches sorted by them, as tables: a group may go over several batches, a batch may hold thousands."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        key = np.stack([t.column(c).to_numpy() for c in columns])
        cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        starts = np.concatenate([[0], cut])
        t = t.combine_chunks()
        for a, z in zip(starts[:-1], starts[1:]):
            yield t.slice(a, z - a)
        rest = t.slice(starts[-1]) if t.num_rows else None
    if rest is not None and rest.num_rows:
        yield rest


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, bits: int | None = None, tables: int | None = None, block: int = BLOCK) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id``, ``kept``: one row per row of ``df``.

    Two vectors are linked if their labels are equal and not null and their cosine is ``cosine`` or more; vectors of
    different lengths never are, nor those that are null, empty, zero or hold null or non-finite components. Equal vectors
    of a label are linked with each other. A row that repeats an id with its vector counts as another vector; rows with a
    null id have no links and are kept. No other column is read; an empty table gives an empty result. ``bits`` and
    ``tables`` follow the largest label's rows (layout()) unless they are given, so that buckets stay small as labels grow.
    """
    if bits is None or tables is None:
        n = df.where(F.col(label_col).isNotNull()).groupBy(label_col).count().agg(F.max("count")).collect()[0][0] or 0
        chosen = layout(n, cosine)
        bits, tables = bits or chosen[0], tables or chosen[1]
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    ok = valid() & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = rows.select("id", "label", "v", F.when(ok, F.concat_ws(":", F.xxhash64("label", "v"), F.xxhash64(F.lit(SEED), "v", "label"))).alias("cls"))
    classes = rows.where("cls is not null").groupBy("cls").agg(F.first("label").alias("label"), F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    keyed = saved(_keyed(classes, bits, tables), "keyed")

    # 1. Buckets are compared by signatures alone, block against block; what is left are rows of the pairs of home blocks that hold a near pair.
    homes = keyed.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("homes"))
    light = keyed.join(homes, ["label", "dim"]).select("rep", "label", "dim", "sig", F.pmod(F.xxhash64("rep"), F.col("homes")).cast("int").alias("home"))
    met = light.select("rep", "home", "sig", F.xxhash64("label", "dim").alias("kind"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.xxhash64("label", "dim", t, F.substring(F.col("sig"), t * 4 + 1, F.lit(4))))).alias("t", "bucket"))
    bucket = ["t", "bucket"]
    sizes = met.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = (
        met.join(sizes, bucket)
        .withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(*bucket, "rep", "home", "kind", "sig", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    kind = dict(keyed.dtypes)["rep"]
    group, least = ["t", "bucket", "i", "j"], least_agreement(bits * tables, cosine)

    def candidates(batches):
        for g in _groups(batches, group):
            i, j, home, kinds = g.column("i")[0].as_py(), g.column("j")[0].as_py(), g.column("home").to_numpy(), g.column("kind").to_numpy()
            sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), "<i4").reshape(g.num_rows, -1)
            first = g.column("block").to_numpy() == i
            left = np.flatnonzero(first) if i != j else np.arange(g.num_rows)
            right = np.flatnonzero(~first) if i != j else left
            if not len(left) or not len(right):
                continue
            near = _near(sig, left, right, bits, least) & (kinds[left][:, None] == kinds[right][None])
            if i == j:
                np.fill_diagonal(near, False)
            a, b = np.nonzero(near)
            a, b = left[a], right[b]
            low, high = np.minimum(home[a], home[b]), np.maximum(home[a], home[b])
            each = np.unique(np.concatenate([np.stack([a, low, high]), np.stack([b, low, high])], 1), axis=1)
            if each.shape[1]:
                yield pa.RecordBatch.from_arrays([g.column("rep").take(pa.array(each[0])).combine_chunks(), pa.array(each[1].astype(np.int32)), pa.array(each[2].astype(np.int32))], names=["rep", "low", "high"])

    sorted_ = dealt.repartition(*group).sortWithinPartitions(*group)
    near = sorted_.mapInArrow(candidates, f"rep {kind}, low int, high int").distinct()

    # 2. Each pair of home blocks gets the vectors of those rows, once, and is compared exactly.
    pair = ["place", "low", "high"]
    vectors = near.join(keyed.select("rep", "n", "label", "dim", "vec"), "rep").join(light.select("rep", "home"), "rep").withColumn("place", F.xxhash64("label", "dim"))

    def compare(batches):
        for g in _groups(batches, pair):
            labels, dims = g.column("label").to_pylist(), g.column("dim").to_pylist()
            if len(set(labels)) > 1 or len(set(dims)) > 1:  # two labels with one hash
                parts = [g.filter(pa.array([x == d for x in zip(labels, dims)])) for d in sorted(set(zip(labels, dims)), key=str)]
            else:
                parts = [g]
            for p in parts:
                if p.num_rows < 2:
                    continue
                rep, i, j = p.column("rep"), p.column("low")[0].as_py(), p.column("high")[0].as_py()
                vec = np.frombuffer(b"".join(p.column("vec").to_pylist()), "<f8").reshape(p.num_rows, -1)
                links, root = _compare(i != j, p.column("home").to_numpy() == i, vec, p.column("n").to_numpy(), cosine)
                hit = np.flatnonzero(links)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([rep.take(pa.array(hit)).combine_chunks(), pa.array(links[hit]), rep.take(pa.array(root[hit])).combine_chunks()], names=["rep", "links", "root"])

    exact = vectors.repartition(*pair).sortWithinPartitions(*pair)
    found = saved(exact.mapInArrow(compare, f"rep {kind}, links long, root {kind}"), "found")

    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select("rep", "root"), "rep", "root")
    named = keyed.select("cls", "rep", "n").join(counts, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    named = saved(named.select("cls", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "named")
    out = rows.select("id", "cls").join(named, "cls", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))
