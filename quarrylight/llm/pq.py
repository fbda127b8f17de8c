"""Compression of vectors into codes by codebooks, trained with the filtering form of Lloyd's rounds.

A vector is cut into equal parts, each of which is coded by the number of its nearest codebook entry. Every partition builds
kd-trees over its parts once, in blocks of a bounded number of vectors, with the bounding box and the sum of each node, and
writes them into the shared folder. A round goes down the trees with the entries that can still be nearest anywhere in a
node's box: the entry nearest to the box's middle eliminates each that is no nearer even at the corner which favours it most.
Where one entry is left the node's cached sum and count are added at once; only leaves with several are looked at point by
point. All values are integers, so rounds are exact in any partitioning.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import saved

#: Parts of a vector, entries of a codebook, rounds of training, and what a component is multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block of trees and points of a leaf at most.
BLOCK, LEAF = 4096, 16
#: Components are below this as integers, so that no squared distance leaves 64 bits.
MOST = 1 << 27
#: Points whose distances to all entries are held at once.
CHUNK = 4096


def levels(n: int) -> int:
    """Levels below the root of the tree over ``n`` points; a level of 2^k nodes has node i over points i * n / 2^k up."""
    k = 0
    while n > LEAF << k:
        k += 1
    return k


def bounds(n: int, level: int) -> np.ndarray:
    """(nodes + 1,) where the nodes of a level begin and end."""
    return (np.arange((1 << level) + 1) * n) >> level


@dataclass
class Trees:
    """Trees of one block, one a part: ``order`` (parts, n), ``points`` (parts, n, d) in that order; of each level ``lo``, ``hi`` and ``sums`` (parts, nodes, d)."""

    order: np.ndarray
    points: np.ndarray
    lo: list[np.ndarray]
    hi: list[np.ndarray]
    sums: list[np.ndarray]


def build(vectors: np.ndarray, parts: int = PARTS) -> Trees:
    """Trees over the parts of (n, parts * d) integers: each node is cut at the median of its widest dimension."""
    n, d = len(vectors), vectors.shape[1] // parts
    points = np.ascontiguousarray(vectors.reshape(n, parts, d).transpose(1, 0, 2))
    order = np.tile(np.arange(n, dtype=np.int32), (parts, 1))
    deep, rows = levels(n), np.arange(parts)[:, None]
    for level in range(deep):
        cut = bounds(n, level)
        node = np.repeat(np.arange(1 << level), np.diff(cut))
        wide = (np.maximum.reduceat(points, cut[:-1], 1).astype(np.int64) - np.minimum.reduceat(points, cut[:-1], 1)).argmax(2)
        value = np.take_along_axis(points, wide[:, node][:, :, None], 2)[:, :, 0].astype(np.int64)
        at = np.argsort((node << 29) + value + MOST, 1, kind="stable")  # nodes stay where they are
        points, order = points[rows, at], order[rows, at]
    cut = bounds(n, deep)[:-1]
    lo, hi, sums = [np.minimum.reduceat(points, cut, 1)], [np.maximum.reduceat(points, cut, 1)], [np.add.reduceat(points, cut, 1, dtype=np.int64)]
    for _ in range(deep):
        lo.append(np.minimum(lo[-1][:, ::2], lo[-1][:, 1::2]))
        hi.append(np.maximum(hi[-1][:, ::2], hi[-1][:, 1::2]))
        sums.append(sums[-1][:, ::2] + sums[-1][:, 1::2])
    return Trees(order, points, lo[::-1], hi[::-1], sums[::-1])


def _square(a: np.ndarray) -> np.ndarray:
    return (a * a).sum(-1)


def _candidates(lo: np.ndarray, hi: np.ndarray, books: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``left`` (nodes, entries), the entries that are nearest somewhere in a node's box, and each node's entry nearest to its middle. ``books`` (nodes, entries, d)."""
    far = np.where(left, _square(2 * books - (lo + hi)[:, None]), np.iinfo(np.int64).max)
    star = far.argmin(1)  # the first of several
    best = books[np.arange(len(star)), star][:, None]
    corner = np.where(books > best, hi[:, None], lo[:, None])
    own, its = _square(corner - books), _square(corner - best)
    later = np.arange(books.shape[1])[None] > star[:, None]
    return left & ~((own > its) | ((own == its) & later)), star


def nearest(points: np.ndarray, book: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The nearest of the entries ``left`` (points, entries) to each point, the first of several."""
    out = np.empty(len(points), np.int64)
    for k in range(0, len(points), CHUNK):
        p = points[k : k + CHUNK].astype(np.int64)
        far = sum((p[:, j, None] - book[None, :, j]) ** 2 for j in range(book.shape[1])) if book.shape[1] else np.zeros((len(p), len(book)), np.int64)
        out[k : k + CHUNK] = np.where(left[k : k + CHUNK], far, np.iinfo(np.int64).max).argmin(1)
    return out


def walk(t: Trees, books: np.ndarray, assign: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, int]:
    """``counts`` (parts, entries), ``sums`` (parts, entries, d), the entry of each part of each vector (parts, n) if asked for, and how many points were compared one by one."""
    parts, n, d = t.points.shape
    entries, books = books.shape[1], books.astype(np.int64)
    counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, d), np.int64)
    codes = np.empty((parts, n), np.int64) if assign else None
    part, node, left, single = np.arange(parts), np.zeros(parts, np.int64), np.ones((parts, entries), bool), 0
    for level in range(len(t.lo)):
        cut = bounds(n, level)
        left, star = _candidates(t.lo[level][part, node].astype(np.int64), t.hi[level][part, node].astype(np.int64), books[part], left)
        done = left.sum(1) == 1
        p, k, e = part[done], node[done], star[done]
        np.add.at(counts, (p, e), cut[k + 1] - cut[k])
        np.add.at(sums, (p, e), t.sums[level][p, k])
        if assign:
            for a, b, z, x in zip(p, cut[k], cut[k + 1], e):
                codes[a, b:z] = x
        part, node, left = part[~done], node[~done], left[~done]
        if level + 1 < len(t.lo):
            part, node, left = np.repeat(part, 2), np.repeat(2 * node, 2) + np.tile([0, 1], len(node)), np.repeat(left, 2, 0)
    cut = bounds(n, len(t.lo) - 1)
    for q in np.unique(part):
        own = node[part == q]
        size = cut[own + 1] - cut[own]
        at = np.repeat(cut[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        found = nearest(t.points[q, at], books[q], np.repeat(left[part == q], size, 0))
        single += len(at)
        np.add.at(counts[q], found, 1)
        np.add.at(sums[q], found, t.points[q, at].astype(np.int64))
        if assign:
            codes[q, at] = found
    if assign:
        np.put_along_axis(codes, t.order.astype(np.int64), codes.copy(), 1)
    return counts, sums, codes, single


def errors(t: Trees, books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(n,) squared distances of the vectors to their entries, summed over the parts."""
    out = np.zeros(t.order.shape[1], np.int64)
    for q, order in enumerate(t.order):
        np.add.at(out, order, _square(t.points[q].astype(np.int64) - books[q][codes[q][order]]))
    return out


def finite(vector: str = "v"):
    """Not null, and no null or non-finite component."""
    v = F.col(vector)
    return v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))


def codable(width: int, vector: str = "v"):
    """Of the codebooks' length, and small enough for exact integers."""
    v = F.col(vector)
    return (F.size(v) == width) & ~F.coalesce(F.exists(v, lambda x: F.abs(x.cast("double")) >= MOST / SCALE), F.lit(True))


def _whole(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) floor(SCALE * component)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int32).reshape(-1, width)


def forest(rows: DataFrame, width: int, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """Of ``id``, ``label``, ``v``: a row per block with its ids, labels and trees."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        trees = build(np.concatenate([_whole(b.column(2), width) for b in held]), parts)
        whole = [trees.order, trees.points, *(np.concatenate(x, 1) for x in (trees.lo, trees.hi, trees.sums))]
        lists = [pa.LargeListArray.from_arrays(pa.array([0, t.num_rows], pa.int64()), t.column(k).combine_chunks()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*(x.cast(pa.list_(x.type.value_type)) for x in lists), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in whole)], names=["ids", "labels", "ord", "points", "lo", "hi", "sums"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                take = b.slice(0, block - n)
                held.append(take)
                n, b = n + take.num_rows, b.slice(take.num_rows)
                if n == block:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    kinds = dict(rows.dtypes)
    return rows.select("id", "label", "v").mapInArrow(run, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, ord binary, points binary, lo binary, hi binary, sums binary")


def _unpacked(b: pa.RecordBatch, width: int, parts: int):
    """The blocks of a batch of forest()."""
    d = width // parts
    for k in range(b.num_rows):
        ids, labels = b.column("ids")[k].values, b.column("labels")[k].values
        raw = {c: b.column(c)[k].as_buffer() for c in ("ord", "points", "lo", "hi", "sums")}
        n, deep = len(ids), levels(len(ids))
        cut = np.cumsum([1 << k for k in range(deep)])
        split = lambda c, kind: np.split(np.frombuffer(raw[c], kind).reshape(parts, -1, d), cut, 1)
        yield ids, labels, Trees(np.frombuffer(raw["ord"], np.int32).reshape(parts, n), np.frombuffer(raw["points"], np.int32).reshape(parts, n, d), split("lo", np.int32), split("hi", np.int32), split("sums", np.int64))


def first_entries(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """(parts, entries, d): the parts of the vectors of the smallest ids, ascending; fewer if there are fewer ids. Of rows that repeat an id the smallest vector counts; a null id is none."""
    ids = rows.where("id is not null").select("id").distinct().orderBy("id").limit(entries)
    own = rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()  # ``entries`` rows at most, both times
    whole = np.array([np.floor(SCALE * np.array(r.v, np.float64)) for r in own]).astype(np.int64).reshape(len(own), parts, width // parts)
    return whole.transpose(1, 0, 2)


def moved(trees: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """One round: each entry becomes the mean of its parts, rounded down; one that has none stays."""
    parts, entries, d = books.shape

    def run(batches):
        counts, sums = np.zeros((parts, entries, 1), np.int64), np.zeros((parts, entries, d), np.int64)
        for b in batches:
            for _, _, t in _unpacked(b, width, parts):
                n, s, _, _ = walk(t, books)
                counts[:, :, 0] += n
                sums += s
        every = np.concatenate([counts, sums], 2)
        some = np.broadcast_to(counts > 0, every.shape).ravel()
        place = np.flatnonzero(some)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(every.ravel()[place], pa.int64())], names=["place", "total"])

    found = trees.mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect()  # parts * entries * (d + 1) numbers at most
    every = np.zeros(parts * entries * (d + 1), np.int64)
    for r in found:
        every[r.place] = r.total
    every = every.reshape(parts, entries, d + 1)
    n = every[:, :, :1]
    return np.where(n > 0, every[:, :, 1:] // np.maximum(n, 1), books)


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_width(rows: DataFrame, parts: int = PARTS) -> int:
    """The length of the vectors that are coded: that of the smallest id's whose length is a multiple of ``parts``; 0 if there is none."""
    found = rows.where((F.size("v") > 0) & (F.size("v") % parts == 0)).select("id", F.size("v").alias("width")).orderBy(F.col("id").asc_nulls_last(), "width").take(1)
    return found[0].width if found else 0


def train(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame | None, np.ndarray]:
    """The kept rows (``id``, ``label``, ``v``), their forest (None if no vector can be coded) and the codebooks (parts, entries, d) as integers."""
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(finite())
    width = vector_width(rows, parts)
    own = rows.where(codable(width))
    books = first_entries(own, width, parts, entries) if width else np.zeros((parts, 0, 0), np.int64)
    if not books.shape[1]:
        return rows.withColumn("fits", F.lit(False)), None, books
    trees = saved(forest(own, width, parts), "forest")
    for _ in range(rounds):
        books = moved(trees, books, width)
    return rows.withColumn("fits", codable(width)), trees, books


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``id_col``, ``code``, ``error``, ``label_error``, ``codebooks_sha256``: a row per row of ``df`` whose vector is not null and has no null or non-finite component.

    ``code`` has two hexadecimal digits a part, ``error`` is the squared distance of the integers floor(256 * component) to
    the entries, ``label_error`` its sum over the rows of a label, nulls together. Ties go to the lower entry, repeated rows
    are rows. Vectors whose length is not that of the smallest id's (of those that can be cut into ``parts``), or with a
    component of 2^19 or more, have no code and no error (null), nor has any vector if no row has an id. No other column is
    read; an empty table gives an empty result.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part")
    rows, trees, books = train(df, id_col, vector_col, label_col, parts, entries, rounds)
    kinds, width = dict(rows.dtypes), books.shape[0] * books.shape[2]
    none = rows.where(~F.col("fits")).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))

    def run(batches):
        for b in batches:
            for ids, labels, t in _unpacked(b, width, parts):
                codes = walk(t, books, True)[2]
                text = [bytes(x).hex() for x in np.ascontiguousarray(codes.T.astype(np.uint8))]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(errors(t, books, codes), pa.int64())], names=["id", "label", "code", "error"])

    coded = trees.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long").union(none) if trees is not None else none
    coded = saved(coded, "codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))  # sent where there are few labels, else a label of many rows is split by the skew join
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def decode(codes: DataFrame, books: np.ndarray, code_col: str = "code", name: str = "approximate") -> DataFrame:
    """``codes`` with ``name``, the vector that each code stands for: the middle of its entries' cells, null for a null code. A column of that name is replaced."""
    def run(batches):
        for b in batches:
            rest = [c for c in b.schema.names if c != name]
            found = [None if c is None else ((books[np.arange(len(books)), np.frombuffer(bytes.fromhex(c), np.uint8)] + 0.5) / SCALE).ravel() for c in b.column(code_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(found, pa.list_(pa.float64()))], names=[*rest, name])

    kept = codes.drop(name)
    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{name}` array<double>"]))
