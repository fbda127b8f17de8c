"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results merged.

Distinct vectors are dealt over shards by hash; each shard's graph is built in one task and kept as flat arrays: the
vectors, each node's level, and its neighbours in one array per level of ``links`` slots a node, unused slots -1. Queries
travel in blocks to every shard; each search gives its shard's nearest vectors, and their rows are merged by exact distance.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import saved
from quarrylight.llm.embed_dedup import valid

LINKS = 12
BUILD = 80
SEARCH = 80
SHARD = 4096
QUERIES = 1024
SEED = 5


class Hnsw:
    """A graph over the rows of ``x``; bottom-level nodes have 2 * links slots and one of _bridge(), higher ones links."""

    def __init__(self, x: np.ndarray, links: int = LINKS, build: int = BUILD, seed: int = SEED):
        self.x = np.ascontiguousarray(x, np.float32)
        self.links, n = links, len(x)
        u = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(1 - u) / np.log(links)).astype(np.int32), 12)
        self.flat = [np.full((n, 2 * links if lv == 0 else links), -1, np.int32) for lv in range(int(self.level.max(initial=0)) + 1)]
        self.sq = np.einsum("ij,ij->i", self.x, self.x)
        self.entry, self._seen, self._mark = -1, np.zeros(n, np.int32), 0
        for i in range(n):
            self._insert(i, build)
        self._bridge(build)

    def _reach(self, start: int, reached: np.ndarray) -> None:
        """Marks what the bottom level reaches from a node."""
        at = np.array([start])
        while len(at):
            reached[at] = True
            at = np.unique(self.flat[0][at])
            at = at[at >= 0]
            at = at[~reached[at]]

    def _bridge(self, build: int) -> None:
        """Pruned links may leave a node that no other leads to, most of all among ties. Every node has one slot more on the bottom level, and a node that can't be reached takes that of a near one that can."""
        n = len(self.x)
        self.flat[0] = np.hstack([self.flat[0], np.full((n, 1), -1, np.int32)])
        if not n:
            return
        reached = np.zeros(n, bool)
        self._reach(self.entry, reached)
        for u in np.flatnonzero(~reached):
            if not reached[u]:
                near = [j for j in self.search(self.x[u], build) if reached[j] and self.flat[0][j, -1] < 0]
                self.flat[0][near[0] if near else np.flatnonzero(reached & (self.flat[0][:, -1] < 0))[0], -1] = u
                self._reach(u, reached)

    @classmethod
    def of(cls, x: np.ndarray, level: np.ndarray, flat: list[np.ndarray], entry: int, links: int) -> Hnsw:
        g = cls.__new__(cls)
        g.x, g.level, g.flat, g.entry, g.links = x, level, flat, entry, links
        g.sq = np.einsum("ij,ij->i", x, x)
        g._seen, g._mark = np.zeros(len(x), np.int32), 0
        return g

    def _far(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances less the query's own square."""
        return self.sq[nodes] - 2 * (self.x[nodes] @ q)

    def _layer(self, q: np.ndarray, start: list[int], width: int, lv: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes found from ``start`` on a level, nearest first."""
        self._mark += 1
        mark, seen, flat = self._mark, self._seen, self.flat[lv]
        at = np.array(start, np.int32)
        seen[at] = mark
        d = self._far(q, at)
        open_ = [(float(a), int(b)) for a, b in zip(d, at)]
        heapq.heapify(open_)
        best = [(-a, b) for a, b in open_]
        heapq.heapify(best)
        while open_:
            dist, node = heapq.heappop(open_)
            if len(best) >= width and dist > -best[0][0]:
                break
            near = flat[node]
            near = near[near >= 0]
            near = near[seen[near] != mark]
            if not len(near):
                continue
            seen[near] = mark
            d = self._far(q, near)
            if len(best) >= width:
                ok = d < -best[0][0]
                near, d = near[ok], d[ok]
            for a, b in zip(d.tolist(), near.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (-a, b))
                elif a < -best[0][0]:
                    heapq.heapreplace(best, (-a, b))
                else:
                    continue
                heapq.heappush(open_, (a, b))
        return sorted((-a, b) for a, b in best)

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions: nearest first, one is taken if it is nearer to the new node than to every one taken before; free slots go to the nearest of the rest."""
        nodes = np.array([b for _, b in found])
        vectors = self.x[nodes]
        between = self.sq[nodes][:, None] + self.sq[nodes][None, :] - 2 * vectors @ vectors.T
        base = np.array([a for a, _ in found])
        taken: list[int] = []
        rest: list[int] = []
        for k in range(len(found)):
            if len(taken) == most:
                break
            if not taken or (between[k, taken] > base[k]).all():
                taken.append(k)
            else:
                rest.append(k)
        return nodes[(taken + rest)[:most]].tolist()

    def _insert(self, i: int, build: int) -> None:
        q, top = self.x[i], int(self.level[i])
        if self.entry < 0:
            self.entry = i
            return
        start, high = [self.entry], int(self.level[self.entry])
        for lv in range(high, top, -1):
            start = [self._layer(q, start, 1, lv)[0][1]]
        for lv in range(min(top, high), -1, -1):
            found = self._layer(q, start, build, lv)
            true = [(a + float(self.sq[i]), b) for a, b in found]
            flat = self.flat[lv]
            own = self._spread(true, self.links)
            flat[i, : len(own)] = own
            for j in own:
                free = np.flatnonzero(flat[j] < 0)
                if len(free):
                    flat[j, free[0]] = i
                    continue
                near = np.append(flat[j], i)
                d = self._far(self.x[j], near) + float(self.sq[j])
                order = np.argsort(d, kind="stable")
                kept = self._spread([(float(d[k]), int(near[k])) for k in order], flat.shape[1])
                flat[j] = -1
                flat[j, : len(kept)] = kept
            start = [b for _, b in found]
        if top > high:
            self.entry = i

    def search(self, q: np.ndarray, width: int = SEARCH) -> list[int]:
        """The ``width`` nearest rows found, nearest first."""
        if self.entry < 0:
            return []
        q = np.asarray(q, np.float32)
        start = [self.entry]
        for lv in range(int(self.level[self.entry]), 0, -1):
            start = [self._layer(q, start, 1, lv)[0][1]]
        return [b for _, b in self._layer(q, list({*start, self.entry}), width, 0)]  # all nodes can be reached from the entry


def ranked(g: Hnsw, x: np.ndarray, scale: float, reps: np.ndarray, q: np.ndarray, k: int, width: int = SEARCH) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest nodes found (``x``: the original vectors, ``scale``: what the graph's were divided by) and their distances in double precision, ties to the smaller of ``reps``.

    As long as the farthest node found ties with the k-th, others that tie may have been left out, so the search goes on
    four times as wide, to the whole graph if need be. The float graph may order ties by its rounding: what differs by
    less than that counts as tied here.
    """
    width = max(width, k)
    while True:
        nodes = np.array(g.search(q / scale, width), np.int64)
        d = np.sqrt(((x[nodes] - q) ** 2).sum(1))
        border = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
        if len(nodes) < width or width >= len(x) or d.max() > border * (1 + 1e-5):
            order = np.lexsort((reps[nodes], d))[:k]
            return nodes[order], d[order]
        width *= 4


INDEX = "shard int, dim int, n int, vectors binary, classes array<string>, reps array<{}>, level binary, flat array<binary>, entry int, links int"


def build_index(classes: DataFrame, shards: int, links: int = LINKS, build: int = BUILD) -> DataFrame:
    """One row (INDEX) per shard and vector length from rows of ``cls``, ``rep``, ``v``: the graph as flat arrays."""
    schema = INDEX.format(classes.schema["rep"].dataType.simpleString())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cls")
        x = np.stack([np.array(v, np.float64) for v in pdf["v"]])
        scale = np.abs(x).max() or 1.0  # float32 must hold the squares
        g = Hnsw((x / scale).astype(np.float32), links, build)
        return pd.DataFrame([{
            "shard": pdf["shard"].iat[0], "dim": x.shape[1], "n": len(x), "vectors": x.astype("<f8").tobytes(), "classes": pdf["cls"].tolist(), "reps": pdf["rep"].tolist(),
            "level": g.level.astype("<i4").tobytes(), "flat": [f.astype("<i4").tobytes() for f in g.flat], "entry": g.entry, "links": links,
        }])

    dealt = classes.select(F.pmod(F.xxhash64("cls"), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"), "cls", "rep", "v")
    return dealt.groupBy("shard", "dim").applyInPandas(run, schema)


def _load(row: dict) -> tuple[Hnsw, np.ndarray, float]:
    x = np.frombuffer(row["vectors"], "<f8").reshape(row["n"], row["dim"])
    scale = float(np.abs(x).max()) or 1.0
    level = np.frombuffer(row["level"], "<i4")
    flat = [np.frombuffer(f, "<i4").reshape(row["n"], -1) for f in row["flat"]]
    return Hnsw.of((x / scale).astype(np.float32), level, flat, row["entry"], row["links"]), x, scale


def nearest(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, queries: int = QUERIES, links: int = LINKS, build: int = BUILD, search: int = SEARCH) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each query (a row for which the condition ``is_query`` holds) the ``k`` nearest other rows found, by Euclidean distance in double precision, ties to the smaller id.

    Every row is indexed: equal vectors are one node, whose k + 1 smallest ids are kept with it, as no result can show
    more. Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null
    id; vectors of different lengths are never compared. A row that repeats an id with its vector counts once. The score
    is the exact distance of the original vectors. An empty table gives an empty result.

    Ties are exact however many vectors tie: a row of the result belongs to one of the k + 1 classes that come first by
    distance and smallest id, as each class before its own has a row before it; shards and the merge both cut in that order.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), is_query.alias("q")).where(valid() & F.col("id").isNotNull())
    rows = rows.select("id", "v", "q", F.concat_ws(":", F.xxhash64("v"), F.xxhash64(F.lit(SEED), "v")).alias("cls"))
    classes = saved(rows.groupBy("cls").agg(F.first("v").alias("v"), F.min("id").alias("rep")), "vectors")
    first = Window.partitionBy("cls").orderBy("id")
    ids = rows.select("cls", "id").withColumn("nth", F.rank().over(first)).where(F.col("nth") <= k + 1).distinct()
    members = saved(ids.groupBy("cls").agg(F.sort_array(F.collect_list("id")).alias("ids")), "members")

    shards = max(1, -(-classes.count() // shard))
    index = saved(build_index(classes, shards, links, build), "hnsw_index")

    # Query blocks: one row holds the vectors of up to about ``queries`` distinct query vectors of a length.
    asked = saved(rows.where("q").select("id", "cls", "v").distinct(), "queries")
    unique = asked.groupBy("cls").agg(F.first("v").alias("v")).withColumn("dim", F.size("v"))
    per_dim = unique.groupBy("dim").agg(F.ceil(F.count("*") / queries).cast("int").alias("blocks"))
    in_blocks = unique.join(per_dim, "dim").withColumn("block", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")).cast("int"))
    at_shards = index.select("shard", "dim").join(per_dim, "dim").select("shard", "dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    left = at_shards.join(index, ["shard", "dim"])
    right = in_blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("shard", "dim", "block", "cls", "v")

    def run(graphs: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = {"asked": [], "cls": [], "rep": [], "score": []}
        if len(graphs) and len(ask):
            row = graphs.iloc[0].to_dict()
            g, x, scale = _load(row)
            reps = np.array(row["reps"])
            for c, v in zip(ask["cls"], ask["v"]):
                for j, d in zip(*ranked(g, x, scale, reps, np.array(v, np.float64), k + 1, search)):
                    out["asked"].append(c)
                    out["cls"].append(row["classes"][j])
                    out["rep"].append(row["reps"][j])
                    out["score"].append(float(d))
        return pd.DataFrame(out).astype({"score": "float64"})

    found = left.groupBy("shard", "dim", "block").cogroup(right.groupBy("shard", "dim", "block")).applyInPandas(run, f"asked string, cls string, rep {kind}, score double")
    nearest_first = Window.partitionBy("asked").orderBy("score", "rep")
    near = saved(found.withColumn("nth", F.row_number().over(nearest_first)).where(F.col("nth") <= k + 1).select("asked", "cls", "score"), "near_classes")
    pairs = asked.select(F.col("id").alias("query_id"), F.col("cls").alias("asked")).join(near, "asked").join(members, "cls")
    pairs = pairs.select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id != vec_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select(F.col("query_id").cast(kind).alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").cast(kind).alias("vec_id"), "score")
