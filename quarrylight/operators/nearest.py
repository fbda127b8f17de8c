"""Exact nearest neighbours by cosine, block against block.

Vectors and query vectors are packed into matrices, one row a block. A pair of blocks is one matrix product, of which only the
k best of each query leave the task; the few that are left of each block are merged. Query blocks go to all tasks while they
are small; beyond that, blocks of both sides meet in the cells of a grid, so that no task holds more than two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.session import ship
from quarrylight.shared import saved

#: Vectors and queries of a block, the length over which vectors make smaller blocks, bytes of query vectors that are sent to all tasks, rows of the grid.
BLOCK, QUERY_BLOCK, LONG, SENT_BYTES, GRID = 2048, 512, 64, 16 << 20, 64
DECIMALS = 6


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, d) vectors of length 1; all 0, and its length told as 0, where a vector is empty, zero or not finite."""
    with np.errstate(invalid="ignore", over="ignore"):
        n = np.sqrt((x * x).sum(1))
        good = np.isfinite(n) & (n > 0)
        return np.where(good[:, None], x / np.where(good, n, 1)[:, None], 0.0), good


def packed(df: DataFrame, block: int, name: str) -> DataFrame:
    """Of two columns, id and vector: ``{name}`` (the block's number), ``{name}_ids``, ``{name}_dim``, ``{name}_vectors`` (unit vectors as bytes). Vectors of one length share blocks; those without a direction are in blocks of length 0."""
    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        first, n = TaskContext.get().partitionId() << 32, 0

        def out(dim):
            nonlocal n
            ids, rows = held.pop(dim)
            n += 1
            whole = np.concatenate(rows) if dim else np.zeros((0, 0))
            values = pa.concat_arrays(ids)
            lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays([pa.array([first + n], pa.int64()), lists, pa.array([dim], pa.int32()), pa.array([whole.astype("<f8").tobytes()], pa.binary())], names=[name, f"{name}_ids", f"{name}_dim", f"{name}_vectors"])

        for b in batches:
            lists = b.column(1)
            dims = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values, starts = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.cumsum(dims) - dims  # numbers, no Python objects; nulls are NaN
            for d in np.unique(dims):
                rows_of, most = np.flatnonzero(dims == d), max(1, block * LONG // max(LONG, int(d)))
                for k in range(0, len(rows_of), most):
                    at = rows_of[k : k + most]
                    unit, good = _unit(values[starts[at][:, None] + np.arange(d)])
                    for dim, own, rows in ((int(d), at[good], unit[good]), (0, at[~good], None)):
                        if not len(own):
                            continue
                        ids, kept = held.setdefault(dim, ([], []))
                        ids.append(b.column(0).take(pa.array(own)))
                        if rows is not None:
                            kept.append(rows)
                        if sum(map(len, ids)) >= (most if dim else block):
                            yield out(dim)
        for dim in list(held):
            yield out(dim)

    kind = df.dtypes[0][1]
    return df.mapInArrow(run, f"{name} long, {name}_ids array<{kind}>, {name}_dim int, {name}_vectors binary")


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` largest of ``scores``, the first ones of those that tie with the last."""
    if len(scores) <= k:
        return np.argsort(-scores, kind="stable")
    last = np.partition(scores, len(scores) - k)[len(scores) - k]
    over = np.flatnonzero(scores > last)
    at = np.concatenate([over, np.flatnonzero(scores == last)[: k - len(over)]])
    return at[np.argsort(-scores[at], kind="stable")]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``qid``, ``rank``, ``vec_id``, ``score``: for each query (``qid``, ``qv``) the ``k`` rows of ``vectors`` with the largest cosine, clamped to 0 to 1 and rounded to six decimals, ties to the smaller id.

    Every row counts; vectors without a direction (null, empty, zero, a null or non-finite component) and those of another
    length than the query's have a score of 0. Repeated ids are rows each. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    q = saved(packed(queries.select("qid", "qv"), QUERY_BLOCK, "q"), "query_blocks")
    blocks = packed(v, BLOCK, "b")
    size = q.agg(F.coalesce(F.sum(F.length("q_vectors") + 8 * F.size("q_ids")), F.lit(0))).collect()[0][0]
    if size <= SENT_BYTES:
        pairs = blocks.crossJoin(F.broadcast(q))  # blocks, not rows
    else:
        blocks = saved(blocks, "vector_blocks")
        left = blocks.withColumn("row", F.pmod(F.xxhash64("b"), F.lit(GRID))).crossJoin(F.broadcast(q.select("q")))  # numbers of blocks
        right = q.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))))
        pairs = left.join(right, ["row", "q"])
    kinds = dict(v.dtypes), dict(queries.dtypes)

    def compare(batches):
        for b in batches:
            for r in range(b.num_rows):
                ids, qids = b.column("b_ids")[r].values, b.column("q_ids")[r].values
                dim, qdim = b.column("b_dim")[r].as_py(), b.column("q_dim")[r].as_py()
                order = pc.sort_indices(ids).to_numpy()
                ids = ids.take(pa.array(order))
                if dim and dim == qdim:
                    x = np.frombuffer(b.column("b_vectors")[r].as_buffer(), "<f8").reshape(-1, dim)[order]
                    y = np.frombuffer(b.column("q_vectors")[r].as_buffer(), "<f8").reshape(-1, dim)
                    s = np.round(np.clip(y @ x.T, 0.0, 1.0), DECIMALS)
                else:
                    s = np.zeros((len(qids), len(ids)))
                at = [best(row, k) for row in s]
                n = [len(a) for a in at]
                flat = np.concatenate(at)
                who = np.repeat(np.arange(len(at)), n)
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(who)), ids.take(pa.array(flat)), pa.array(s[who, flat])], names=["qid", "vec_id", "score"])

    found = pairs.select("b_ids", "b_dim", "b_vectors", "q_ids", "q_dim", "q_vectors").mapInArrow(compare, f"qid {kinds[1]['qid']}, vec_id {kinds[0]['id']}, score double")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "score")
