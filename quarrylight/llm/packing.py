"""Best-fit packing planned on the histogram of lengths.

1. Documents are tokenized and cut into pieces of at most ``capacity`` tokens; each task numbers its pieces of a length.
2. The histogram (at most ``capacity`` counts) goes to the driver, which packs *counts*, longest first, each into the
   open sequences with the least room that suffices, whole groups of equal sequences at a time.
3. Pieces of one length are interchangeable, so the plan is a table of slot ranges; each piece takes the slot at its rank
   within its length. Ranks come from a prefix sum over the tasks' counts: no task ever holds all pieces of a length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm import bpe
from quarrylight.llm.common import saved

CAPACITY = 1024
END_OF_TEXT = 2

PIECES = "doc_id {kind}, piece int, start long, length int, ids_crc32 long, task int, place long"


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_OF_TEXT, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row per piece: id, ``piece`` (from 0), ``start`` (the document's ids before it), ``length``, ``ids_crc32``, and the writing ``task`` with the piece's ``place`` among its pieces of that length (``ids`` too, if asked for).

    A text's ids end with ``end_id``; a null text counts as empty, so each row has a piece. Only longer ones are cut, from
    the end: the first piece takes the remainder. ``task`` and ``place`` are only stable once the table is written.
    """
    kind = df.schema[id_col].dataType.simpleString()
    ending = int(end_id).to_bytes(4, "little")

    def run(batches):
        model, task, seen = bpe.model(path), TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            cols = [[] for _ in range(8)]
            for at, text in enumerate(b.column(1).to_pylist()):
                ids = memoryview(model.ranked(text or "") + ending)
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    size = (n - start - 1) % capacity + 1
                    part = ids[4 * start : 4 * (start + size)]
                    row = (at, piece, start, size, zlib.crc32(part), task, seen[size], np.frombuffer(part, "<u4").astype(np.int32) if keep_ids else None)
                    for c, v in zip(cols, row):
                        c.append(v)
                    seen[size] += 1
                    start, piece = start + size, piece + 1
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            out = [b.column(0).take(pa.array(cols[0], pa.int32())), *(pa.array(c, k) for c, k in zip(cols[1:7], kinds))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"]
            if keep_ids:
                out.append(pa.array(cols[7], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = PIECES.format(kind=kind) + (", ids array<int>" if keep_ids else "")
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slot ranges (length, first rank, last rank, sequence of the first, pieces a sequence, offset there) of best-fit decreasing over counts.

    Rank r of a range lies in sequence ``sequence + (r - first) // per`` at ``offset + (r - first) % per * length``.
    Work depends on the number of distinct lengths, not of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> (first sequence, how many)
    rooms: list[int] = []
    ranges, sequences = [], 0

    def leave(space: int, first: int, count: int) -> None:
        if space and count:
            if not room[space]:
                bisect.insort(rooms, space)
            room[space].append((first, count))

    for length in sorted((k for k, v in histogram.items() if v > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit")
        left, rank = histogram[length], 0
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                space = rooms[k]
                first, count = room[space].pop()
                if not room[space]:
                    del rooms[k]
            else:
                space, first, count = capacity, sequences, -(-left // (capacity // length))
                sequences += count
            per = space // length
            used, last = (count, 0) if left >= count * per else divmod(left, per)
            if used:
                ranges.append((length, rank, rank + used * per - 1, first, per, capacity - space))
                leave(space - per * length, first, used)
            if last:
                ranges.append((length, rank + used * per, rank + used * per + last - 1, first + used, last, capacity - space))
                leave(space - last * length, first + used, 1)
            leave(space, first + used + bool(last), count - used - bool(last))
            rank += used * per + last
            left -= used * per + last
    return ranges


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_OF_TEXT, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (and ``ids``) of every piece of every row.

    Repeated rows are packed each. An empty table gives an empty result. Sequence numbers depend on the partitioning of
    ``df``; the number of sequences and what lies where by length do not.
    """
    spark = df.sparkSession
    cut = saved(pieces(df, path, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    by_task = saved(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "piece_counts")
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "task", F.coalesce("before", F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    slots = spark.createDataFrame(plan(histogram, capacity), "length int, first long, last long, sequence long, per long, at long")
    ranked = cut.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("place"))
    placed = ranked.join(slots, (ranked.length == slots.length) & F.col("rank").between(F.col("first"), F.col("last"))).drop(slots.length)
    nth = F.col("rank") - F.col("first")
    return placed.select(
        F.col("doc_id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"), (F.col("at") + nth % F.col("per") * F.col("length")).cast("long").alias("offset"), *(["ids"] if keep_ids else []),
    )
