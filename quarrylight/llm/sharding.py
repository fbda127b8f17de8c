"""Sharding by weighted rendezvous hashing, on DataFrame functions alone.

Each shard draws an exponential arrival time for a record from a hash of the record's key and the shard's number, at a rate
that is the shard's weight; the earliest arrival wins. A shard gets records in proportion to its weight, and a record's times
at the other shards do not depend on which shards there are: one more shard only takes the records that reach it first, and a
shard that goes (weight 0) only gives its own away.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import new_path, saved
from quarrylight.operators.order import numbered

#: Bits of the hash that a time is made of: all that a double holds beside the half that keeps it from 0.
HASH_BITS = 52


def key_text(*cols: str) -> Column:
    """The key that is hashed: each column's text behind its length, so that neighbours can't run together; ``-`` for a null."""
    each = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in cols]
    return F.concat(*each)


def arrival(key: Column, shard: int, weight: float) -> Column:
    """The time at which ``shard`` reaches the record: exponential with the weight as its rate, the same on every machine."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{shard}|"), key)), 1, HASH_BITS // 4), 16, 10).cast("double")
    return -F.log((drawn + F.lit(0.5)) / F.lit(float(1 << HASH_BITS))) / F.lit(float(weight))


def checked(weights: list[float]) -> list[float]:
    if not any(w > 0 for w in weights) or any(not 0 <= w < float("inf") for w in weights):
        raise ValueError("weights are finite, none is negative and one at least is above 0")
    return list(weights)


def first_shard(times: Column, weights: list[float]) -> Column:
    """Of ``times`` (a time per shard), the number of the earliest shard that has a weight; the smaller one of two at the same time."""
    ranked = F.array(*[F.struct(F.get(times, F.lit(n)).alias("time"), F.lit(n).alias("n")) for n, w in enumerate(weights) if w > 0])
    return F.array_min(ranked)["n"]


def assigned(df: DataFrame, key: list[str], weights: list[float], name: str = "shard", grown: list[float] | None = None, grown_name: str = "grown_shard") -> DataFrame:
    """``df`` with the shard of each row, a function of the key and the weights alone; nothing is shuffled.

    A column of that name is replaced. Rows of one key, nulls too, share a shard. With ``grown``, weights of another set of
    shards, ``grown_name`` is the shard there; times of shards that are in both with one weight are drawn once.
    """
    checked(weights)
    every = list(weights) if grown is None else checked(grown)
    again = [(n, w) for n, w in enumerate(weights) if n >= len(every) or every[n] != w]
    drawn = f"times_{uuid.uuid4().hex}"
    both = [*enumerate(every), *again]
    places = {x: i for i, x in reversed(list(enumerate(both)))}
    out = df.withColumn(drawn, F.array(*[arrival(key_text(*key), n, w) if w > 0 else F.lit(float("inf")) for n, w in both]))
    own = F.array(*[F.get(drawn, F.lit(places[x])) for x in enumerate(weights)])
    found = {name: first_shard(own, weights)} | ({grown_name: first_shard(F.col(drawn), every)} if grown is not None else {})
    return out.withColumns(found).drop(drawn)


def moves(df: DataFrame, key: list[str], weights: list[float], grown: list[float]) -> DataFrame:
    """``shard``, ``grown_shard``, ``rows``: how many rows go from which shard to which when the weights change."""
    both = assigned(df.select(*key), key, weights, "shard", grown)
    return both.groupBy("shard", "grown_shard").agg(F.count("*").alias("rows"))


def slotted(df: DataFrame, order: list[str], shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``df`` with each row's place in its shard, gapless from 0, by ``order`` (nulls first); rows that tie in all of it take any order.

    A shard holds a large share of all rows, so no window goes over it: one order of the whole table by shard and ``order``
    is cut into ranges (rows that tie are spread by a random last key), and a shard's first number is taken off. Hand in
    narrow rows of a written table: all columns are shuffled once, and a task that runs again has to draw the same numbers.
    """
    own, number, first = (f"{x}_{uuid.uuid4().hex}" for x in ("spread", "number", "first"))
    placed = numbered(df.withColumn(own, F.rand(7)), [shard, *order, own], number).drop(own)
    starts = placed.groupBy(F.col(shard).alias(f"{first}_shard")).agg(F.min(number).alias(first))  # a row per shard: at most as many as weights
    out = placed.join(F.broadcast(starts), F.col(shard) == F.col(f"{first}_shard"))
    return out.withColumn(slot, F.col(number) - F.col(first)).select(*[c for c in df.columns if c != slot], slot)


def digest(df: DataFrame, weights: list[float], grown: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``: a row per row of ``df``.

    ``size`` is the text's UTF-8 bytes plus 1, ``text_crc32`` that of its bytes; a null text has none, so 1 and 0. The law is
    ``key``: ``id_col`` and the weights alone decide, so rows that repeat an id, nulls too, are in one shard. Slots go by id,
    size and checksum. No other column is read; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    found = saved(assigned(rows, [id_col], weights, "shard", grown), "assigned")  # the order is drawn from a sample, which must not hash all texts again
    out = slotted(found, [id_col, "size", "text_crc32"])
    return out.select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, key: list[str], weights: list[float], path: str | None = None, files: int = 8) -> str:
    """Writes the rows with all their columns as Parquet, a folder ``shard=n`` of about ``files`` files each, and returns the path (a new one in the shared folder by default).

    Inside its shard a row goes to a file by a hash of all its values, so that a key which holds a third of all rows is spread
    as well and a task that runs again writes the same rows; rows that are equal in every column share a file. An empty table
    gives no files. A column named ``shard`` is replaced.
    """
    path = path or new_path(df.sparkSession, "shards")
    salt = f"salt_{uuid.uuid4().hex}"
    out = assigned(df, key, weights).withColumn(salt, F.pmod(F.xxhash64(F.to_json(F.struct(*[c for c in df.columns if c != "shard"]))), files).cast("int"))
    out.repartition(max(1, len(weights) * files), "shard", salt).drop(salt).write.partitionBy("shard").parquet(path)
    return path
