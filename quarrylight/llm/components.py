"""Distributed connected components: alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import dropped, saved


#: A node with more than this share of all edges is a hub; there are at most twice HUB_SHARE of them.
HUB_SHARE = 256
#: Edges from which a node is split at all.
LEAST_SPLIT = 256


def _with_own(rows: DataFrame, own: DataFrame, limit: int) -> DataFrame:
    """``rows`` (``u``, ``v``) joined with ``own`` (``u``, ``m``, ``n``, a row per node of n edges): a node of more than ``limit`` edges is met in pieces of about that many, so that no task has to take all of a hub."""
    hubs = own.where(F.col("n") > limit).select("u", F.ceil(F.col("n") / limit).cast("int").alias("pieces"))  # limit is a share of all edges, so these are 2 * HUB_SHARE rows at most
    split = rows.join(F.broadcast(hubs), "u", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("v"), F.col("pieces")), F.lit(0)).cast("int")).drop("pieces")
    last = F.when(F.col("n") > limit, F.ceil(F.col("n") / limit) - 1).otherwise(0).cast("int")
    return split.join(own.select("u", "m", F.explode(F.sequence(F.lit(0), last)).alias("piece")), ["u", "piece"]).drop("piece")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """``node``, ``component``: the smallest node reachable from each node that has an edge to another one.

    ``edges`` has two columns of one orderable type; null ends, loops, repeated and reversed edges don't matter, and an
    empty table gives an empty result. In each round a node's neighbours are hung on its smallest neighbour, first the
    larger ones, then the smaller ones, until nothing moves: about log(n) rounds. A node's neighbours only meet in a
    partial minimum and in a join that splits hubs, so a node that all others link to is no hot spot. Every round's edges
    are a table in the shared folder; nothing goes to the driver but two numbers.
    """
    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        return r[0], r[1]

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = saved(e, "edges")
    was = mark(e)
    for _ in range(max_rounds):
        if not was[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        limit = max(LEAST_SPLIT, -(-was[0] // HUB_SHARE))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = _with_own(both.where("v > u"), least, limit).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = saved(large, "large_star")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_own(large, smallest, limit).select("u", "v", "m")
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        new = saved(hung, "small_star")
        dropped(large)
        now = mark(new)
        dropped(e)
        e = new
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
