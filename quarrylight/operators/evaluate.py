"""Retrieval quality and the comparison of strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hit_at(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: ``n``, ``hit_at_k`` for each k (over questions that have an answer), ``not_found_accuracy``; 0 where nothing is asked.

    ``ranked``: ``qid``, ``rank``, ``id``; ``gold``: ``qid``, ``id`` (null if nothing should be found).
    """
    first = ranked.join(gold.where("id is not null"), ["qid", "id"]).groupBy("qid").agg(F.min("rank").alias("first"))
    found = ranked.select("qid").distinct().withColumn("any", F.lit(True))
    q = gold.groupBy("qid").agg(F.max(F.col("id").isNotNull()).alias("should")).join(first, "qid", "left").join(found, "qid", "left")
    hits = [F.round(F.coalesce(F.avg(F.when(F.col("should"), F.coalesce(F.col("first") <= k, F.lit(False)).cast("double"))), F.lit(0.0)), 6).alias(f"hit_at_{k}") for k in ks]
    return q.agg(F.count("*").alias("n"), *hits, F.round(F.coalesce(F.avg(F.when(~F.col("should"), F.col("any").isNull().cast("double"))), F.lit(0.0)), 6).alias("not_found_accuracy"))


def winner(results: DataFrame, by: str) -> DataFrame:
    """The grounded strategy with the largest (confidence, sources, faithfulness, -latency); "" if none is grounded."""
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    ok = F.col("n_sources") > 0
    best = F.max_by(F.when(ok, F.col("mode")), F.when(ok, F.struct(rank, F.col("n_sources"), F.coalesce("faithfulness", F.lit(0.0)), -F.col("latency"), F.col("mode"))))
    return results.groupBy(by).agg(F.coalesce(best, F.lit("")).alias("winner"))
