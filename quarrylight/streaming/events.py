"""Stateful operators on unbounded input; each gives on a finished stream what its batch version gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``event_type``, ``start``, ``n``, ``total``: state is dropped once the watermark passes a window."""
    g = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("event_type", F.col("w.start").alias("start"), "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
    return g.select(F.col("w.start").alias("start"), "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(requests: DataFrame, key: list[str], ttl: str = "300 seconds") -> DataFrame:
    """A request is answered once within the cache's time to live: later ones with its key are dropped, and so is its state once the watermark has passed."""
    return requests.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(key)


def ingest(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Incremental ingestion: each micro-batch of new files goes to ``apply``, which must be idempotent for a batch number (an upsert is)."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
