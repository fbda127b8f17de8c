"""Caches, manifests, upserts and conversations in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fresh(age_seconds: Column, ttl: Column, fingerprint: Column, current: Column) -> Column:
    return (fingerprint == current) & ((ttl <= 0) | (age_seconds <= ttl))


def ttl_for(current: Column, entity: Column, local: Column) -> Column:
    """Seconds that a cached answer lives: an hour for what changes, forever (0) for local answers, a week for the rest."""
    return F.when(current, 3600).when(local, 0).otherwise(604800)


def ttl_hits(requests: DataFrame, key: list[str], ts: str, ttl: int) -> DataFrame:
    """Adds ``hit``: the same key was asked at most ``ttl`` seconds before."""
    before = F.lag(ts).over(Window.partitionBy(*key).orderBy(ts, "event_id"))
    return requests.withColumn("hit", F.coalesce(F.col(ts) - before <= F.expr(f"INTERVAL '{ttl}' SECOND"), F.lit(False)))


def manifest_diff(before: DataFrame, now: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """``path``, ``status``: new, changed, removed or unchanged."""
    b, n = before.select(path, F.col(digest).alias("old")), now.select(path, F.col(digest).alias("new"))
    j = b.join(n, path, "full_outer")
    return j.select(path, F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged").alias("status"))


def upsert_latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by a map-side maximum."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*key, "x.*")


def last_turns(conversations: DataFrame, n: int = 8) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return conversations.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def latest_user_turn(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``text`` of the last user turn, and how many turns come ``after`` it."""
    g = conversations.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("turn"), F.max("turn").alias("last"))
    return g.where("turn is not null").join(conversations.select("conv_id", "turn", "text"), ["conv_id", "turn"]).select("conv_id", "turn", "text", (F.col("last") - F.col("turn")).alias("after"))


def history_bucket(ts: Column, now: Column) -> Column:
    d = F.datediff(now, ts)
    return F.when(d <= 0, "Today").when(d == 1, "Yesterday").otherwise("Earlier")


def markdown(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``markdown``: a conversation's turns in order."""
    row = F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), F.col("text"))
    return conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", row.alias("md")))), lambda x: x["md"]), "\n\n").alias("markdown"))


def sessions(events: DataFrame, by: str, ts: str, gap_minutes: int) -> DataFrame:
    """``by``, ``session_start``, ``session_end``, ``n``: runs of events with gaps under ``gap_minutes``."""
    return events.groupBy(by, F.session_window(ts, f"{gap_minutes} minutes").alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("session_end")).select(by, F.col("w.start").alias("session_start"), "session_end", "n")
