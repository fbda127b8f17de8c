"""Sinks: staged replacement, appends and deletes of Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fs(df: DataFrame, path: str):
    jvm = df.sparkSession.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path
    return p, p(path).getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())


def replace(df: DataFrame, path: str, least_rows: int = 0) -> int:
    """Writes beside ``path``, checks the count, then swaps by rename; the old table stays if the new one has fewer than ``least_rows`` rows."""
    staged, old = f"{path}.staged-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    n = df.sparkSession.read.parquet(staged).count()
    p, fs = _fs(df, path)
    if n < least_rows:
        fs.delete(p(staged), True)
        raise ValueError(f"{n} rows, {least_rows} wanted; the old table stays")
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    fs.rename(p(staged), p(path))
    fs.delete(p(old), True)
    return n


def should_roll_back(before: int, after: int, indexed: int, errors: int) -> bool:
    """An index that is empty although files were read, or that lost over half of its rows while errors occurred."""
    return indexed > 0 and after == 0 or errors > 0 and after < before / 2


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not deleted."""
    return df.join(gone.select(key), key, "left_anti")


def cached_answers(rows: DataFrame, keep: int = 250) -> DataFrame:
    """The newest row of each key (``key``, ``ts``), then the ``keep`` newest of all."""
    rest = [c for c in rows.columns if c != "key"]
    latest = rows.groupBy("key").agg(F.max_by(F.struct(*rest), "ts").alias("x")).select("key", "x.*")
    return latest.orderBy(F.desc("ts"), "key").limit(keep)
