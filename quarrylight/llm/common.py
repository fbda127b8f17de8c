"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylight.session import spread
from quarrylight.shared import dropped, new_path, saved, shared_folder  # noqa: F401  (used by the operators from here)

#: Rows of one Arrow batch handed to Python; with texts of many KB it keeps a worker's batch at some MB.
BATCH_ROWS = 512
#: And its bytes: a batch of very long texts is cut sooner.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch holds, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
