"""Sessions, and shipping this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package as a zip, once for each application, so that Python operators need no installation there."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        top = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="quarrylight-"), "quarrylight.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f"{top.name}/{f.relative_to(top)}")
        spark.sparkContext.addPyFile(target)
    return spark


#: A table of fewer bytes in fewer files than cores is dealt over the cores when it is read.
SPREAD_BYTES = 64 << 20


def spread(df):
    """A small table that comes in a few row groups, dealt over all cores; a larger one, or one of many files, as it is.

    One row group is one task however many cores there are. Shuffling some MB costs less than that; at scale row groups are
    many and nothing is shuffled. Catalyst's size estimate decides; filters and column pruning still reach the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 1 << 18 < size < SPREAD_BYTES and len(df.inputFiles()) < cores else df
