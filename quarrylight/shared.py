"""Tables in the folder that the driver and the executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths that saved() wrote, for each application, until they are dropped.
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset (tests on one machine) a temporary folder is set; on a cluster that is an error, as
    executors could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    base = "file://" + tempfile.mkdtemp(prefix="quarrylight-")
    spark.sparkContext.setCheckpointDir(base)
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; clean_up() deletes it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: the lineage is cut and a lost executor costs nothing that has been computed."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path  # for dropped()
    return out


def kept(spark: SparkSession, path: str) -> bool:
    """Whether new_path() gave ``path`` to this application and nothing has deleted it since."""
    return path in _written.get(spark.sparkContext.applicationId, [])


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    own = _written.get(spark.sparkContext.applicationId, [])
    if path in own:
        own.remove(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that saved() wrote and that nothing reads any more."""
    path = getattr(df, "_quarry_path", None)
    if path:
        _delete(df.sparkSession, path)


def clean_up(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Deletes ``paths``, or all that this application's operators wrote into the shared folder, and returns their number. Only once the results that read them have been used."""
    gone = list(_written.get(spark.sparkContext.applicationId, [])) if paths is None else paths
    for path in gone:
        _delete(spark, path)
    return len(gone)


@contextmanager
def temporary(spark: SparkSession):
    """What operators write into the shared folder inside the block is deleted at its end, so results have to be written or collected in it."""
    before = set(_written.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        clean_up(spark, [p for p in _written.get(spark.sparkContext.applicationId, []) if p not in before])
