"""Global order without a global window."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.shared import saved

#: monotonically_increasing_id() holds the partition above this bit and the row's place in it below.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """Adds the rank of each row in the whole table, from 1, by ``order`` (nulls first); rows that tie in all of it are numbered in any order.

    The table is range-partitioned and sorted once and written to the shared folder with each row's partition and place, so
    that every later pass reads the same ranges: bounds are drawn from a sample, and a second pass over other columns would
    draw others. A prefix sum over the partitions' sizes, one row each, gives the numbers; no task sees all rows and nothing
    is shuffled but the table itself, once. An empty table gives an empty result; the helper's name clashes with no column.
    """
    own = f"place_{uuid.uuid4().hex}"
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = saved(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(own, F.monotonically_increasing_id()), "ordered")
    part, place = F.shiftright(own, _PLACE_BITS), F.col(own).bitwiseAND((1 << _PLACE_BITS) - 1)
    sizes = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n"))
    running = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("p").alias(f"{own}_p"), F.coalesce(F.sum("n").over(running), F.lit(0)).alias(f"{own}_n"))  # a row per partition
    out = placed.join(F.broadcast(before), part == F.col(f"{own}_p"))
    return out.select(*[c for c in df.columns if c != name], (F.col(f"{own}_n") + place + 1).alias(name))
