"""Numbers of rows inside groups, also where a group is too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arkivist.operators.common import exchanged, written

#: Groups with more rows than this are numbered through range partitions.
MOST_ROWS = 1_000_000


def numbered(frame: DataFrame, group: list[str], order: list[str], name: str, widest: int) -> DataFrame:
    """Adds name: 1, 2, .. by order in each group.  widest: the rows of the largest group.

    Small groups: a window.  Otherwise rows are sorted by (group, order) in range partitions,
    which cut a large group like any other run, and the number is the place in the partition
    plus what the group has in the partitions before.
    """
    if widest <= MOST_ROWS:
        return frame.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    keys = [*group, *order]
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(frame.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # a row for each group and partition that has some of it
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = placed.join(exchanged(runs), [*group, "_part"])
    return out.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).select(*frame.columns, name)
