"""Dense numbers in a global order without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from presswork.core.storage import materialise


def numbered(df: DataFrame, by: str, name: str, label: str = "numbered") -> DataFrame:
    """``df`` with its row number (from 0) in the order of ``by``.

    Rows are partitioned by range and sorted; each partition adds the counts of those
    before it. The sorted partitions are written, so that both sides of the last join
    read the same ones.
    """
    placed = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id())
    placed = materialise(placed, label)
    base = placed.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__start"))
    base = base.withColumn("__before", F.sum("__n").over(W.orderBy("__part")) - F.col("__n"))
    # One row per partition, so small enough to broadcast.
    return placed.join(F.broadcast(base), "__part").withColumn(name, F.col("__id") - F.col("__start") + F.col("__before")).select(*df.columns, name)
