"""Consecutive numbers for rows in a global order, without a global task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from terrakin.storage import materialize


def numbered(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in ``order`` (columns that no two rows share). Rows are
    range-partitioned; only the partitions' row counts meet in one task."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_part", "_place", "_before")
