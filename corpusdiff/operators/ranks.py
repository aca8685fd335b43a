"""Ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusdiff.session import cut_lineage


def distributed_rank(df: DataFrame, keys: list[str], order: list[str], to: str = "rank") -> DataFrame:
    """``row_number`` per key where one key may hold a large part of all rows.

    The rows are range partitioned by key and order, so a large key lies in several consecutive partitions. A rank is
    the number of rows of the key in earlier partitions plus the place inside the own one; only the counts per
    partition and key are brought together.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("part_", F.spark_partition_id())
    placed = cut_lineage(ranged)
    counts = placed.groupBy("part_", *keys).agg(F.count("*").alias("n_"))
    before = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before_", F.coalesce(F.sum("n_").over(before), F.lit(0))).drop("n_")
    inside = Window.partitionBy("part_", *keys).orderBy(*order)
    return (
        placed.withColumn("inside_", F.row_number().over(inside)).join(offsets, ["part_", *keys])
        .withColumn(to, (F.col("inside_") + F.col("before_")).cast("long")).drop("part_", "inside_", "before_")
    )
