"""Order over a whole table by range partitions: buckets that grow with the order, positions 0..n-1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.checkpoints import checkpointed

ROWS_PER_RANGE = 500_000


def ranged(df: DataFrame, order: str, bucket: str = "_bucket", rows_per_range: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by ``order``, with the number of their range.

    Equal values share a range. The checkpoint freezes which range a row lies in, so every use of the result
    sees the same ones.
    """
    parts = max(1, -(-df.count() // (rows_per_range or ROWS_PER_RANGE)))
    return checkpointed(df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn(bucket, F.spark_partition_id()))


def sorted_index(df: DataFrame, order: str, out: str, limit: int | None = None) -> DataFrame:
    """Number the rows of ``df`` by ``order``; rows that repeat a value are numbered in any order."""
    placed = ranged(df, order, "_part", limit)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_size")).select(  # one row per range
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return placed.withColumn("_pos", inside).join(offsets, "_part").withColumn(
        out, F.col("_offset") + F.col("_pos")).drop("_part", "_pos", "_offset")
