"""Running totals over a whole table without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.indexing import ranged


def bucketed(df: DataFrame, order: str, bucket: str = "_bucket", rows_per_bucket: int | None = None) -> DataFrame:
    """Add a bucket number that grows with ``order``; equal values share a bucket."""
    return ranged(df, order, bucket, rows_per_bucket)


def running_sums(df: DataFrame, order: str, values: Sequence[str], outs: Sequence[str],
                 rows_per_bucket: int | None = None) -> DataFrame:
    """Inclusive running sums of ``values`` in ``order``, which must be unique per row."""
    parts = ranged(df, order, "_bucket", rows_per_bucket)
    totals = parts.groupBy("_bucket").agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(values)])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(  # one row per range
        "_bucket", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_o{i}")
                     for i in range(len(values))])
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(v).over(inside).alias(f"_w{i}") for i, v in enumerate(values)]
    joined = parts.select("*", *sums).join(offsets, "_bucket")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"_w{i}") + F.col(f"_o{i}")).alias(o) for i, o in enumerate(outs)])
