"""Operators that depend on an order: date gaps, cumulative distributions, running totals, joins by time or range."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.columns import (
    as_double, col, datetime_columns, empty_report, nan_to_null, numeric_columns, to_long,
)
from tablescope.functions.indexing import sorted_index
from tablescope.functions.running import running_sums

IRREGULAR_DAYS = 7


def _day_gaps(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, day, n, first, last, gap_days)``: one row per column and calendar day.

    Whole-day gaps between consecutive timestamps can only be above zero where the day
    changes, so the first and last timestamp of every day decide them. The window then runs
    over days, not over rows.
    """
    days = (
        to_long(df, cols, "timestamp_ntz").where("value is not null")
        .groupBy("column", F.col("value").cast("date").alias("day"))
        .agg(F.count("*").alias("n"), F.min("value").alias("first"), F.max("value").alias("last")))
    prev = F.lag("last").over(Window.partitionBy("column").orderBy("day"))
    seconds = F.timestamp_diff("SECOND", prev, F.col("first"))
    return days.withColumn("gap_days", F.floor(seconds / 86400))


def datetime_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Range, missing values and gaps (in whole days) between consecutive timestamps."""
    cols = list(cols) if cols is not None else datetime_columns(df)
    if not cols:
        return empty_report(df, "column string, min timestamp_ntz, max timestamp_ntz, range_days long, "
                                "null_count long, avg_gap_days double, max_gap_days long")
    rows = df.agg(F.count("*").alias("n")).scalar()
    facts = _day_gaps(df, cols).groupBy("column").agg(
        F.min("first").alias("min"), F.max("last").alias("max"), F.sum("n").alias("n"),
        F.sum("gap_days").alias("gaps"), F.max("gap_days").alias("max_gap_days"), F.count("*").alias("days"))
    gap = F.when(F.col("n") > 1, F.coalesce("gaps", F.lit(0)) / (F.col("n") - 1))
    widest = F.when(F.col("n") > 1, F.coalesce("max_gap_days", F.lit(0)))
    return facts.select(
        "column", "min", "max", F.floor(F.timestamp_diff("SECOND", F.col("min"), F.col("max")) / 86400).alias("range_days"),
        (rows - F.col("n")).alias("null_count"), gap.alias("avg_gap_days"), widest.alias("max_gap_days"))


def sampling_gap(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Median whole-day gap per datetime column; above a week the sampling counts as irregular."""
    cols = list(cols) if cols is not None else datetime_columns(df)
    days = _day_gaps(df, cols)
    across = days.where("gap_days is not null").groupBy("column", "gap_days").agg(F.count("*").alias("w"))
    within = days.groupBy("column").agg((F.sum("n") - F.count("*")).alias("w")).select(
        "column", F.lit(0).cast("bigint").alias("gap_days"), "w").where("w > 0")
    gaps = across.unionByName(within).groupBy("column", "gap_days").agg(F.sum("w").alias("w"))
    median = F.percentile("gap_days", F.lit(0.5), F.col("w"))
    return gaps.groupBy("column").agg(median.alias("median_gap_days")).withColumn(
        "irregular", F.col("median_gap_days") > IRREGULAR_DAYS)


def ecdf(df: DataFrame, name: str) -> DataFrame:
    """Distinct values in order with the share of rows at or below each."""
    data = nan_to_null(df.select(col(name).alias("value"))).where("value is not null")
    counts = data.groupBy("value").agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    run = running_sums(counts, "value", ["count"], ["upto"])
    return run.select("value", "count", (F.col("upto") / total).alias("share"))


def waterfall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Sum of ``y`` per ``x`` with the running total in ``x`` order."""
    steps = df.where(col(x).isNotNull()).groupBy(col(x).alias("x")).agg(F.sum(as_double(y)).alias("delta"))
    order = "x"
    if x not in numeric_columns(df) + datetime_columns(df):
        steps, order = sorted_index(steps, "x", "_step"), "_step"
    run = running_sums(steps, order, ["delta"], ["total"])
    return run.select("x", "delta", "total")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str,
              values: Sequence[str], bucket: str = "DAY") -> DataFrame:
    """For every left row the ``values`` of the latest right row of its key at or before its time.

    Both sides are cut into time buckets per key, so a hot key is spread over many tasks. Inside
    a bucket a window finds the latest right row; where the bucket has none yet, the last one of
    the nearest earlier bucket is carried in. A NULL key or time matches nothing.
    """
    packed = F.struct(col(right_ts).alias("_ts"), *[col(v) for v in values])
    keys = [col(k) for k in by]
    known = [*by, left_ts]
    real = left.dropna(subset=known)
    l_rows = real.select("*", F.date_trunc(bucket, col(left_ts)).alias("_bucket"), col(left_ts).alias("_at"),
                         F.lit(1).alias("_side"))
    kind = right.select(packed.alias("r")).schema["r"].dataType
    r_rows = right.dropna(subset=[*by, right_ts]).select(
        *keys, F.date_trunc(bucket, col(right_ts)).alias("_bucket"), col(right_ts).alias("_at"),
        F.lit(0).alias("_side"), packed.alias("_row"))
    both = l_rows.withColumn("_row", F.lit(None).cast(kind)).unionByName(r_rows, allowMissingColumns=True)
    inside = Window.partitionBy(*by, "_bucket").orderBy("_at", "_side", "_row").rowsBetween(
        Window.unboundedPreceding, 0)
    here = both.withColumn("_here", F.last("_row", ignorenulls=True).over(inside)).where("_side = 1")
    lasts = r_rows.groupBy(*by, "_bucket").agg(F.max("_row").alias("_row"))
    buckets = l_rows.select(*by, "_bucket").distinct().join(lasts, [*by, "_bucket"], "full")
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(*by, "_bucket", F.last("_row", ignorenulls=True).over(earlier).alias("_carry"))
    found = here.join(carried, [*by, "_bucket"], "left").withColumn("_hit", F.coalesce("_here", "_carry"))
    matched = found.select(
        *[col(c) for c in left.columns], F.col("_hit._ts").alias(f"asof_{right_ts}"),
        *[F.col(f"_hit.`{v}`").alias(f"asof_{v}") for v in values])
    unknown = left.where(reduce(or_, [col(k).isNull() for k in known]))
    return matched.unionByName(unknown, allowMissingColumns=True)


def range_join(points: DataFrame, intervals: DataFrame, at: Column, lo: Column, hi: Column,
               width: float) -> DataFrame:
    """Points joined to the closed intervals containing them.

    Each interval has a cell level of its own, the smallest whose cells (``width`` times a power of
    two) are as long as the interval, so it touches at most two cells; points are listed once per level in use. An equi-join on
    level and cell replaces the comparison of all points with all intervals. ``at``,
    ``lo`` and ``hi`` are numbers (for times: seconds).
    """
    size = lambda level: F.lit(float(width)) * F.pow(F.lit(2.0), level)
    i = intervals.withColumn("_lo", lo.cast("double")).withColumn("_hi", hi.cast("double")).where("_lo <= _hi")
    i = i.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2((F.col("_hi") - F.col("_lo")) / width + 1e-300))).cast("int"))
    levels = F.coalesce(i.agg(F.collect_set("_level")).scalar(), F.array().cast("array<int>"))  # one per power of two
    i = i.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") / size(F.col("_level"))),
                                                  F.floor(F.col("_hi") / size(F.col("_level"))))))
    p = points.withColumn("_at", at.cast("double")).withColumn("_level", F.explode(levels))
    p = p.withColumn("_cell", F.floor(F.col("_at") / size(F.col("_level"))))
    return p.join(i, ["_level", "_cell"]).where("_at >= _lo and _at <= _hi").drop("_cell", "_level", "_at", "_lo", "_hi")
