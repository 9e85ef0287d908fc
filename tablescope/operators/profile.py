"""Dataset and column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.columns import (
    DATETIME, OTHER, as_double, col, columns_of, distinct_table, family, inline_rows, long_agg,
    nan_to_null, numeric_columns, pct, text_columns,
)
from tablescope.functions.quantiles import agg_with_quantiles
from tablescope.operators.aggregate import describe_numeric, duplicate_count, label_counts, null_counts


def dataset_info(df: DataFrame) -> DataFrame:
    """Position, name, type and number of non-null values of every column."""
    facts = long_agg(nan_to_null(df), df.columns, {"non_null": lambda c: F.count(col(c))})
    fields = {f.name: (i, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)}
    place = F.create_map(*[F.lit(x) for n, (i, _) in fields.items() for x in (n, i)])
    dtype = F.create_map(*[F.lit(x) for n, (_, t) in fields.items() for x in (n, t)])
    return facts.select(place[F.col("column")].alias("position"), F.col("column").alias("name"),
                        dtype[F.col("column")].alias("dtype"), "non_null")


def dtype_counts(df: DataFrame) -> DataFrame:
    return dataset_info(df).groupBy("dtype").agg(F.count("*").alias("columns"))


def top_labels(df: DataFrame, cols: Sequence[str], n: int = 10) -> DataFrame:
    """``(column, rank, value, count)``: the ``n`` most frequent labels of each text column."""
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return (label_counts(df, cols, dropna=True).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= n).select("column", "rank", "value", "count"))


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: counts for all, moments and quartiles for numbers, the top label for
    text, the covered days for datetimes."""
    data = nan_to_null(df)
    fam = {f.name: family(f.dataType) for f in df.schema.fields}
    dtype = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    nums, texts, times = numeric_columns(df), text_columns(df), columns_of(df, DATETIME)

    def num(f):
        return lambda c: f(as_double(c)) if c in nums else F.max(F.lit(None).cast("double"))

    def time(f):
        return lambda c: f(col(c).cast("timestamp_ntz")) if c in times else F.max(F.lit(None).cast("timestamp_ntz"))

    plain = [c for c in df.columns if fam[c] != OTHER]
    common = {"rows": lambda c: F.count(F.lit(1)), "missing": lambda c: F.count_if(col(c).isNull())}
    facts = long_agg(data, df.columns, {
        **common, "min": num(F.min), "max": num(F.max), "mean": num(F.avg), "std": num(F.stddev_samp),
        "first": time(F.min), "last": time(F.max)})
    uniques = distinct_table(data, plain, name="unique") if plain else None
    out = facts
    if uniques is not None:
        out = out.join(F.broadcast(uniques), "column", "left")
    else:
        out = out.withColumn("unique", F.lit(None).cast("bigint"))
    if nums:
        quart = agg_with_quantiles(data.select(*[col(c) for c in nums]), nums, {}, [0.25, 0.5, 0.75])
        out = out.join(F.broadcast(quart), "column", "left")
    else:
        out = out.withColumn("q", F.lit(None).cast("array<double>"))
    if texts:
        top = top_labels(data, texts, 1).select(
            "column", F.col("value").alias("top_value"), F.col("count").alias("top_count"))
        out = out.join(F.broadcast(top), "column", "left")
    else:
        out = out.withColumn("top_value", F.lit(None).cast("string")).withColumn("top_count", F.lit(None).cast("bigint"))
    name = F.col("column")
    fam_map = F.create_map(*[F.lit(x) for kv in fam.items() for x in kv])
    type_map = F.create_map(*[F.lit(x) for kv in dtype.items() for x in kv])
    days = F.floor(F.expr("timestampdiff(SECOND, first, last)") / 86400)
    return out.select(
        name, type_map[name].alias("dtype"), fam_map[name].alias("family"), "rows", "missing",
        pct(F.col("missing"), F.col("rows")).alias("missing_pct"),
        "unique", F.when(F.col("unique").isNotNull(), pct(F.col("unique"), F.col("rows"))).alias("unique_pct"),
        "min", "max", "mean", "std", F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("q50"),
        F.get("q", F.lit(2)).alias("q75"), "top_value", "top_count", "first", "last", days.alias("range_days"))


def column_inventory(df: DataFrame) -> DataFrame:
    """Column, type, non-null and unique values."""
    data = nan_to_null(df)
    facts = long_agg(data, df.columns, {"non_null": lambda c: F.count(col(c))}).join(
        F.broadcast(distinct_table(data, df.columns, name="unique_count")), "column")
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    return facts.select("column", types[F.col("column")].alias("dtype"), "non_null", "unique_count")


def plan_size(df: DataFrame) -> int:
    """Size in bytes as the optimizer estimates it from file statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dataset_profile(df: DataFrame, with_size: bool = True) -> DataFrame:
    """Rows, columns, missing cells, duplicates and (optionally) estimated size as ``(metric, value)``."""
    nulls = null_counts(df).agg(F.sum("nulls")).scalar()
    metrics = [{"metric": F.lit("rows"), "value": F.col("rows")},
               {"metric": F.lit("columns"), "value": F.lit(len(df.columns)).cast("bigint")},
               {"metric": F.lit("missing_cells"), "value": nulls},
               {"metric": F.lit("duplicate_rows"), "value": F.col("duplicates")}]
    if with_size:
        metrics.append({"metric": F.lit("size_bytes"), "value": F.lit(plan_size(df)).cast("bigint")})
    return inline_rows(duplicate_count(nan_to_null(df)), metrics)


def dataset_metadata(df: DataFrame) -> DataFrame:
    """Type, family, missing cells and summary numbers per column."""
    fams = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, family(f.dataType))])
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    base = null_counts(df).select("column", "rows", "nulls", F.round("null_pct", 2).alias("null_pct"))
    out = base.join(F.broadcast(describe_numeric(df)), "column", "left")
    return out.select("column", types[F.col("column")].alias("dtype"), fams[F.col("column")].alias("family"),
                      "rows", "nulls", "null_pct", "mean", "std", "min", "q25", "q50", "q75", "max")


def profile_report(df: DataFrame) -> DataFrame:
    """The report's tables in one long form ``(section, item, metric, value)``, values as text."""
    data = nan_to_null(df)

    def rows(source: DataFrame, section: str, item: str, metrics: Sequence[str]) -> DataFrame:
        return inline_rows(source, [
            {"section": F.lit(section), "item": F.col(item).cast("string"), "metric": F.lit(m),
             "value": F.col(m).cast("string")} for m in metrics])

    overview = rows(dataset_profile(df, with_size=False).withColumn("overview", F.col("metric")),
                    "overview", "overview", ["value"])
    types = rows(dtype_counts(df), "data types", "dtype", ["columns"])
    missing = rows(null_counts(df).where("nulls > 0").withColumn("null_pct", F.round("null_pct", 2)),
                   "missing values", "column", ["nulls", "null_pct"])
    parts = [overview, types, missing]
    if numeric_columns(df):
        names = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
        desc = describe_numeric(df).select("column", *[F.round(F.col(m).cast("double"), 4).alias(m) for m in names])
        parts.append(rows(desc, "numbers", "column", names))
    if text_columns(df):
        top = top_labels(data, text_columns(df))
        parts.append(top.select(F.lit("labels").alias("section"), F.col("column").alias("item"),
                                F.col("value").alias("metric"), F.col("count").cast("string").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


