"""Readers, writers, previews and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.columns import (
    col, distinct_table, long_agg, text_columns,
)
from tablescope.functions.indexing import sorted_index


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             multi_line: bool = False) -> DataFrame:
    """CSV with a header; give a schema for large files, inference reads them twice.

    Files are split among tasks; ``multi_line`` reads values with line ends, one task per file.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              array: bool = False) -> DataFrame:
    """JSON records, one per line, or one array per file with ``array=True``."""
    reader = spark.read.option("multiLine", array)
    return reader.schema(schema).json(path) if schema else reader.json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option(
        "escape", '"').csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_query_result(df: DataFrame, path: str) -> None:
    export_csv(df, path, quote_all=True)


def export_pivot_csv(df: DataFrame, path: str, index: Sequence[str], columns: Sequence[str],
                     values: Sequence[str], agg: str = "sum") -> DataFrame:
    from tablescope.operators.aggregate import pivot_table
    table = pivot_table(df, index, columns, values, agg)
    export_csv(table, path)
    return table


def preview_head(df: DataFrame, n: int = 10, order_by: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*[col(c) for c in order_by]).limit(n)


def preview_tail(df: DataFrame, n: int = 10, order_by: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*[F.desc(col(c)) for c in order_by]).limit(n)


def sample_rows(df: DataFrame, n: int, key: Sequence[str] = ()) -> DataFrame:
    """``n`` rows with the smallest hash of their key: the same rows on every run.

    Rows are first cut down to those below a hash that about 2n rows pass (all, if that turns out too few),
    then their places in hash order decide; the order is made by range partitions, not in one task.
    """
    keys = [col(k) for k in (key or df.columns)]
    hashed = df.withColumn("_h", F.xxhash64(*keys))
    rows = df.count()
    if rows <= n:
        return df
    bound = int(((2 * n + 1000) / rows - 0.5) * 2**64)
    if bound < 2**63:
        few = hashed.where(F.col("_h") < F.lit(bound))
        hashed = few if few.count() >= n else hashed
    placed = hashed.withColumn("_k", F.struct("_h", *[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    return sorted_index(placed, "_k", "_place").where(F.col("_place") < n).drop("_h", "_k", "_place")


INTEGER_LIMITS = (("tinyint", 7), ("smallint", 15), ("int", 31))


def compact_plan(df: DataFrame) -> DataFrame:
    """Smallest type per column that keeps every value, and which text columns repeat enough
    for Parquet to store them as dictionary."""
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    texts = text_columns(df)
    none = F.lit(None)
    facts = long_agg(df, [*ints, *doubles, *texts], {
        "lo": lambda c: F.min(col(c)).cast("bigint") if c in ints else F.max(none.cast("bigint")),
        "hi": lambda c: F.max(col(c)).cast("bigint") if c in ints else F.max(none.cast("bigint")),
        "exact": lambda c: F.count_if(col(c).isNotNull() & (col(c).cast("float").cast("double") != col(c)))
        if c in doubles else F.max(none.cast("bigint")),
        "rows": lambda c: F.count(F.lit(1))})
    facts = facts.join(F.broadcast(distinct_table(df, texts)), "column", "left") if texts else facts.withColumn(
        "uniques", none.cast("bigint"))
    best = F.lit("bigint")
    for name, bits in reversed(INTEGER_LIMITS):
        best = F.when((F.col("lo") >= -(1 << bits)) & (F.col("hi") < (1 << bits)), name).otherwise(best)
    is_int, is_double = F.col("column").isin(*ints or [""]), F.col("column").isin(*doubles or [""])
    kind = (F.when(is_int, best).when(is_double, F.when(F.col("exact") == 0, "float").otherwise("double"))
            .otherwise(F.when(F.col("uniques") < 0.5 * F.col("rows"), "dictionary text").otherwise("text")))
    return facts.select("column", kind.alias("compact_type"))


def compact_types(df: DataFrame) -> DataFrame:
    """Cast numbers to the smallest type that keeps every value."""
    plan = {r["column"]: r["compact_type"] for r in compact_plan(df).collect()}  # one row per column
    casts = {c: t for c, t in plan.items() if not t.endswith("text")}
    return df.select(*[col(c).cast(casts[c]).alias(c) if c in casts else col(c) for c in df.columns])
