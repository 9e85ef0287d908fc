"""Column families, null handling and long-form reports shared by all operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
TEXT = "categorical"
DATETIME = "datetime"
BOOLEAN = "boolean"
OTHER = "other"


def col(name: str) -> Column:
    """Column by its plain name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def family(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return TEXT
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    return OTHER


def columns_of(df: DataFrame, *families: str) -> list[str]:
    return [f.name for f in df.schema.fields if family(f.dataType) in families]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, NUMERIC)


def text_columns(df: DataFrame) -> list[str]:
    return columns_of(df, TEXT)


def datetime_columns(df: DataFrame) -> list[str]:
    return columns_of(df, DATETIME)


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes NULL, so that one rule covers all missing cells."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c).alias(f.name)
        out.append(c)
    return df.select(*out)


def as_double(name: str) -> Column:
    return col(name).cast("double")


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 for an empty table."""
    return F.coalesce(F.try_divide(part.cast("double") * 100, whole.cast("double")), F.lit(0.0))


def inline_rows(df: DataFrame, rows: Sequence[dict[str, Column]], keep: Sequence[str] = ()) -> DataFrame:
    """Turn every row of ``df`` into ``len(rows)`` rows built from its columns."""
    structs = [F.struct(*[c.alias(n) for n, c in r.items()]) for r in rows]
    return df.select(*[col(k) for k in keep], F.inline(F.array(*structs)))


def long_agg(
    df: DataFrame,
    cols: Sequence[str],
    metrics: dict[str, Callable[[str], Column]],
    finish: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """One pass over ``df``: every metric of every column, one result row per column.

    All aggregates share a single ``agg`` with map-side partials; the one wide row is then split
    into ``(column, metric, metric, ...)`` rows, ``finish`` turning an aggregate into its result.
    """
    aggs = [f(c).alias(f"m{i}_{m}") for i, c in enumerate(cols) for m, f in metrics.items()]
    wide = df.agg(*aggs)
    if finish:
        wide = wide.select(*[
            (finish[m](F.col(f"m{i}_{m}")) if m in finish else F.col(f"m{i}_{m}")).alias(f"m{i}_{m}")
            for i in range(len(cols)) for m in metrics])
    return inline_rows(
        wide,
        [{"column": F.lit(c), **{m: F.col(f"m{i}_{m}") for m in metrics}} for i, c in enumerate(cols)],
    )


RESCANNED = ("Project", "Filter", "Relation", "LocalRelation", "InMemoryRelation", "LogicalRDD")


def cheap_to_rescan(df: DataFrame) -> bool:
    """True for plain scans with projections and filters, which columnar files answer column by column."""
    plan = str(df._jdf.queryExecution().optimizedPlan().toString())
    steps = [line.lstrip(" +-:") for line in plan.splitlines() if line[:1].isalpha() or "- " in line[:80]]
    return all(s.startswith(RESCANNED) for s in steps)


def distinct_table(df: DataFrame, cols: Sequence[str], expr: Callable[[str], Column] = col,
                   name: str = "uniques", approx: bool = False) -> DataFrame:
    """``(column, uniques)``: distinct non-null values of every column.

    Over a scan every column is counted by its own small aggregate, all in one job: each column
    chunk is read once and no row is repeated. Over a costly plan one pass expands the rows instead.
    """
    if approx or len(cols) < 2 or not cheap_to_rescan(df):
        count = F.approx_count_distinct if approx else F.count_distinct
        return long_agg(df, cols, {name: lambda c: count(expr(c))})
    parts = [df.agg(F.lit(c).alias("column"), F.count_distinct(expr(c)).alias(name)) for c in cols]
    return reduce(DataFrame.unionByName, parts)


def empty_report(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def to_long(df: DataFrame, cols: Sequence[str], dtype: str, keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., column, value)`` rows, NULL values included."""
    return inline_rows(
        df, [{"column": F.lit(c), "value": col(c).cast(dtype)} for c in cols], keep
    )


def scalar_stats(df: DataFrame, **aggs: Column) -> Column:
    """Statistics of ``df`` as one struct usable in expressions over any table.

    It is an uncorrelated scalar subquery: a single aggregated row, computed once and
    handed to the tasks as a value. Nothing is collected and the plan stays lazy.
    """
    packed = F.struct(*[c.alias(n) for n, c in aggs.items()])
    return df.agg(packed.alias("stats")).scalar()
