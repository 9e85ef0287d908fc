"""Column operations and filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions import columns as cols_
from tablescope.functions.columns import (
    DATETIME, TEXT, as_double, col, columns_of, distinct_table, long_agg, numeric_columns, require_columns,
    text_columns,
)
from tablescope.functions.parsing import is_date, is_number, parse_datetime


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    require_columns(df, [old])
    name = new.strip()
    if not name or name in df.columns:
        raise ValueError(f"column name is empty or taken: {new!r}")
    return df.withColumnRenamed(old, name)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def reorder_columns(df: DataFrame, order: Sequence[str]) -> DataFrame:
    first = [c for c in order if c in df.columns]
    return df.select(*[col(c) for c in first + [c for c in df.columns if c not in first]])


def add_constant(df: DataFrame, name: str = "new_col", value: Any = "") -> DataFrame:
    return df.withColumn(name, F.lit(value))


def select_features(df: DataFrame, target: str, features: Sequence[str] = ()) -> DataFrame:
    """The chosen feature columns without the target; all but the target when none are named."""
    require_columns(df, [target, *features])
    chosen = list(features) or df.columns
    return df.select(*[col(c) for c in chosen if c != target])


def select_by_family(df: DataFrame, family: str) -> DataFrame:
    return df.select(*[col(c) for c in columns_of(df, family)])


def column_types(df: DataFrame, mode: str = "dtype") -> DataFrame:
    """Family of every column, from its type or from what its values look like."""
    by_type = {f.name: cols_.family(f.dataType) for f in df.schema.fields}
    if mode == "dtype":
        return long_agg(df, df.columns, {"non_null": lambda c: F.count(col(c))}).select(
            "column", _lookup(by_type).alias("family"))
    text = text_columns(df)
    content = {
        "rows": lambda c: F.count(F.lit(1)),
        "not_numbers": lambda c: F.count_if(col(c).isNotNull() & ~is_number(col(c)))
        if c in text else F.sum(F.lit(0)),
        "not_dates": lambda c: F.count_if(col(c).isNotNull() & ~is_date(col(c)))
        if c in text else F.sum(F.lit(0)),
    }
    plain = [c for c in df.columns if by_type[c] != cols_.OTHER]
    facts = long_agg(df, plain, content).join(F.broadcast(distinct_table(df, plain, name="distinct")), "column")
    family = _lookup(by_type)
    is_numeric = family.isin(cols_.NUMERIC, cols_.BOOLEAN, DATETIME) | (
        (family == TEXT) & (F.col("not_numbers") == 0))
    few = F.try_divide(F.col("distinct"), F.col("rows")) < 0.05
    return facts.select(
        "column", family.alias("family"), is_numeric.alias("looks_numeric"),
        ((family == TEXT) | F.coalesce(few, F.lit(False))).alias("looks_categorical"),
        ((family == DATETIME) | ((family == TEXT) & (F.col("not_dates") == 0))).alias("looks_datetime"))


def _lookup(mapping: Mapping[str, str]) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.create_map(*pairs)[F.col("column")]


def filter_range(df: DataFrame, name: str, lo: Any = None, hi: Any = None) -> DataFrame:
    """``lo <= column <= hi``; either bound may be missing, NULL and NaN fall out."""
    require_columns(df, [name])
    out = df
    if lo is not None:
        out = out.where(col(name) >= F.lit(lo))
        if hi is None and dict(df.dtypes)[name] in ("float", "double"):
            out = out.where(~F.isnan(col(name)))
    if hi is not None:
        out = out.where(col(name) <= F.lit(hi))
    return out


def filter_in(df: DataFrame, name: str, values: Sequence[Any]) -> DataFrame:
    return df.where(col(name).isin(*values)) if name in df.columns else df


def date_column(df: DataFrame) -> str | None:
    times = columns_of(df, DATETIME)
    named = [c for c in df.columns if "date" in c.lower() or "time" in c.lower() or c in times]
    return named[0] if named else None


def filter_date_range(df: DataFrame, start: str, end: str, name: str | None = None) -> DataFrame:
    """Rows of the days ``start`` to ``end``, both included."""
    name = name or date_column(df)
    if name is None:
        return df
    value = col(name) if name in columns_of(df, DATETIME) else parse_datetime(col(name))
    first = F.lit(start).cast("date").cast("timestamp_ntz")
    after = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    return df.where((value >= first) & (value < after))


NULL_LABEL = "None"  # how a missing label is written in a selection


def filter_categories(df: DataFrame, picked: Mapping[str, Sequence[str]]) -> DataFrame:
    """Keep the picked labels of text columns (NULL is a label); an empty selection keeps all."""
    out = df
    for c, labels in picked.items():
        if c in text_columns(df) and len(labels) > 0:
            kept = col(c).isin(*labels)  # a plain comparison, so that it reaches the file scan
            out = out.where(kept | col(c).isNull() if NULL_LABEL in labels else kept)
    return out


def filter_numeric_ranges(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Ranges on the numeric columns; constant columns are skipped.

    Columns without a chosen range span their whole data, so only their NULLs fall out. The
    smallest and largest values are read first, so that plain comparisons reach the file scan.
    """
    names = numeric_columns(df)
    if not names:
        return df
    ends = df.agg(*[f(as_double(c)).alias(f"{m}{i}") for i, c in enumerate(names)
                    for m, f in (("lo", F.min), ("hi", F.max))]).first()
    out = df
    for i, c in enumerate(names):
        if ends[f"lo{i}"] == ends[f"hi{i}"]:
            continue
        if c in ranges:
            lo, hi = ranges[c]
            out = out.where(col(c).between(lo, hi))
        else:
            out = out.where(col(c).isNotNull())
    return out


def apply_filters(df: DataFrame, dates: tuple[str, str] | None = None, date_col: str | None = None,
                  categories: Mapping[str, Sequence[str]] | None = None,
                  ranges: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Date range, then categories, then numeric ranges, each on what the previous one left."""
    out = filter_date_range(df, *dates, name=date_col) if dates else df
    if categories:
        out = filter_categories(out, categories)
    if ranges:
        out = filter_numeric_ranges(out, ranges)
    return out


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(cols) if cols else None)
