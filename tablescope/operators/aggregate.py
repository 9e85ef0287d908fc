"""Grouped and pivoted aggregates, frequency tables, sorting, top rows and set operations."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.columns import (
    as_double, col, distinct_table, long_agg, nan_to_null, numeric_columns, pct, require_columns, text_columns,
    to_long,
)
from tablescope.functions.quantiles import agg_with_quantiles, grouped_quantiles, wide_percentiles

SIMPLE = {
    "mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
    "std": F.stddev_samp, "var": F.var_samp, "nunique": F.count_distinct, "prod": F.product,
}


def _aggregate(func: str, y: str, order_by: str | None) -> Column:
    if func in SIMPLE:
        return SIMPLE[func](col(y))
    if func in ("first", "last") and order_by:
        pick = F.min_by if func == "first" else F.max_by
        return pick(col(y), F.when(col(y).isNotNull(), col(order_by)))
    raise ValueError(f"unknown aggregate {func!r} (first and last need order_by)")


def group_agg(df: DataFrame, x: str | Sequence[str], y: str, func: str | Sequence[str] = "mean",
              order_by: str | None = None, out: str | None = None) -> DataFrame:
    """One or several aggregates of ``y`` per group of ``x``; rows with a NULL key are left out.

    Several aggregates share one pass and give one column each, named after the aggregate.
    """
    keys = [x] if isinstance(x, str) else list(x)
    funcs = [func] if isinstance(func, str) else list(func)
    names = [out or y] if isinstance(func, str) else funcs
    require_columns(df, [*keys, y])
    kept = nan_to_null(df.select(*{*keys, y, *([order_by] if order_by else [])})).dropna(subset=keys)
    plain = [(f, n) for f, n in zip(funcs, names) if f != "median"]
    found = kept.groupBy(*[col(k) for k in keys]).agg(
        F.count("*").alias("_n"), *[_aggregate(f, y, order_by).alias(n) for f, n in plain])
    if "median" in funcs:
        halves = grouped_quantiles(kept, keys, y, [0.5])
        same = [F.col(f"g.{k}") == F.col(f"m.{k}") for k in keys]
        found = found.alias("g").join(halves.alias("m"), same, "left").select(
            *[F.col(f"g.{c}") for c in found.columns],
            F.get("m.q", F.lit(0)).alias(names[funcs.index("median")]))
    return found.select(*[col(k) for k in keys], *[col(n) for n in names]).orderBy(*keys)


def pivot_long(df: DataFrame, index: Sequence[str], columns: Sequence[str], values: Sequence[str],
               agg: str = "sum") -> DataFrame:
    """Cross table in long form ``(index..., columns..., values...)``, whatever its width."""
    kept = df.dropna(subset=[*index, *columns])
    return kept.groupBy(*[col(c) for c in [*index, *columns]]).agg(*[_aggregate(agg, v, None).alias(v) for v in values])


def pivot_table(df: DataFrame, index: Sequence[str], columns: Sequence[str], values: Sequence[str],
                agg: str = "sum", labels: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Cross table; missing cells are 0 and rows with a NULL key are left out.

    ``labels`` names the cells to show, one text per pivoted column; by default all are read first
    (their number is the width of the result). Cells are told apart by all their texts, only their
    column name joins them with ``_``; names that clash get a number. :func:`pivot_long` has no width.
    """
    if not columns:
        return pivot_long(df, index, columns, values, agg)
    kept = df.dropna(subset=[*index, *columns])
    labelled = kept.withColumn("_label", F.to_json(F.array(*[col(c).cast("string") for c in columns])))
    if labels is None:
        found = [json.loads(r[0]) for r in labelled.select("_label").distinct().collect()]
    else:
        found = [list(x) for x in labels]
    found.sort(key=lambda x: "_".join(x))
    asked = [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in found]
    pieces = [_aggregate(agg, v, None).alias(f"v{i}") for i, v in enumerate(values)]
    named = F.create_map(*[x for i, a in enumerate(asked) for x in (F.lit(a), F.lit(f"c{i}"))]) if asked else None
    place = labelled.withColumn("_label", named[F.col("_label")] if asked else F.lit(None).cast("string"))
    wide = place.where("_label is not null").groupBy(*index).pivot("_label", [f"c{i}" for i in range(len(asked))]).agg(*pieces)
    names = {i.lower() for i in index}
    cells = []
    for j, v in enumerate(values):
        for i, texts in enumerate(found):
            made = f"c{i}" if len(values) == 1 else f"c{i}_v{j}"
            name, n = f"{v}_{'_'.join(texts)}", 2
            while name.lower() in names:
                name, n = f"{v}_{'_'.join(texts)}_{n}", n + 1
            names.add(name.lower())
            cells.append(F.coalesce(col(made), F.lit(0)).alias(name))
    return wide.select(*[col(i) for i in index], *cells)


def value_counts(df: DataFrame, name: str, top_n: int = 20) -> DataFrame:
    """Most frequent values (NULL included) with count, share of all rows and column cardinality."""
    counts = df.groupBy(col(name).alias("value")).agg(F.count("*").alias("count"))
    totals = counts.agg(
        F.struct(F.sum("count").alias("rows"), F.count("value").alias("cardinality")).alias("t")).scalar()
    top = counts.orderBy(F.desc("count"), F.asc_nulls_last("value")).limit(top_n)
    return top.select(
        F.col("value").cast("string").alias("value"), "count",
        F.round(pct(F.col("count"), totals["rows"]), 2).alias("pct"),
        totals["cardinality"].alias("cardinality"))


def label_counts(df: DataFrame, cols: Sequence[str], dropna: bool = False) -> DataFrame:
    """``(column, value, count)`` of text columns."""
    long = to_long(df, cols, "string")
    if dropna:
        long = long.where("value is not null")
    return long.groupBy("column", "value").agg(F.count("*").alias("count"))


def category_frequencies(df: DataFrame, top: int = 10, rare_share: float = 0.01) -> DataFrame:
    """Per text column the most frequent labels and frequent labels below the rare share."""
    cols = text_columns(df)
    rows = df.agg(F.count("*").alias("n")).scalar()
    counts = label_counts(df, cols).select(
        "column", F.coalesce("value", F.lit("None")).alias("value"), "count",
        F.try_divide(F.col("count"), rows).alias("share"))
    by_size = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    tops = (counts.withColumn("rank", F.row_number().over(by_size)).where(F.col("rank") <= top)
            .select("column", F.lit("top").alias("kind"), "rank", "value", "count", "share"))
    rare = (counts.where(F.col("share") < rare_share)
            .withColumn("rank", F.row_number().over(by_size)).where(F.col("rank") <= top)
            .select("column", F.lit("rare").alias("kind"), "rank", "value", "count", "share"))
    return tops.unionByName(rare)


def distinct_counts(df: DataFrame, dropna: bool = True, approx: bool = False) -> DataFrame:
    facts = long_agg(df, df.columns, {
        "has_null": lambda c: F.coalesce(F.max(col(c).isNull().cast("int")), F.lit(0)),
        "rows": lambda c: F.count(F.lit(1)),
    }).join(F.broadcast(distinct_table(df, df.columns, name="n", approx=approx)), "column")
    unique = F.col("n") if dropna else F.col("n") + F.col("has_null")
    return facts.select("column", unique.alias("unique_count"),
                        pct(unique, F.col("rows")).alias("unique_pct"))


def null_counts(df: DataFrame, total: bool = False) -> DataFrame:
    """NULLs and their percentage per column; optionally a row for all cells together."""
    facts = long_agg(nan_to_null(df), df.columns, {
        "nulls": lambda c: F.count_if(col(c).isNull()), "rows": lambda c: F.count(F.lit(1))})
    if total:
        all_cells = facts.agg(F.lit("(all cells)").alias("column"), F.sum("nulls").alias("nulls"),
                              F.sum("rows").alias("rows"))
        facts = facts.unionByName(all_cells)
    return facts.select("column", "nulls", "rows", pct(F.col("nulls"), F.col("rows")).alias("null_pct"))


def row_multiplicity(df: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies (NULL equals NULL, NaN equals NaN, -0.0 equals 0.0)."""
    return df.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("_copies"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and duplicates. Copies collapse before the shuffle."""
    return row_multiplicity(df).agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
        F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"))


def describe_numeric(df: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column."""
    clean, cols = nan_to_null(df), numeric_columns(df)
    clean = clean.select(*[col(c) for c in cols])
    facts = agg_with_quantiles(clean, cols, {
        "count": lambda c: F.count(col(c)), "mean": lambda c: F.avg(as_double(c)),
        "std": lambda c: F.stddev_samp(as_double(c)), "min": lambda c: F.min(as_double(c)),
        "max": lambda c: F.max(as_double(c))}, probs)
    names = [f"q{round(p * 100):02d}" for p in probs]
    return facts.select(
        "column", "count", "mean", "std", "min",
        *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)], "max")


def spread_ties(df: DataFrame) -> list[Column]:
    """A last sort key that cuts equal keys into ranges, so that a frequent value does not go to one task."""
    names = [f.name for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return [F.xxhash64(*[col(c) for c in names])] if names else []


def sort_by(df: DataFrame, y: str, ascending: bool = True) -> DataFrame:
    return df.orderBy(F.asc_nulls_last(col(y)) if ascending else F.desc_nulls_last(col(y)), *spread_ties(df))


def top_n(df: DataFrame, name: str | None = None, n: int = 10, key: Sequence[str] = ()) -> DataFrame:
    """Largest ``n`` rows by a column (first numeric one by default); ``key`` breaks ties."""
    name = name or numeric_columns(df)[0]
    return df.where(col(name).isNotNull()).orderBy(
        F.desc(col(name)), *[F.asc(col(k)) for k in key]).limit(n)


def head_limit(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*[col(c) for c in order_by]).limit(n)


def tail_limit(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.desc(col(c)) for c in order_by]).limit(n)


def result_sort_filter(df: DataFrame, predicate: str | None = None, order: Sequence[str] = (),
                       ascending: bool = True) -> DataFrame:
    out = df.where(predicate) if predicate else df
    if not order:
        return out
    return out.orderBy(*[F.asc_nulls_last(col(c)) if ascending else F.desc_nulls_last(col(c)) for c in order], *spread_ties(out))


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def union_distinct_nodes(df: DataFrame, source: str, target: str) -> DataFrame:
    return df.select(col(source).alias("node")).distinct().union(
        df.select(col(target).alias("node")).distinct()).distinct()


def lookup_join(df: DataFrame, dim: DataFrame, name: str, key: str, value: str,
                out: str | None = None) -> DataFrame:
    """Map a column through a two-column table; unmatched rows get NULL. Spark picks the join by size."""
    table = dim.select(col(key).alias("_key"), col(value).alias(out or value))
    return df.join(table, col(name) == F.col("_key"), "left").drop("_key")


def percentile_breakdown(df: DataFrame, probs: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    cols = numeric_columns(df)
    found = wide_percentiles(nan_to_null(df).select(*[col(c) for c in cols]), cols, probs)
    return found.select("column", *[F.get("q", F.lit(i)).alias(f"p{round(p * 100):02d}")
                                    for i, p in enumerate(probs)])
