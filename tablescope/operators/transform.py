"""Text, numeric and date transforms, binning and encodings."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.columns import (
    DATETIME, as_double, col, columns_of, require_columns, scalar_stats, text_columns,
)
from tablescope.functions.indexing import sorted_index
from tablescope.functions.parsing import parse_datetime, strip
from tablescope.functions.quantiles import wide_percentiles

BROADCAST_ROWS = 100_000


def _replace(df: DataFrame, name: str, value: Column) -> DataFrame:
    require_columns(df, [name])
    return df.withColumn(name, value)


def _text(name: str) -> Column:
    return col(name).cast("string")


def text_strip(df: DataFrame, name: str) -> DataFrame:
    return _replace(df, name, strip(_text(name)))


def text_lower(df: DataFrame, name: str) -> DataFrame:
    return _replace(df, name, F.lower(_text(name)))


def text_upper(df: DataFrame, name: str) -> DataFrame:
    return _replace(df, name, F.upper(_text(name)))


TEXT_METHODS = {"lower": F.lower, "upper": F.upper, "strip": strip}


def text_normalize_all(df: DataFrame, method: str) -> DataFrame:
    change = TEXT_METHODS[method]
    return df.withColumns({c: change(col(c)) for c in text_columns(df)})


def regex_replace(df: DataFrame, name: str, pattern: str, replacement: str) -> DataFrame:
    re.compile(pattern)
    return _replace(df, name, F.regexp_replace(_text(name), pattern, replacement))


def regex_extract(df: DataFrame, name: str, pattern: str, new: str | None = None) -> DataFrame:
    """First match of the whole pattern, NULL where there is none."""
    re.compile(pattern)
    require_columns(df, [name])
    hit = F.when(_text(name).rlike(pattern), F.regexp_extract(_text(name), f"({pattern})", 1))
    return df.withColumn(new or f"{name}_extracted", hit)


def text_split(df: DataFrame, name: str, delimiter: str = ",", max_splits: int = 2) -> DataFrame:
    require_columns(df, [name])
    parts = F.split(_text(name), re.escape(delimiter), max_splits + 1)
    return df.withColumns({f"{name}_part{i + 1}": F.get(parts, F.lit(i)) for i in range(max_splits + 1)})


def collapse_whitespace(df: DataFrame, name: str) -> DataFrame:
    return _replace(df, name, strip(F.regexp_replace(_text(name), r"\s+", " ")))


def normalize_labels(df: DataFrame, name: str) -> DataFrame:
    return _replace(df, name, F.lower(strip(_text(name))))


def transform_log(df: DataFrame, name: str) -> DataFrame:
    return _replace(df, name, F.log1p(F.abs(as_double(name))))


def transform_sqrt(df: DataFrame, name: str) -> DataFrame:
    return _replace(df, name, F.sqrt(F.abs(as_double(name))))


def transform_square(df: DataFrame, name: str) -> DataFrame:
    return _replace(df, name, col(name) * col(name))


def transform_abs(df: DataFrame, name: str) -> DataFrame:
    return _replace(df, name, F.abs(col(name)))


def _minmax(df: DataFrame, name: str, constant_as_one: bool) -> Column:
    s = scalar_stats(df, lo=F.min(as_double(name)), hi=F.max(as_double(name)))
    width = F.nullif(s["hi"] - s["lo"], F.lit(0.0))
    if constant_as_one:
        width = F.coalesce(width, F.lit(1.0))
    return (as_double(name) - s["lo"]) / width


def _zscore(df: DataFrame, name: str, constant_as_one: bool) -> Column:
    s = scalar_stats(df, mean=F.avg(as_double(name)), std=F.stddev_samp(as_double(name)))
    std = F.nullif(s["std"], F.lit(0.0))
    if constant_as_one:
        std = F.coalesce(std, F.lit(1.0))
    return (as_double(name) - s["mean"]) / std


def transform_normalize(df: DataFrame, name: str) -> DataFrame:
    return _replace(df, name, _minmax(df, name, False))


def transform_standardize(df: DataFrame, name: str) -> DataFrame:
    return _replace(df, name, _zscore(df, name, False))


FEATURE_TRANSFORMS = {
    "identity": lambda df, c: col(c),
    "log1p": lambda df, c: F.log1p(F.abs(as_double(c))),
    "sqrt": lambda df, c: F.sqrt(F.abs(as_double(c))),
    "zscore": lambda df, c: _zscore(df, c, True),
    "minmax": lambda df, c: _minmax(df, c, True),
}


def feature_compute(df: DataFrame, features: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Declared safe transforms of same-named columns; other transforms are rejected."""
    unknown = sorted(set(features.values()) - set(FEATURE_TRANSFORMS))
    if unknown:
        raise ValueError(f"unsupported transformations: {', '.join(unknown)}")
    made = [FEATURE_TRANSFORMS[t](df, c).alias(c) for c, t in features.items() if c in df.columns]
    return df.select(*[col(k) for k in keep], *made)


def date_extract(df: DataFrame, name: str, part: str = "year") -> DataFrame:
    value = col(name) if name in columns_of(df, DATETIME) else parse_datetime(_text(name))
    return _replace(df, name, {"year": F.year, "month": F.month, "day": F.day}[part](value))


# --- binning -------------------------------------------------------------------------------


def _bin_code(x: Column, edges: Sequence[float], lowest: bool = False) -> Column:
    """Right-closed bins: 0 for (e0, e1], 1 for (e1, e2], ...; NULL outside."""
    passed = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < x))
    inside = (x > edges[0]) & (x <= edges[-1])
    code = F.when(inside, passed - 1)
    return F.when(x == edges[0], F.lit(0)).otherwise(code) if lowest else code


def _short(x: float, precision: int) -> float:
    if not math.isfinite(x) or x == 0:
        return x
    if abs(x) >= 1:
        return round(x, precision)
    return round(x, precision - 1 - math.floor(math.log10(abs(x))))


def interval_labels(edges: Sequence[float], lowest: bool = False) -> list[str]:
    """``(a, b]`` texts with 3 decimals, or as many as keep the edges apart."""
    precision = 3
    while precision < 20 and len({_short(e, precision) for e in edges}) < len(edges):
        precision += 1
    shown = [_short(float(e), precision) for e in edges]
    if lowest:
        shown[0] = _short(shown[0] - 10 ** -precision, precision)
    return [f"({a}, {b}]" for a, b in zip(shown, shown[1:])]


def equal_width_edges(lo: float, hi: float, n: int) -> list[float]:
    """Edges over [lo, hi] with the lowest one lowered by 0.1 % of the range."""
    if lo == hi:
        pad = 0.001 * abs(lo) if lo else 0.001
        lo, hi = lo - pad, hi + pad
        return [lo + i * (hi - lo) / n for i in range(n)] + [hi]
    step = (hi - lo) / n
    return [lo - (hi - lo) * 0.001] + [lo + i * step for i in range(1, n)] + [hi]


def _apply_bins(df: DataFrame, name: str, edges: Sequence[float], labels: Sequence[str] | None,
                codes: bool, new: str | None, lowest: bool = False) -> DataFrame:
    new = new or f"{name}_binned"
    if len(edges) < 2:
        return df.withColumn(new, F.lit(None).cast("int" if codes else "string"))
    code = _bin_code(as_double(name), edges, lowest)
    if codes:
        return df.withColumn(new, code)
    texts = list(labels) if labels else interval_labels(edges, lowest)
    if len(texts) != len(edges) - 1:
        raise ValueError("one label per bin is needed")
    return df.withColumn(new, F.get(F.array(*[F.lit(t) for t in texts]), code))


def bin_equal_width(df: DataFrame, name: str, n: int = 5, labels: Sequence[str] | None = None,
                    codes: bool = False, new: str | None = None) -> DataFrame:
    lo, hi = df.agg(F.min(as_double(name)), F.max(as_double(name))).first()
    edges = [] if lo is None else equal_width_edges(lo, hi, n)
    return _apply_bins(df, name, edges, labels, codes, new)


def bin_quantile(df: DataFrame, name: str, q: int = 4, labels: Sequence[str] | None = None,
                 codes: bool = False, new: str | None = None) -> DataFrame:
    found = wide_percentiles(df.select(col(name)), [name], [i / q for i in range(q + 1)]).first()["q"]
    return _apply_bins(df, name, sorted(set(found or [])), labels, codes, new, lowest=True)


def bin_custom(df: DataFrame, name: str, edges: Sequence[float], labels: Sequence[str] | None = None,
               codes: bool = False, new: str | None = None) -> DataFrame:
    if len(edges) < 2:
        raise ValueError("at least 2 bin edges are needed")
    return _apply_bins(df, name, sorted(edges), labels, codes, new)


def bin_distribution(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(col(name).alias("bin")).agg(F.count("*").alias("count"))


# --- encodings -----------------------------------------------------------------------------


def small_join(df: DataFrame, table: DataFrame, on: Column, how: str = "left") -> DataFrame:
    """Join with a lookup table; broadcast only when its counted size allows it."""
    side = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
    return df.join(side, on, how)


def encode_label(df: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """Sorted distinct texts become 0..k-1; NULL stays NULL."""
    labels = df.where(col(name).isNotNull()).select(_text(name).alias("_label")).distinct()
    index = sorted_index(labels, "_label", out or f"{name}_encoded")
    return small_join(df, index, _text(name) == F.col("_label")).drop("_label")


def onehot_long(df: DataFrame, name: str, key: Sequence[str]) -> DataFrame:
    """One-hot in long form ``(key..., value)``: the cells that are 1, whatever the number of values."""
    return df.where(col(name).isNotNull()).select(*[col(k) for k in key], col(name).alias("value"))


def encode_onehot(df: DataFrame, name: str, values: Sequence[Any] | None = None) -> DataFrame:
    """One 0/1 column per (given or found) sorted value; a NULL row is 0 everywhere.

    The found values are the columns of the result; :func:`onehot_long` has no width.
    """
    if values is None:
        values = [r[0] for r in df.where(col(name).isNotNull()).select(col(name)).distinct().collect()]
    return df.select("*", *[
        F.coalesce((col(name) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{name}_{v}") for v in sorted(values)])


def encode_ordinal(df: DataFrame, name: str, order: Sequence[str], out: str | None = None) -> DataFrame:
    """Position in the given order; a value outside of it is an error."""
    if not order:
        raise ValueError("the order of the categories is needed")
    place = F.array_position(F.array(*[F.lit(o) for o in order]), _text(name)) - 1
    message = F.concat(F.lit(f"unknown category in {name}: "), F.coalesce(_text(name), F.lit("NULL")))
    known = F.when(place >= 0, place.cast("double")).otherwise(F.raise_error(message).cast("double"))
    return df.withColumn(out or f"{name}_ordinal", known)


def target_encode(df: DataFrame, name: str, target: str, smoothing: float = 1.0,
                  out: str | None = None) -> DataFrame:
    """Category mean of the target shrunk to the overall mean by ``n / (n + smoothing)``."""
    overall = scalar_stats(df, mean=F.avg(as_double(target)))["mean"]
    groups = df.where(col(name).isNotNull()).groupBy(col(name).alias("_key")).agg(
        F.avg(as_double(target)).alias("_mean"), F.count(col(target)).alias("_n"))
    weight = F.col("_n") / (F.col("_n") + F.lit(float(smoothing)))
    encoded = groups.select("_key", (weight * F.col("_mean") + (1 - weight) * overall).alias("_te"))
    joined = small_join(df, encoded, col(name) == F.col("_key"))
    return joined.withColumn(out or f"{name}_target", F.coalesce("_te", overall)).drop("_key", "_te")
