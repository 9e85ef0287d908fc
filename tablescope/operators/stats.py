"""Moments, correlations, hypothesis tests, collinearity, mutual information and drift.

The data-sized part of every test is one Spark aggregate; p-values are functions of the
few numbers it leaves.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from functools import partial
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions import special
from tablescope.functions.checkpoints import checkpointed
from tablescope.functions.columns import (
    as_double, col, empty_report, inline_rows, long_agg, nan_to_null, numeric_columns,
    require_columns, scalar_stats, text_columns, to_long,
)
from tablescope.functions.gram import pair_correlations, pair_sums
from tablescope.functions.quantiles import wide_percentiles

ALPHA = 0.05
DAGOSTINO_MIN = 8  # values that the moments test needs
SHAPIRO_MAX = 5000  # values up to which the approximation of the Shapiro-Wilk weights holds


def _numbers(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    cols = list(cols) if cols is not None else numeric_columns(df)
    require_columns(df, cols)
    return nan_to_null(df.select(*[col(c) for c in cols])), cols


def shape_facts(df: DataFrame, cols: Sequence[str], probs: Sequence[float] | None = None) -> DataFrame:
    """``(column, n, mean, std, skewness, kurtosis, min, max[, q])``.

    The second pass adds up powers of the distance to the mean, which is exact and compiles to far
    smaller code than one built-in moment aggregate per column. Skew and kurtosis are the biased
    forms, NULL for a constant column.
    """
    means = scalar_stats(df, **{f"m{i}": F.avg(as_double(c)) for i, c in enumerate(cols)})
    data = df.select(*[as_double(c).alias(c) for c in cols]).withColumn("_s", means)
    place = {c: i for i, c in enumerate(cols)}
    gap = lambda c: col(c) - F.col(f"_s.m{place[c]}")
    metrics = {
        "n": lambda c: F.count(col(c)), "mean": lambda c: F.max(F.col(f"_s.m{place[c]}")),
        "m2": lambda c: F.avg(gap(c) * gap(c)), "m3": lambda c: F.avg(gap(c) * gap(c) * gap(c)),
        "m4": lambda c: F.avg(gap(c) * gap(c) * gap(c) * gap(c)),
        "min": lambda c: F.min(col(c)), "max": lambda c: F.max(col(c))}
    facts = long_agg(data, cols, metrics)
    if probs:
        facts = facts.join(F.broadcast(wide_percentiles(df, cols, probs)), "column")  # one row per column
    n, m2 = F.col("n").cast("double"), F.col("m2")
    varies = F.col("min") < F.col("max")
    std = F.when(varies, F.sqrt(m2 * n / F.nullif(n - 1, F.lit(0.0)))).otherwise(F.when(n > 1, F.lit(0.0)))
    return facts.select(
        "column", "n", "mean", std.alias("std"),
        F.when(varies, F.col("m3") / F.pow(m2, F.lit(1.5))).alias("skewness"),
        F.when(varies, F.col("m4") / (m2 * m2) - 3).alias("kurtosis"), "min", "max", *(["q"] if probs else []))


def statistical_summary(df: DataFrame) -> DataFrame:
    """mean, median, std, biased skew and excess kurtosis, min, max and quartiles."""
    data, cols = _numbers(df)
    facts = shape_facts(data, cols, [0.25, 0.5, 0.75])
    return facts.where(F.col("n") > 0).select(
        "column", "mean", F.get("q", F.lit(1)).alias("median"), "std", "skewness", "kurtosis", "min", "max",
        F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(2)).alias("q3"))


def adjusted_skew(skew: Column, n: Column) -> Column:
    """Bias-corrected skew; NULL for fewer than three values or a constant."""
    n = n.cast("double")
    return F.when(n > 2, skew * F.sqrt(n * (n - 1)) / (n - 2))


def skew_adjusted(df: DataFrame) -> DataFrame:
    data, cols = _numbers(df)
    return shape_facts(data, cols).select("column", adjusted_skew(F.col("skewness"), F.col("n")).alias("skew"))


# --- correlation ---------------------------------------------------------------------------


def _named(pairs: DataFrame, cols: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in cols])
    return pairs.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "i", "j", "corr")


def correlation_pairs(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(a, b, corr)`` for every pair of numeric columns: Pearson, rows where both are present."""
    data, cols = _numbers(df, cols)
    if len(cols) < 2:
        return empty_report(df, "a string, b string, corr double")
    return _named(pair_correlations(data, cols), cols).where("i < j").select("a", "b", "corr")


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """All ordered pairs with the diagonal, long form; a constant column has NULL everywhere."""
    data, cols = _numbers(df, cols)
    if not cols:
        return empty_report(df, "a string, b string, corr double")
    return _named(pair_correlations(data, cols), cols).select("a", "b", "corr")


def top_correlations(df: DataFrame, n: int = 5) -> DataFrame:
    size = F.abs("corr")
    return correlation_pairs(df).where("corr is not null").select(
        "a", "b", "corr",
        F.when(size > 0.7, "strong").when(size > 0.4, "moderate").otherwise("weak").alias("strength"),
        F.when(F.col("corr") > 0, "positive").otherwise("negative").alias("direction"),
    ).orderBy(F.desc(F.abs("corr")), "a", "b").limit(n)


def redundant_columns(df: DataFrame, threshold: float = 0.9, top: int | None = None) -> DataFrame:
    """Pairs correlated at or above the threshold, the strongest first; on request only the ``top`` ones."""
    pairs = correlation_pairs(df).select("a", "b", F.abs("corr").alias("abs_corr"))
    found = pairs.where(F.col("abs_corr") >= threshold).orderBy(F.desc("abs_corr"), "a", "b")
    return found if top is None else found.limit(top)


# --- normality -----------------------------------------------------------------------------


def _dagostino(n: Column, g1: Column, g2: Column) -> Column:
    """K² of D'Agostino and Pearson from size, biased skew and excess kurtosis."""
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta - 1))
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - mean) / F.sqrt(var)
    b = (6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
         * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))))
    a = 6 + 8 / b * (2 / b + F.sqrt(1 + 4 / (b * b)))
    inner = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.signum(inner) * F.pow(F.abs(inner), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    return z1 * z1 + z2 * z2


def normality_test(df: DataFrame, method: str = "auto") -> DataFrame:
    """Shapiro-Wilk up to 5 000 values and D'Agostino-Pearson beyond ("auto"), or one test for all columns: "shapiro" (up
    to 5 000 values), "dagostino", "ks" (Kolmogorov-Smirnov against the sample's own mean and deviation)."""
    if method not in ("auto", "shapiro", "dagostino", "ks"):
        raise ValueError(f"unknown method {method!r}")
    data, cols = _numbers(df)
    facts = shape_facts(data, cols).withColumnRenamed("skewness", "g1").withColumnRenamed("kurtosis", "g2")
    if method == "ks":
        found = ks_against_normal(data, facts.where((F.col("n") > 2) & (F.col("std") > 0)).select("column", "mean", "std"))
        return found.select("column", F.lit("Kolmogorov-Smirnov").alias("test"), "statistic", "p_value",
                            (F.col("p_value") > ALPHA).alias("is_normal"))
    n = F.col("n").cast("double")
    k2 = _dagostino(n, F.col("g1"), F.col("g2"))
    moments = facts.where((F.col("n") >= DAGOSTINO_MIN) & F.col("g1").isNotNull()).select(
        "column", "n", F.lit("D'Agostino-Pearson").alias("test"), k2.alias("statistic"), F.exp(-k2 / 2).alias("p_value"))
    if method != "dagostino":
        counts = data.agg(*[F.count(col(c)) for c in cols]).first()
        few = [c for c, held in zip(cols, counts) if 3 <= held <= SHAPIRO_MAX]
        out = shapiro_wilk(data, few).select("column", F.lit("Shapiro-Wilk").alias("test"), "statistic", "p_value")
        if method == "auto":
            out = out.unionByName(moments.where(F.col("n") > SHAPIRO_MAX).drop("n"))
    else:
        out = moments.drop("n")
    return out.withColumn("is_normal", F.col("p_value") > ALPHA)


# The polynomials of Royston's approximation to the Shapiro-Wilk weights and p-value, lowest power first.
LAST_WEIGHT = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
NEXT_WEIGHT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_MEAN = [0.5440, -0.39978, 0.025054, -0.0006714]
SMALL_SPREAD = [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
LARGE_SPREAD = [-0.4803, -0.082676, 0.0030302]
SMALL_LIMIT = [-2.273, 0.459]


def royston(x: np.ndarray) -> tuple[float, float]:
    """W and its p-value for 3 to 5 000 values that are not all equal."""
    at = lambda c, v: float(np.polynomial.polynomial.polyval(v, c))
    x, n, bell = np.sort(x), len(x), NormalDist()
    m = np.array([bell.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    squares, u = float(m @ m), 1 / math.sqrt(n)
    a = m / math.sqrt(squares)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        ends = [a[-1] + at(LAST_WEIGHT, u)] + ([a[-2] + at(NEXT_WEIGHT, u)] if n > 5 else [])
        k = len(ends)
        rest = (squares - 2 * float((m[-k:] ** 2).sum())) / (1 - 2 * sum(e * e for e in ends))
        a = m / math.sqrt(rest)
        for i, e in enumerate(ends):
            a[i], a[n - 1 - i] = -e, e
    gap = x - x.mean()
    w = min(1.0, float((a @ gap) ** 2 / (gap @ gap)))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-19))
    if n <= 11:
        limit = at(SMALL_LIMIT, n)
        if y >= limit:
            return w, 1e-19
        y, mean, spread = -math.log(limit - y), at(SMALL_MEAN, n), math.exp(at(SMALL_SPREAD, n))
    else:
        mean, spread = at(LARGE_MEAN, math.log(n)), math.exp(at(LARGE_SPREAD, math.log(n)))
    return w, 0.5 * math.erfc((y - mean) / spread / math.sqrt(2))


def shapiro_wilk(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, statistic, p_value)`` for columns of at most ``SHAPIRO_MAX`` values, each sorted in a group of its own."""
    if not cols:
        return empty_report(df, "column string, statistic double, p_value double")
    values = to_long(df, cols, "double").where("value IS NOT NULL AND NOT isnan(value)")

    def run(table: pa.Table) -> pa.Table:
        x = table.column("value").to_numpy()
        w, p = royston(x) if x.min() < x.max() else (None, None)
        return pa.table({"column": table.column("column").slice(0, 1), "statistic": pa.array([w], pa.float64()),
                         "p_value": pa.array([p], pa.float64())})

    return values.groupBy("column").applyInArrow(run, "column string, statistic double, p_value double").where("p_value IS NOT NULL")


def ks_against_normal(df: DataFrame, normals: DataFrame) -> DataFrame:
    """``(column, n, statistic, p_value)`` of one-sample Kolmogorov-Smirnov tests against the ``(column, mean, std)`` rows.

    All columns share one exchange: their distinct values lie in range partitions, whose counts are carried on, and each
    partition gives its largest distance. The p-value is Kolmogorov's series with Stephens' correction, at every size.
    """
    wanted = {r["column"]: (float(r["mean"]), float(r["std"])) for r in normals.collect()}  # one row per column
    if not wanted:
        return empty_report(df, "column string, n bigint, statistic double, p_value double")
    values = to_long(df, list(wanted), "double").where("value IS NOT NULL AND NOT isnan(value)")
    counts = values.groupBy("column", "value").agg(F.count("*").alias("c"))
    # the checkpoint freezes the ranges, which are numbered in order
    placed = checkpointed(counts.repartitionByRange("column", "value").withColumn("range", F.spark_partition_id()))
    totals = placed.groupBy("column", "range").agg(F.sum("c").alias("held"))  # ranges and columns: few rows
    every = Window.partitionBy("column")
    offsets = totals.select("column", "range", F.sum("held").over(every).alias("n"),
                            (F.sum("held").over(every.orderBy("range")) - F.col("held")).alias("before"))

    @F.arrow_udf("double")
    def below(column: pa.Array, value: pa.Array) -> pa.Array:
        out = []
        for c, v in zip(column.to_pylist(), value.to_pylist()):
            mean, std = wanted[c]
            out.append(0.5 * math.erfc((mean - v) / std / math.sqrt(2)))
        return pa.array(out, pa.float64())

    run = F.sum("c").over(Window.partitionBy("column", "range").orderBy("value"))
    rows = placed.withColumn("run", run).join(F.broadcast(offsets), ["column", "range"])
    upto, p = F.col("run") + F.col("before"), below("column", "value")
    gaps = rows.select("column", "n", "c", upto.alias("upto"), p.alias("p"))
    d = F.greatest(F.col("upto") / F.col("n") - F.col("p"), F.col("p") - (F.col("upto") - F.col("c")) / F.col("n"))
    root = F.sqrt(F.col("n").cast("double"))
    lam = (root + 0.12 + 0.11 / root) * F.col("statistic")
    series = sum(((-1) ** (j - 1) * 2 * F.exp(-2.0 * j * j * lam * lam) for j in range(1, 41)), F.lit(0.0))
    tail = F.when(lam < 0.2, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))
    return gaps.groupBy("column", "n").agg(F.max(d).alias("statistic")).withColumn("p_value", tail)


# --- hypothesis tests ----------------------------------------------------------------------


def _verdict(df: DataFrame) -> DataFrame:
    return df.withColumn("significant", F.coalesce(F.col("p_value") < ALPHA, F.lit(False)))


def ttest_ind(df: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Pooled-variance t-test of two numeric columns, missing values dropped per column."""
    nums = numeric_columns(df)
    a, b = a or nums[0], b or nums[1]
    if a not in nums or b not in nums:
        raise ValueError("both columns must be numeric")
    data, _ = _numbers(df, [a, b])
    row = data.agg(*[f(as_double(c)).alias(f"{m}{i}") for i, c in enumerate((a, b))
                     for m, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    n0, n1 = F.col("n0"), F.col("n1")
    dof = (n0 + n1 - 2).cast("double")
    pooled = F.try_divide((n0 - 1) * F.col("v0") + (n1 - 1) * F.col("v1"), dof)
    t = F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(pooled * (1 / n0 + 1 / n1)))
    out = row.where((n0 > 1) & (n1 > 1)).select(
        F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), t.alias("statistic"), dof.alias("df"))
    return _verdict(out.withColumn("p_value", special.t_p(F.col("statistic"), F.col("df"))))


def _oneway(groups: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """F statistic from ``(n, mean, var)`` per group."""
    total = groups.agg(
        F.count("*").alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("mean")).alias("s"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("ss"),
        F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("within"))
    between = F.col("ss") - F.col("s") * F.col("s") / F.col("N")
    df1, df2 = (F.col("k") - 1).cast("double"), (F.col("N") - F.col("k")).cast("double")
    f = F.try_divide(F.try_divide(between, df1), F.try_divide(F.col("within"), df2))
    out = total.where("k >= 2").select(
        *[c.alias(n) for n, c in labels.items()], F.col("k").alias("groups"), f.alias("statistic"),
        df1.alias("df_between"), df2.alias("df_within"))
    return _verdict(out.withColumn(
        "p_value", special.f_p(F.col("statistic"), F.col("df_between"), F.col("df_within"))))


def anova_groups(df: DataFrame, y: str, group: str) -> DataFrame:
    """One-way ANOVA of a numeric column over the labels of a text column."""
    shift = df.agg(F.avg(as_double(y)).alias("m")).scalar()  # centred sums stay exact
    data = nan_to_null(df.select(col(group), as_double(y).alias("_y"))).dropna()
    stats = data.select(col(group), (F.col("_y") - shift).alias("_y")).groupBy(col(group)).agg(
        F.count("_y").alias("n"), F.avg("_y").alias("mean"), F.var_samp("_y").alias("var"))
    return _oneway(stats, {"target_column": F.lit(y), "group_column": F.lit(group)})


def anova_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One-way ANOVA with the numeric columns as groups."""
    data, names = _numbers(df, list(cols) if cols else numeric_columns(df))
    long = to_long(data, names, "double").where("value is not null")
    stats = long.groupBy("column").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    return _oneway(stats, {"columns": F.lit(",".join(names))})


def chi_square(df: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Independence test of two text columns; Yates' correction for one degree of freedom.

    Cells that never occur have O = 0, so the sum over all cells is ΣO²/E - N over the
    observed ones: no cross product of the labels is built.
    """
    texts = text_columns(df)
    a, b = a or texts[0], b or texts[1]
    cells = df.select(col(a).alias("a"), col(b).alias("b")).dropna().groupBy("a", "b").agg(
        F.count("*").cast("double").alias("o"))
    rows = cells.groupBy("a").agg(F.sum("o").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("cb"))
    part = cells.join(rows, "a").join(cols, "b").agg(
        F.sum("o").alias("N"), F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb"))).alias("s"))
    r = rows.agg(F.struct(F.count("*").alias("k"), F.sum(1 / F.col("ra")).alias("inv")).alias("r")).scalar()
    c = cols.agg(F.struct(F.count("*").alias("k"), F.sum(1 / F.col("cb")).alias("inv")).alias("c")).scalar()
    plain = F.greatest(F.col("N") * (F.col("s") - 1), F.lit(0.0))
    dof = ((r["k"] - 1) * (c["k"] - 1)).cast("double")
    inverse = F.col("N") * r["inv"] * c["inv"]  # Σ 1/E
    gap = F.sqrt(plain / inverse)  # |O - E| is the same in all four cells of a 2x2 table
    yates = F.pow(gap - F.least(F.lit(0.5), gap), F.lit(2)) * inverse
    out = part.where("N is not null").select(
        F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
        F.when(dof == 1, yates).when(dof == 0, F.lit(0.0)).otherwise(plain).alias("statistic"), dof.alias("df"))
    p = F.when(F.col("df") > 0, special.chi2_p(F.col("statistic"), F.col("df"))).otherwise(F.lit(1.0))
    return _verdict(out.withColumn("p_value", p))


# --- collinearity and dependence -----------------------------------------------------------


def _vif_of(gram: list[float]) -> list[float]:
    """Diagonal of G times diagonal of its inverse; the matrix has one row per column of the table."""
    k = int(len(gram) ** 0.5)
    g = np.array(gram, dtype=float).reshape(k, k)
    d = np.sqrt(np.diag(g))
    scaled = g / np.outer(d, d)
    try:
        return [float(x) for x in np.diag(np.linalg.inv(scaled))]
    except np.linalg.LinAlgError:
        return [float("inf")] * k


def vif(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Variance inflation of each numeric column against the others, without intercept."""
    data, names = _numbers(df, cols)
    data = data.dropna()
    sums = pair_sums(data, names, centred=False)
    ordered = F.array_sort(F.collect_list(F.struct("i", "j", "sxy")))  # k x k entries
    solve = F.udf(_vif_of, "array<double>", useArrow=False)
    found = sums.agg(F.transform(ordered, lambda e: e["sxy"]).alias("g")).where(F.size("g") > 0).select(
        solve("g").alias("v"))
    out = inline_rows(found, [{"column": F.lit(c), "vif": F.get("v", F.lit(i))} for i, c in enumerate(names)])
    v = F.col("vif")
    return out.select(
        "column", F.round(v, 3).alias("vif"),
        F.when(v > 10, "High").when(v > 5, "Medium").otherwise("Low").alias("risk")).orderBy(F.desc("vif"))


def _pair_cells(batches: Iterator[pa.RecordBatch], cuts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Cells of every pair of columns with their rows in a batch; columns with cuts are numbers, others labels."""
    for b in batches:
        codes, labels = [], []
        for i in range(b.num_columns):
            if i in cuts:
                codes.append(np.searchsorted(cuts[i], b.column(i).to_numpy(zero_copy_only=False), "left"))
                labels.append(pa.array([str(k) for k in range(len(cuts[i]) + 1)], pa.string()))
            else:
                found = b.column(i).dictionary_encode()
                codes.append(found.indices.to_numpy(zero_copy_only=False).astype(np.int64))
                labels.append(found.dictionary.cast(pa.string()))
        found = []
        for i, j in itertools.combinations(range(len(codes)), 2) if b.num_rows else ():
            cell, rows = np.unique(codes[i] * len(labels[j]) + codes[j], return_counts=True)
            x, y = labels[i].take(pa.array(cell // len(labels[j]))), labels[j].take(pa.array(cell % len(labels[j])))
            found.append([pa.array(np.full(len(cell), k, np.int32)) for k in (i, j)] + [x, y, pa.array(rows)])
        if found:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*found)], ["i", "j", "x", "y", "o"])


def mutual_info(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """Pairwise mutual information in nats over quantile bins (numbers) and labels (text).

    Plug-in estimate Σ p·ln(p / (pₐ·p_b)) on rows complete in all columns. All pairs are counted
    in one grouped pass; a task counts the (pair, bin, bin) cells of each batch, only those counts are shuffled.
    """
    nums, texts = numeric_columns(df), text_columns(df)
    names = list(cols) if cols is not None else nums + texts
    data = nan_to_null(df.select(*[col(c) for c in names])).dropna()
    inner = [i / bins for i in range(1, bins)]
    num_names = [c for c in names if c in nums]
    edges = {r["column"]: sorted(set(r["q"] or [])) for r in  # bins - 1 numbers per column
             (wide_percentiles(data.select(*[col(c) for c in num_names]), num_names, inner).collect()
              if num_names else [])}

    data = data.select(*[(as_double(c) if c in edges else col(c).cast("string")).alias(f"c{i}") for i, c in enumerate(names)])
    cuts = {i: np.array(edges[c], dtype=float) for i, c in enumerate(names) if c in edges}
    named = F.array(*[F.lit(c) for c in names])
    cells = checkpointed(  # read four times
        data.mapInArrow(partial(_pair_cells, cuts=cuts), "i int, j int, x string, y string, o bigint").groupBy(
            F.get(named, F.col("i")).alias("a"), F.get(named, F.col("j")).alias("b"), "x", "y").agg(
            F.sum("o").cast("double").alias("o")))
    xs = cells.groupBy("a", "b", "x").agg(F.sum("o").alias("ox"))
    ys = cells.groupBy("a", "b", "y").agg(F.sum("o").alias("oy"))
    n = cells.groupBy("a", "b").agg(F.sum("o").alias("n"))
    term = F.col("o") / F.col("n") * F.log(F.col("o") * F.col("n") / (F.col("ox") * F.col("oy")))
    return (cells.join(xs, ["a", "b", "x"]).join(ys, ["a", "b", "y"]).join(F.broadcast(n), ["a", "b"])
            .groupBy("a", "b").agg(F.sum(term).alias("mutual_info")))


# --- drift ---------------------------------------------------------------------------------


def baseline_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    data, names = _numbers(df, cols)
    return long_agg(data, names, {"mean": lambda c: F.avg(as_double(c)), "std": lambda c: F.stddev_samp(as_double(c))})


def mean_shift(df: DataFrame, baseline: DataFrame) -> DataFrame:
    """Current against stored mean for every baseline column the table has."""
    data, names = _numbers(df)
    now = long_agg(data, names, {"current_mean": lambda c: F.avg(as_double(c))})
    base = baseline.select("column", F.col("mean").alias("baseline_mean"))
    return now.join(base, "column").select(
        "column", "current_mean", "baseline_mean",
        F.abs(F.col("current_mean") - F.col("baseline_mean")).alias("mean_shift"))


def drift_ks(df: DataFrame, baseline: DataFrame) -> DataFrame:
    """Distribution drift of each column against N(mean, std) of its stored baseline; all columns in one pass."""
    found = ks_against_normal(df, baseline.where(F.col("column").isin(numeric_columns(df)) & (F.col("std") > 0)))
    p = F.col("p_value")
    return found.join(mean_shift(df, baseline), "column").select(
        "column", F.col("statistic").alias("ks_statistic"), "p_value",
        (p < ALPHA).alias("drift_detected"),
        F.when(p < 0.01, "High").when(p < ALPHA, "Medium").otherwise("None").alias("severity"),
        "current_mean", "baseline_mean", "mean_shift").orderBy(F.desc("ks_statistic"))
