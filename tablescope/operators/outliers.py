"""Isolation forest, local outlier factor and the vote of all detectors, per numeric column.

All four detectors judge a value by the column it stands in, so they work on the counted distinct
values ``(column, v, c)``; copies of a value never travel one by one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.columns import as_double, col, inline_rows, nan_to_null, numeric_columns
from tablescope.functions.quantiles import grouped_quantiles
from tablescope.functions.running import bucketed
from tablescope.operators.clean import IQR_FACTOR
from tablescope.operators.transform import small_join
from tablescope.sources.io import sample_rows

# Forest size, share of flagged values, votes needed, neighbour count.
TREES, TREE_ROWS = 100, 256
CONTAMINATION = 0.05
VOTES = 3
MIN_VALUES = 30
Z_LIMIT = 3.0
EULER = 0.5772156649
NEIGHBOURS_MIN, NEIGHBOURS_MAX, NEIGHBOURS_SHARE = 5, 20, 20
LRD_FLOOR = 1e-10
LOF_ROWS, LOF_CHUNK = 50_000, 20_000


def counted_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, v, c)``: distinct values of each column with their number of rows."""
    data = nan_to_null(df.select(*[col(c) for c in cols]))
    long = inline_rows(data, [{"column": F.lit(c), "v": as_double(c)} for c in cols]).where("v is not null")
    return long.groupBy("column", "v").agg(F.count("*").alias("c"))


# --- isolation forest ----------------------------------------------------------------------


def _rest(m: int) -> float:
    """Mean depth of an unbuilt subtree of ``m`` values."""
    return 0.0 if m <= 1 else 2 * (math.log(m - 1) + EULER) - 2 * (m - 1) / m


def _grow(sample: pd.DataFrame) -> pd.DataFrame:
    """One tree over at most 256 values: the path length of every interval of the line."""
    name, tree = sample["column"].iloc[0], int(sample["tree"].iloc[0])
    values = np.sort(sample["v"].to_numpy())
    rng = np.random.default_rng([tree, len(values)])
    limit = math.ceil(math.log2(max(2, len(values))))
    steps, todo = [], [(-math.inf, values, 0)]
    while todo:
        left, part, depth = todo.pop()
        if depth >= limit or part[0] == part[-1]:
            steps.append((left, depth + _rest(len(part)) - 0.0))
            continue
        cut = rng.uniform(part[0], part[-1])
        at = int(np.searchsorted(part, cut, side="left")) or 1
        todo += [(cut, part[at:], depth + 1), (left, part[:at], depth + 1)]
    out = pd.DataFrame(steps, columns=["start", "depth"]).sort_values("start", ignore_index=True)
    return out.assign(column=name, tree=tree, size=len(values), step=out["depth"].diff().fillna(out["depth"]))


def forest_steps(df: DataFrame, cols: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """``(column, start, score)``: the forest of each column as a step function.

    Each tree grows on its own 256-row hash sample of the table, in parallel over columns and
    trees. A tree over one column only cuts the line into intervals, so a forest has at most
    100 x 256 steps, whatever the size of the table.
    """
    keys = list(key) or df.columns
    pool = sample_rows(nan_to_null(df).select(*dict.fromkeys([*cols, *keys])), TREES * TREE_ROWS, keys)
    h = F.xxhash64(*[col(k) for k in keys])
    rows = pool.count()
    if rows >= TREES * TREE_ROWS:  # disjoint samples
        place = F.row_number().over(Window.orderBy(h, *[col(k) for k in keys]))  # a bounded sample
        dealt = pool.withColumn("tree", (place % TREES).cast("int"))
    else:
        each = pool.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in range(TREES)])))
        own = F.row_number().over(Window.partitionBy("tree").orderBy(F.xxhash64(h, "tree"), h))
        dealt = each.withColumn("_r", own).where(F.col("_r") <= TREE_ROWS).drop("_r")
    long = inline_rows(dealt, [{"column": F.lit(c), "v": as_double(c)} for c in cols], ["tree"]).where("v is not null")
    trees = long.groupBy("column", "tree").applyInPandas(
        _grow, "column string, tree int, start double, depth double, size long, step double")
    shape = trees.groupBy("column").agg(F.count_distinct("tree").alias("trees"), F.max("size").alias("size"))
    edges = trees.groupBy("column", "start").agg(F.sum("step").alias("step"))
    run = Window.partitionBy("column").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    m = F.col("size").cast("double")
    norm = F.when(m > 1, 2 * (F.log(m - 1) + EULER) - 2 * (m - 1) / m).otherwise(1.0)
    norm = F.when(m == 2, 1.0).otherwise(norm)
    depth = F.sum("step").over(run)
    return edges.withColumn("depth", depth).join(F.broadcast(shape), "column").select(
        "column", "start", F.pow(F.lit(2.0), -F.col("depth") / F.col("trees") / norm).alias("score"))


def forest_scores(values: DataFrame, steps: DataFrame) -> DataFrame:
    """Add ``score`` to ``(column, v, ...)`` rows: 0.5 is ordinary, towards 1 is isolated."""
    found = steps.toPandas().sort_values(["column", "start"])  # at most 25 600 rows per column
    table = {c: (g["start"].to_numpy(), g["score"].to_numpy()) for c, g in found.groupby("column")}
    shared = values.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("double")
    def score(column: pd.Series, v: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=v.index)
        for name in column.unique():
            mine = column == name
            starts, scores = shared.value[name]
            out[mine] = scores[np.searchsorted(starts, v[mine].to_numpy(), side="right") - 1]
        return out

    return values.withColumn("score", score("column", "v"))


# --- local outlier factor ------------------------------------------------------------------


def _neighbour_count(n: int) -> int:
    return min(NEIGHBOURS_MAX, max(NEIGHBOURS_MIN, n // NEIGHBOURS_SHARE))


def _nearest_on_line(v: np.ndarray, c: np.ndarray, k: int, rows: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, distances and weights of the k nearest rows of some of the sorted distinct values."""
    at = np.arange(rows.start, rows.stop)[:, None] + np.arange(-k, k + 1)[None, :]
    real = (at >= 0) & (at < len(v))
    at = np.where(real, at, 0)
    apart = np.where(real, np.abs(v[at] - v[rows][:, None]), np.inf)
    copies = np.where(real, c[at], 0)
    copies[:, k] -= 1  # a row is not its own neighbour
    order = np.argsort(apart, axis=1, kind="stable")
    at, apart, copies = (np.take_along_axis(x, order, 1) for x in (at, apart, copies))
    before = np.cumsum(copies, axis=1) - copies
    weight = np.clip(k - before, 0, copies)
    return at, np.where(weight > 0, apart, 0.0), weight


def _lof_of(k: int):
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("v", ignore_index=True)
        v, c = rows["v"].to_numpy(), rows["c"].to_numpy()
        parts = [slice(i, min(i + LOF_CHUNK, len(v))) for i in range(0, len(v), LOF_CHUNK)]
        reach, density, factor = (np.empty(len(v)) for _ in range(3))
        for p in parts:
            _, apart, _ = _nearest_on_line(v, c, k, p)
            reach[p] = apart.max(axis=1)
        for p in parts:
            at, apart, weight = _nearest_on_line(v, c, k, p)
            density[p] = 1 / ((weight * np.maximum(reach[at], apart)).sum(axis=1) / k + LRD_FLOOR)
        for p in parts:
            at, _, weight = _nearest_on_line(v, c, k, p)
            factor[p] = (weight * density[at]).sum(axis=1) / k / density[p]
        return rows.assign(lof=factor).loc[rows["own"], ["v", "c", "lof"]]
    return block


def lof_scores(values: DataFrame, k: int, rows_per_bucket: int | None = None) -> DataFrame:
    """Add ``lof`` to the counted values ``(v, c)`` of one column.

    On a line the k nearest values lie within k places of the sorted order. The values are cut into
    range buckets; each bucket also gets the 3k values beside it, which is as far as three
    neighbour steps reach, so every bucket is scored by itself.
    """
    cut = bucketed(values.select("v", "c"), "v", "_b", rows_per_bucket or LOF_ROWS)
    near_order, halo = Window.partitionBy("_b").orderBy("v"), 3 * k
    by_bucket = Window.orderBy("_b")  # one row per bucket
    beside = cut.select("_b").distinct().select(
        "_b", F.lag("_b").over(by_bucket).alias("_prev"), F.lead("_b").over(by_bucket).alias("_next"))
    first = cut.withColumn("_r", F.row_number().over(near_order)).where(F.col("_r") <= halo).drop("_r")
    last = cut.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(F.desc("v")))).where(
        F.col("_r") <= halo).drop("_r")
    lent = (first.join(F.broadcast(beside), "_b").select("v", "c", F.col("_prev").alias("_b"))
            .unionByName(last.join(F.broadcast(beside), "_b").select("v", "c", F.col("_next").alias("_b")))
            .where("_b is not null"))
    blocks = cut.withColumn("own", F.lit(True)).unionByName(lent.withColumn("own", F.lit(False)))
    return blocks.groupBy("_b").applyInPandas(_lof_of(k), "v double, c long, lof double")


# --- flags ---------------------------------------------------------------------------------


def _above_share(scored: DataFrame, score: str, out: str) -> DataFrame:
    """Flag the values whose score exceeds the (1 - contamination) quantile over all rows."""
    bound = grouped_quantiles(scored, ["column"], score, [1 - CONTAMINATION], weight="c").select(
        "column", F.get("q", F.lit(0)).alias("_bound"))  # one row per column
    return scored.join(F.broadcast(bound), "column").withColumn(out, F.col(score) > F.col("_bound")).drop("_bound")


def forest_flags(df: DataFrame, cols: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    scored = forest_scores(counted_values(df, cols), forest_steps(df, cols, key))
    return _above_share(scored, "score", "is_outlier")


def lof_flags(df: DataFrame, cols: Sequence[str], rows_per_bucket: int | None = None) -> DataFrame:
    parts = []
    sizes = {r["column"]: r["n"] for r in counted_values(df, cols).groupBy("column").agg(F.sum("c").alias("n")).collect()}
    for c in cols:
        if sizes.get(c, 0) > 1:
            one = counted_values(df, [c])
            k = min(_neighbour_count(sizes[c]), sizes[c] - 1)
            parts.append(lof_scores(one, k, rows_per_bucket).withColumn("column", F.lit(c)))
    return _above_share(reduce(DataFrame.unionByName, parts), "lof", "is_outlier")


def _mark(df: DataFrame, name: str, flags: DataFrame, out: str) -> DataFrame:
    marked = flags.where("is_outlier").select(F.col("v").alias("_v"))
    joined = small_join(df, marked, as_double(name) == F.col("_v"))
    return joined.withColumn(out, F.col("_v").isNotNull()).drop("_v")


def outlier_isolation_forest(df: DataFrame, name: str, key: Sequence[str] = (), out: str = "is_outlier") -> DataFrame:
    """Flag the 5 % most isolated values of a column."""
    return _mark(df, name, forest_flags(df, [name], key), out)


def outlier_lof(df: DataFrame, name: str, out: str = "is_outlier") -> DataFrame:
    """Flag the 5 % of values with the largest local outlier factor."""
    return _mark(df, name, lof_flags(df, [name]), out)


def outlier_ensemble(df: DataFrame, key: Sequence[str] = (), cols: Sequence[str] | None = None) -> DataFrame:
    """Share of rows flagged by each of four detectors and by at least three of them, per column."""
    names = list(cols) if cols is not None else numeric_columns(df)
    counts = counted_values(df, names)
    facts = counts.groupBy("column").agg(
        F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    names = [r["column"] for r in facts.where(F.col("n") >= MIN_VALUES).collect()]
    if not names:
        return facts.where("false").select("column")
    gap = F.col("v") - F.col("mean")
    spread = counts.join(F.broadcast(facts), "column").groupBy("column", "n", "mean").agg(
        F.sqrt(F.sum(F.col("c") * gap * gap) / F.sum("c")).alias("std"))
    quart = grouped_quantiles(counts, ["column"], "v", [0.25, 0.75], weight="c")
    table = spread.join(quart, "column")  # one row per column
    q1, q3 = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    z = F.coalesce(F.abs(gap) > Z_LIMIT * F.col("std"), F.lit(False))
    iqr = (F.col("v") < q1 - IQR_FACTOR * (q3 - q1)) | (F.col("v") > q3 + IQR_FACTOR * (q3 - q1))
    flagged = forest_flags(df, names, key).select("column", "v", "c", F.col("is_outlier").alias("forest"))
    lof = lof_flags(df, names).select("column", "v", F.col("is_outlier").alias("lof"))
    rows = flagged.join(lof, ["column", "v"]).join(F.broadcast(table), "column").select(
        "column", "n", "c", z.alias("z"), iqr.alias("iqr"), "forest", "lof")
    votes = sum((F.col(f).cast("int") for f in ("z", "iqr", "forest", "lof")), F.lit(0))

    def share(test: Column) -> Column:
        return 100 * F.sum(F.when(test, F.col("c")).otherwise(0)) / F.max("n")

    return rows.groupBy("column").agg(
        share(votes >= VOTES).alias("outlier_pct"), share(F.col("z")).alias("zscore_pct"), share(F.col("iqr")).alias("iqr_pct"),
        share(F.col("forest")).alias("forest_pct"), share(F.col("lof")).alias("lof_pct"))
