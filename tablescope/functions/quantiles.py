"""Exact quantiles (linear interpolation) for groups of any size.

Sorting a group in one task is the fastest way for groups of a proven bounded size and impossible
for a group holding a third of a 100 TB table. Groups above ``EXACT_GROUP_ROWS`` rows are therefore
solved by narrowing: distinct values are counted in parallel, split into cells by an approximate
grid, the cells holding the wanted ranks are found from exact cell counts, and only those cells are
looked at again, until a cell is small enough to be sorted. Unweighted rows start from brackets: a
sketch gives two values around every wanted rank, exact counts check them, and only the values in
between are counted one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.checkpoints import checkpointed
from tablescope.functions.columns import as_double, col, inline_rows, long_agg, to_long

EXACT_GROUP_ROWS = 1_000_000
EXACT_CELLS = 8_000_000
BROADCAST_ROWS = 100_000
GRID = 200
SKETCH = 4_000
MARGIN = 2 / SKETCH  # share of the rows between a wanted rank and either end of its bracket


def _probs(probs: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(p)) for p in probs])


def _values(c: Column) -> Column:
    """All non-null values of a group; only for groups of a checked size."""
    return F.collect_list(c)


def _pick(values: Column, probs: Sequence[float]) -> Column:
    """Interpolated order statistics of an array; NULL for an empty one."""
    ordered = F.sort_array(values)

    def at(v: Column, p: float) -> Column:
        pos = (F.size(v) - 1) * F.lit(float(p))
        low, high = F.get(v, F.floor(pos).cast("int")), F.get(v, F.ceil(pos).cast("int"))
        return low + (high - low) * (pos - F.floor(pos))

    picked = F.transform(F.array(ordered), lambda v: F.array(*[at(v, p) for p in probs]))  # sorts once
    return F.when(F.size(values) > 0, F.get(picked, F.lit(0)))


def _quantiles_of(probs: Sequence[float]):
    """Aggregate over one Arrow column of a checked size; missing values are left out."""
    wanted = [float(p) for p in probs]

    def quantiles(values: pd.Series) -> list:
        present = values.to_numpy()
        present = present[~np.isnan(present)]
        return np.quantile(present, wanted).tolist() if len(present) else None

    return F.pandas_udf(quantiles, "array<double>")


def fits_one_task(df: DataFrame, n_columns: int) -> bool:
    rows = df.count()
    return rows <= EXACT_GROUP_ROWS and rows * n_columns <= EXACT_CELLS


def wide_percentiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``(column, q)`` with ``q`` the array of quantiles.

    A table counted as small goes through one task as Arrow columns in a single pass.
    """
    if fits_one_task(df, len(cols)):
        quantiles = _quantiles_of(probs)
        wide = df.select(*[as_double(c).alias(f"c{i}") for i, c in enumerate(cols)]).agg(
            *[quantiles(f"c{i}").alias(f"q{i}") for i in range(len(cols))])
        return inline_rows(wide, [{"column": F.lit(c), "q": F.col(f"q{i}")} for i, c in enumerate(cols)])
    found, missed = _wide_bracketed(df, cols, probs, EXACT_GROUP_ROWS)
    if missed:
        long = to_long(df, missed, "double").where(~F.isnan("value"))
        found = found.unionByName(grouped_quantiles(long, ["column"], "value", probs))
    names = inline_rows(df.sparkSession.range(1), [{"column": F.lit(c)} for c in cols])
    return names.join(F.broadcast(found), "column", "left")


def agg_with_quantiles(df: DataFrame, cols: Sequence[str], metrics: dict[str, Callable[[str], Column]],
                       probs: Sequence[float]) -> DataFrame:
    """``long_agg`` plus an array ``q`` of exact quantiles per column.

    The two stay apart because an aggregate that gathers values runs without generated code.
    """
    found = wide_percentiles(df, cols, probs)  # one row per column
    return long_agg(df, cols, metrics).join(F.broadcast(found), "column") if metrics else found


def quantile_map(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> Column:
    """Map from column name to its array of quantiles, as a scalar subquery."""
    found = agg_with_quantiles(df, cols, {}, probs)
    entries = F.map_from_entries(F.collect_list(F.struct("column", "q")))  # one entry per column
    return found.agg(entries.alias("q")).scalar()


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    limit: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """``(keys..., q)``: exact quantiles of ``value`` per group; NULL values are left out.

    With ``weight`` (a row count) every row stands for that many equal rows.
    """
    limit = EXACT_GROUP_ROWS if limit is None else limit
    data = df.select(*[col(k) for k in keys], as_double(value).alias("_v"),
                     (col(weight) if weight else F.lit(1)).cast("bigint").alias("_c")).where("_v is not null")
    size = [F.sum("_c").alias("_n"), F.count("*").alias("_rows")]
    sizes = data.groupBy(*keys).agg(*size)
    largest = sizes.agg(F.max("_rows")).first()[0] or 0
    exact = F.percentile("_v", _probs(probs), F.col("_c")).alias("q")
    if largest <= limit and weight is None:
        return data.groupBy(*keys).agg(_values(F.col("_v")).alias("q")).withColumn("q", _pick(F.col("q"), probs))
    if largest <= limit:
        return data.groupBy(*keys).agg(exact)

    # keys travel as one struct, in which NULL fields compare as equal
    keyed = data.select(F.struct(*[col(k) for k in keys]).alias("_k"), "_v", "_c")
    hot = checkpointed(sizes.where(F.col("_rows") > limit).select(F.struct(*[col(k) for k in keys]).alias("_k"), "_n"))
    if hot.count() <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    small = keyed.join(hot, "_k", "left_anti").groupBy("_k").agg(exact)
    frequent = keyed.join(hot, "_k", "left_semi")
    big = _bracketed(keyed, hot, probs, limit) if weight is None else None
    if big is None:
        counted = frequent.groupBy("_k", "_v").agg(F.sum("_c").alias("_c")).persist(StorageLevel.DISK_ONLY)
        try:
            big = checkpointed(_narrow(counted, _targets(hot, ["_k"], probs), ["_k"], limit))
        finally:
            counted.unpersist()
    return small.unionByName(big).select(*[F.col(f"_k.`{k}`").alias(k) for k in keys], "q")


def _bracket_probs(probs: Sequence[float]) -> list[float]:
    return [x for p in probs for x in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]


def _cells(batches: Iterator[pa.RecordBatch], edges: Sequence[np.ndarray], held: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows per column and cell (no value), and the values of the ``held`` cells with their rows in a batch."""
    total = [np.zeros(len(e) + 1, np.int64) for e in edges]

    def made(i, cell, value, rows):
        return [pa.array(np.full(len(rows), i, np.int32)), pa.array(cell, pa.int32()), pa.array(value, pa.float64()), pa.array(rows)]

    def one(parts):
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts)], ["i", "cell", "v", "c"])

    for b in batches:
        parts = []
        for i, e in enumerate(edges):
            v = b.column(i).to_numpy(zero_copy_only=False).astype(np.float64)
            v = v[~np.isnan(v)]
            cell = np.searchsorted(e, v, "left")
            total[i] += np.bincount(cell, minlength=len(e) + 1)
            value, rows = np.unique(v[held[i][cell]], return_counts=True)
            parts.append(made(i, [None] * len(value), value, rows.astype(np.int64)))
        yield one(parts)
    yield one([made(i, np.arange(len(t)), [None] * len(t), t) for i, t in enumerate(total)])


def _wide_bracketed(df: DataFrame, cols: Sequence[str], probs: Sequence[float], limit: int) -> tuple[DataFrame, list[str]]:
    """``(column, q)`` of the columns that hold values, and the columns left out as a bracket misses its rank.

    Two scans: a sketch per column, then exact counts of the cells between the ends of all brackets along with the
    values inside. The driver gets a few numbers per column and probability.
    """
    spark = df.sparkSession
    data = df.select(*[F.nanvl(as_double(c), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    row = data.agg(*[f for i in range(len(cols)) for f in (
        F.count(f"c{i}"), F.percentile_approx(f"c{i}", _bracket_probs(probs), SKETCH))]).first()
    edges, held, brackets = [], [], []
    for i in range(len(cols)):
        ends = np.array(row[2 * i + 1] or [], float).reshape(-1, 2)
        under = np.nextafter(ends[:, 0], -np.inf)  # a bracket is (under, hi]
        edge = np.unique([*under, *ends[:, 1]])
        first, last = np.searchsorted(edge, under) + 1, np.searchsorted(edge, ends[:, 1])
        inside = np.zeros(len(edge) + 1, bool)
        for a, z in zip(first, last):
            inside[a:z + 1] = True
        edges.append(edge)
        held.append(inside)
        brackets.append(list(zip(under, ends[:, 1], first, last)))
    found = checkpointed(data.mapInArrow(partial(_cells, edges=edges, held=held), "i int, cell int, v double, c bigint")
                         .groupBy("i", "cell", "v").agg(F.sum("c").alias("c")))
    sums = [np.zeros(len(e) + 1, np.int64) for e in edges]
    for r in found.where("cell is not null").collect():
        sums[r["i"]][r["cell"]] = r["c"]
    targets, missed = [], []
    for i, c in enumerate(cols):
        mine, n = [], row[2 * i]
        for j, (under, hi, first, last) in enumerate(brackets[i]):
            below, upto, pos = int(sums[i][:first].sum()), int(sums[i][:last + 1].sum()), float(probs[j]) * (n - 1)
            mine += [(c, j, pos, side, rank, float(under), float(hi), below, -np.inf < under and below <= rank < upto)
                     for side, rank in enumerate((int(np.floor(pos)), int(np.ceil(pos))))]
        if all(m[-1] for m in mine):
            targets += [m[:-1] for m in mine]
        else:
            missed.append(c)
    names = F.array(*[F.lit(c) for c in cols])
    counted = found.where("cell is null").select(F.get(names, F.col("i")).alias("column"), F.col("v").alias("_v"), F.col("c").alias("_c"))
    made = spark.createDataFrame(targets, "column string, _i int, _pos double, _s int, _rank bigint, _lo double, _hi double, _below bigint")
    return checkpointed(_narrow(counted, made, ["column"], limit)), missed


def _bracketed(keyed: DataFrame, hot: DataFrame, probs: Sequence[float], limit: int) -> DataFrame | None:
    """``(_k, q)`` of the hot groups from brackets around their ranks; None if a bracket misses its rank."""
    sides = range(len(probs))
    bounds = keyed.join(hot, "_k").groupBy("_k").agg(
        F.max("_n").alias("_n"), F.percentile_approx("_v", _bracket_probs(probs), SKETCH).alias("_g"))
    bounds = checkpointed(bounds)
    few = bounds.count() <= BROADCAST_ROWS
    ended = keyed.join(F.broadcast(bounds) if few else bounds, "_k")
    lo, hi = (lambda j: F.get("_g", F.lit(2 * j))), (lambda j: F.get("_g", F.lit(2 * j + 1)))
    seen = ended.groupBy("_k").agg(
        F.first("_n").alias("_n"), F.first("_g").alias("_g"),
        F.array(*[F.count_if(F.col("_v") < lo(j)) for j in sides]).alias("_below"),
        F.array(*[F.count_if(F.col("_v") <= hi(j)) for j in sides]).alias("_upto"))
    at = lambda name: F.get(name, F.col("_i"))
    low = F.get("_g", 2 * F.col("_i"))
    # the next smaller double, or one soon after it, so that the bracket holds its low end
    under = low - F.abs(low) * F.lit(2.3e-16) - F.lit(5e-324)
    targets = checkpointed(_targets(seen, ["_k"], probs, keep=["_g", "_below", "_upto"]).select(
        "_k", "_i", "_pos", "_s", "_rank", under.alias("_lo"), F.get("_g", 2 * F.col("_i") + 1).alias("_hi"),
        at("_below").alias("_below"), at("_upto").alias("_upto")))
    sure = (F.abs("_lo") < float("inf")) & (F.col("_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto"))
    if targets.where(~F.coalesce(sure, F.lit(False))).count():
        return None
    inside = reduce(Column.__or__, [F.col("_v").between(lo(j), hi(j)) for j in sides])
    counted = checkpointed(ended.where(inside).groupBy("_k", "_v").agg(F.sum("_c").alias("_c")))
    return checkpointed(_narrow(counted, targets.drop("_upto"), ["_k"], limit))


def _targets(hot: DataFrame, keys: Sequence[str], probs: Sequence[float], keep: Sequence[str] | None = None) -> DataFrame:
    """Both ranks wanted per probability; the value lies in (_lo, _hi], _below rows are <= _lo."""
    spots = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(float(p)).alias("_p"))
                      for i, p in enumerate(probs)])
    kept = keep or ["_lo", "_hi", "_below"]
    start = hot if keep else hot.withColumns({
        "_lo": F.lit(-float("inf")), "_hi": F.lit(float("inf")), "_below": F.lit(0).cast("bigint")})
    return (
        start.select(*keys, "_n", *kept, F.inline(spots))
        .withColumn("_pos", F.col("_p") * (F.col("_n") - 1))
        .select(*keys, "_i", "_pos", *kept, F.inline(F.array(
            F.struct(F.lit(0).alias("_s"), F.floor("_pos").alias("_rank")),
            F.struct(F.lit(1).alias("_s"), F.ceil("_pos").alias("_rank")),
        )))
    )


def _narrow(counted: DataFrame, targets: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Order statistics of the hot groups from their ``(keys, value, count)`` table."""
    inf = float("inf")
    targets = checkpointed(targets)
    wanted = [*keys, "_i", "_s"]
    while True:
        inside = _inside(counted, targets, keys)
        width = inside.groupBy(*wanted).agg(F.count("*").alias("_d")).agg(F.max("_d")).first()[0]
        if width <= limit:
            break
        grid = checkpointed(inside.groupBy(*wanted).agg(
            F.percentile_approx("_v", [j / GRID for j in range(GRID + 1)], 10 * GRID).alias("_grid")))
        celled = (
            _inside(counted, targets, keys)
            .join(F.broadcast(grid) if grid.count() <= BROADCAST_ROWS else grid, wanted)
            .withColumn("_cell", F.size(F.filter("_grid", lambda s: s < F.col("_v"))))
        )
        cells = celled.groupBy(*wanted, "_rank", "_below", "_cell").agg(
            F.sum("_c").alias("_c"), F.max("_v").alias("_top"), F.min("_v").alias("_bottom"))
        order = Window.partitionBy(*wanted).orderBy("_cell")
        running = F.sum("_c").over(order)
        cells = (
            cells.withColumn("_upto", F.col("_below") + running)
            .withColumn("_prev", F.coalesce(F.lag("_top").over(order), F.lit(-inf)))
            .withColumn("_left", F.col("_upto") - F.col("_c"))
            .where((F.col("_left") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto")))
        )
        old = targets.select(*wanted, "_pos", F.col("_rank").alias("_r0"), F.col("_lo").alias("_lo0"))
        targets = checkpointed(
            old.join(cells, wanted).select(
                *keys, "_i", "_pos", "_s", "_rank",
                F.greatest("_lo0", "_prev").alias("_lo"), F.col("_top").alias("_hi"),
                F.col("_left").alias("_below")))
    order = Window.partitionBy(*wanted).orderBy("_v")
    found = (
        inside.withColumn("_upto", F.col("_below") + F.sum("_c").over(order))
        .where((F.col("_upto") - F.col("_c") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto")))
    )
    low, high = F.max(F.when(F.col("_s") == 0, F.col("_v"))), F.max(F.when(F.col("_s") == 1, F.col("_v")))
    part = F.first("_pos") - F.floor(F.first("_pos"))
    per_prob = found.groupBy(*keys, "_i").agg((low + (high - low) * part).alias("_q"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_q")))  # one entry per probability
    return per_prob.groupBy(*keys).agg(F.transform(ordered, lambda s: s["_q"]).alias("q"))


def _inside(counted: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    small = F.broadcast(targets) if targets.count() <= BROADCAST_ROWS else targets
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    on += [F.col("c._v") > F.col("t._lo"), F.col("c._v") <= F.col("t._hi")]
    kept = [F.col(f"t.{k}") for k in keys]
    return counted.alias("c").join(small.alias("t"), on).select(
        *kept, "t._i", "t._s", "t._pos", "t._rank", "t._below", "c._v", "c._c")
