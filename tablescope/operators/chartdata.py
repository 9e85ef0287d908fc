"""The data behind each chart, reduced on the cluster to what has to be drawn."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.columns import (
    as_double, col, inline_rows, nan_to_null, numeric_columns, require_columns,
    scalar_stats, text_columns, to_long,
)
from tablescope.functions.quantiles import grouped_quantiles
from tablescope.operators.aggregate import _aggregate, label_counts, lookup_join, null_counts, union_distinct_nodes
from tablescope.operators.profile import top_labels
from tablescope.operators.stats import correlation_matrix, correlation_pairs
from tablescope.functions.indexing import sorted_index
from tablescope.sources.io import sample_rows

# Sizes the charts are drawn with.
HISTOGRAM_BINS = 30
RIDGE_TOP, RIDGE_BINS, RIDGE_MIN = 8, 40, 10
PIE_TOP = 10
NETWORK_THRESHOLD = 0.7
POINTS = 10_000
DASHBOARD_CHARTS = 20


def series(df: DataFrame, x: str, y: str, color: str | None = None, agg: str | None = None,
           sort: str | None = None) -> DataFrame:
    """``x, y[, color]`` of a bar, line, area, radar or funnel chart, optionally aggregated and sorted."""
    keys = [x] + ([color] if color and color != x else [])
    require_columns(df, [*keys, y])
    out = df.select(*{*keys, y})
    if agg:
        if agg == "median":
            kept = out.dropna(subset=keys)
            found = grouped_quantiles(kept, keys, y, [0.5])
            out = found.select(*keys, F.get("q", F.lit(0)).alias(y))
        else:
            out = out.dropna(subset=keys).groupBy(*[col(k) for k in keys]).agg(_aggregate(agg, y, None).alias(y))
    if sort:
        out = out.orderBy(F.asc_nulls_last(col(y)) if sort == "asc" else F.desc_nulls_last(col(y)))
    return out


bar_data = line_data = area_data = radar_data = funnel_data = series


def points(df: DataFrame, x: str, y: str, z: str | None = None, size: str | None = None,
           color: str | None = None, n: int = POINTS, key: Sequence[str] = ()) -> DataFrame:
    """At most ``n`` points of a scatter, bubble or 3-D scatter chart, the same ones on every run."""
    wanted = list(dict.fromkeys(c for c in (x, y, z, size, color) if c))
    require_columns(df, wanted)
    kept = df.select(*dict.fromkeys([*wanted, *key]))
    return sample_rows(kept, n, key or wanted).select(*[col(c) for c in wanted])


scatter_points = bubble_points = scatter3d_points = points


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin number; the last bin is closed on the right."""
    place = F.floor(F.try_divide((x - lo) * bins, hi - lo))
    return F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("int")


def histogram_data(df: DataFrame, cols: Sequence[str] | None = None, bins: int = HISTOGRAM_BINS,
                   color: str | None = None) -> DataFrame:
    """``(column[, color], bin, bin_start, bin_end, count)`` of the numeric columns."""
    cols = list(cols) if cols else numeric_columns(df)
    data = nan_to_null(df.select(*dict.fromkeys([*cols, *([color] if color else [])])))
    ends = scalar_stats(data, **{f"{m}{i}": f(as_double(c)) for i, c in enumerate(cols)
                                 for m, f in (("lo", F.min), ("hi", F.max))})
    ranged = data.withColumn("_e", ends)
    long = inline_rows(ranged, [
        {"column": F.lit(c), "value": as_double(c), "lo": F.col(f"_e.lo{i}"), "hi": F.col(f"_e.hi{i}")}
        for i, c in enumerate(cols)], [color] if color else []).where("value is not null")
    keys = ["column"] + ([color] if color else [])
    counted = long.groupBy(*keys, "lo", "hi", _bin(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(
        F.count("*").alias("count"))
    width = (F.col("hi") - F.col("lo")) / bins
    return counted.select(*keys, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"),
                          (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"), "count")


def box_data(df: DataFrame, y: str, x: str | None = None, color: str | None = None) -> DataFrame:
    """Quartiles, whiskers (outermost values inside 1.5 IQR) and outlier count per group."""
    keys = list(dict.fromkeys(c for c in (x, color) if c))
    data = nan_to_null(df.select(*keys, as_double(y).alias("_y"))).dropna()
    if not keys:
        data, keys = data.withColumn("group", F.lit("all")), ["group"]
    quart = grouped_quantiles(data, keys, "_y", [0.25, 0.5, 0.75])
    fenced = quart.select(*keys, F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"),
                          F.get("q", F.lit(2)).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("_y").between(F.col("q1") - reach, F.col("q3") + reach)
    return data.join(fenced, keys).groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_y"))).alias("whisker_low"), F.max(F.when(inside, F.col("_y"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"), F.count("*").alias("n"))


def _densities(data: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """``(keys..., bin, center, count, density)`` of column ``_v`` over each group's own range."""
    ranges = data.groupBy(*keys).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("n"))
    binned = data.groupBy(*keys, "_v").agg(F.count("*").alias("c")).join(ranges, list(keys)).groupBy(
        *keys, "lo", "hi", "n", _bin(F.col("_v"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(
        F.sum("c").alias("count"))
    # a group with one value is drawn over a range of one, as the histogram convention has it
    lo = F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5)
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) / bins
    place = F.when(F.col("hi") > F.col("lo"), F.col("bin")).otherwise(bins // 2)
    return binned.select(*keys, place.cast("int").alias("bin"), (lo + (place + 0.5) * width).alias("center"), "count",
                         (F.col("count") / (F.col("n") * width)).alias("density"))


def violin_data(df: DataFrame, y: str, x: str | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Density of ``y`` per group over equal-width bins; :func:`box_data` gives the box inside."""
    keys = [x] if x else ["group"]
    made = col(x) if x else F.lit("all")
    data = nan_to_null(df.select(made.alias(keys[0]), as_double(y).alias("_v"))).dropna()
    return _densities(data, keys, bins)


def ridge_data(df: DataFrame, x: str, by: str, top: int = RIDGE_TOP, bins: int = RIDGE_BINS) -> DataFrame:
    """Density of ``x`` for the most frequent categories that hold enough values."""
    data = nan_to_null(df.select(col(by).cast("string").alias(by), as_double(x).alias("_v"))).where(col(by).isNotNull())
    sizes = data.groupBy(by).agg(F.count("*").alias("rows"), F.count("_v").alias("present"))
    picked = sizes.orderBy(F.desc("rows"), by).limit(top).where(F.col("present") >= RIDGE_MIN).select(by)
    kept = data.where("_v is not null").join(F.broadcast(picked), by)  # at most ``top`` rows
    return _densities(kept, [by], bins)


def heatmap_data(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return correlation_matrix(df, list(cols) if cols else numeric_columns(df))


def pie_data(df: DataFrame, name: str, n: int = PIE_TOP) -> DataFrame:
    counts = df.where(col(name).isNotNull()).groupBy(col(name).cast("string").alias("value")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "value").limit(n)


def density2d_data(df: DataFrame, x: str, y: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts per cell of an equal-width grid over both columns."""
    data = nan_to_null(df.select(as_double(x).alias("x"), as_double(y).alias("y"))).dropna()
    e = scalar_stats(data, x0=F.min("x"), x1=F.max("x"), y0=F.min("y"), y1=F.max("y"))
    ranged = data.withColumn("_e", e)
    return ranged.groupBy(
        _bin(F.col("x"), F.col("_e.x0"), F.col("_e.x1"), bins).alias("x_bin"),
        _bin(F.col("y"), F.col("_e.y0"), F.col("_e.y1"), bins).alias("y_bin")).agg(F.count("*").alias("count"))


def treemap_data(df: DataFrame, x: str, y: str) -> DataFrame:
    """Sum of ``y`` per ``x``; the colour is the mean of ``y`` weighted by itself."""
    v = as_double(y)
    return df.where(col(x).isNotNull()).groupBy(col(x).alias("label")).agg(
        F.sum(v).alias("value"), F.try_divide(F.sum(v * v), F.sum(v)).alias("color"))


def sunburst_data(df: DataFrame, path: Sequence[str], y: str) -> DataFrame:
    """Sum of ``y`` at every level of a path of columns; NULL marks the levels below."""
    kept = df.dropna(subset=list(path))
    return kept.rollup(*[col(p) for p in path]).agg(
        F.grouping_id().alias("level"), F.sum(as_double(y)).alias("value")).where(
        F.col("level") < (1 << len(path)) - 1).drop("level")


def parallel_coords_data(df: DataFrame, cols: Sequence[str] | None = None, color: str | None = None,
                         n: int = POINTS, key: Sequence[str] = ()) -> DataFrame:
    """All or the named numeric columns of the same rows on every run, with an optional colour column."""
    nums = numeric_columns(df)
    used = [c for c in cols or [] if c in nums] or nums
    wanted = list(dict.fromkeys([*used, *([color] if color in df.columns else [])]))
    kept = df.select(*dict.fromkeys([*wanted, *key]))
    return sample_rows(kept, n, key or wanted).select(*[col(c) for c in wanted])


def correlation_network(df: DataFrame, threshold: float = NETWORK_THRESHOLD, cols: Sequence[str] | None = None) -> DataFrame:
    """Edges between strongly correlated columns."""
    pairs = correlation_pairs(df, cols).select("a", "b", F.abs("corr").alias("weight"))
    return pairs.where(F.col("weight") >= threshold).orderBy(F.desc("weight"), "a", "b")


def network_nodes(edges: DataFrame) -> DataFrame:
    return union_distinct_nodes(edges, "a", "b").orderBy("node")


def sankey_data(df: DataFrame, source: str, target: str, value: str) -> DataFrame:
    """Links between numbered nodes with the summed value."""
    flows = df.select(col(source).cast("string").alias("source"), col(target).cast("string").alias("target"),
                      as_double(value).alias("value")).dropna(subset=["source", "target"])
    links = flows.groupBy("source", "target").agg(F.sum("value").alias("value"))
    nodes = sorted_index(union_distinct_nodes(links, "source", "target"), "node", "place")
    out = lookup_join(links, nodes, "source", "node", "place", "source_index")
    return lookup_join(out, nodes, "target", "node", "place", "target_index")


def timeline_data(df: DataFrame, start: str, end: str, name: str, color: str | None = None) -> DataFrame:
    """Intervals with their length in seconds."""
    wanted = list(dict.fromkeys([start, end, name, *([color] if color else [])]))
    return df.select(*[col(c) for c in wanted],
                     F.timestamp_diff("SECOND", col(start), col(end)).alias("seconds")).where(
        col(start).isNotNull() & col(end).isNotNull())


def facet(op: Callable[..., DataFrame], df: DataFrame, by: str, **args: Any) -> DataFrame:
    """The same chart for every label of ``by``, in one pass: the label is one more grouping key."""
    return op(df.where(col(by).isNotNull()), color=by, **args)


def missing_bar(df: DataFrame, n: int = 20) -> DataFrame:
    return null_counts(df).where("nulls > 0").select("column", F.col("null_pct").alias("missing_pct")).orderBy(
        F.desc("missing_pct"), "column").limit(n)


def category_bar(df: DataFrame, cols: Sequence[str] | None = None, n: int = 10, with_null: bool = False) -> DataFrame:
    """Most frequent labels of the text columns."""
    cols = list(cols) if cols else text_columns(df)
    if not with_null:
        return top_labels(df, cols, n)
    counts = label_counts(df, cols).withColumn("value", F.coalesce("value", F.lit("None")))
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(
        "column", "rank", "value", "count")


def recommend_chart(df: DataFrame) -> tuple[str, tuple[str, ...]]:
    """Chart kind and its columns, from the families of the columns alone."""
    nums, texts = numeric_columns(df), text_columns(df)
    if len(nums) >= 2:
        return "scatter", (nums[0], nums[1])
    if nums:
        return "histogram", (nums[0],)
    if texts:
        return "bar", (texts[0],)
    raise ValueError("no numeric or text column to draw")


Spec = tuple[str, str | None, str | None]


def dashboard_specs(df: DataFrame) -> list[Spec]:
    """The twenty charts of the overview page as ``(kind, x, y)``."""
    nums, texts = numeric_columns(df), text_columns(df)
    neighbours = [(a, b) for a, b in zip(nums, nums[1:])][:3]
    specs: list[Spec] = [("histogram", c, None) for c in nums[:4]]
    specs += [("box", c, None) for c in nums[:3]] + [("bar", c, None) for c in texts[:3]]
    specs += [("scatter", a, b) for a, b in neighbours]
    specs += [(kind, c, None) for kind in ("violin", "density") for c in nums[:1]]
    specs += [("pie", c, None) for c in texts[:1]] + [("line", c, None) for c in nums[:1]]
    if len(nums) > 1:
        specs += [("area", nums[0], nums[1]), ("heatmap", None, None)]
    specs.append(("missing", None, None))
    while nums and len(specs) < DASHBOARD_CHARTS:
        specs.append(("histogram", nums[0], None))
    return specs[:DASHBOARD_CHARTS]


def dashboard(df: DataFrame, specs: Sequence[Spec] | None = None, key: Sequence[str] = (), n_points: int = 500) -> DataFrame:
    """Data of many charts in one long form ``(chart, kind, label, series, x, y)``.

    Charts of one kind share one pass over the table: all histograms, all boxes and all bars are
    one aggregate each.
    """
    specs = list(specs) if specs else dashboard_specs(df)
    nulls = F.lit(None)

    def kind_of(*kinds: str) -> list[tuple[int, Spec]]:
        return [(i, s) for i, s in enumerate(specs) if s[0] in kinds]

    def shaped(source: DataFrame, chart: Column, kind: Column, label: Column, series_: Column, x: Column, y: Column) -> DataFrame:
        return source.select(chart.cast("int").alias("chart"), kind.alias("kind"), label.cast("string").alias("label"),
                             series_.cast("string").alias("series"), x.cast("double").alias("x"), y.cast("double").alias("y"))

    def spread(source: DataFrame, picks: list[tuple[int, Spec]], column: str) -> DataFrame:
        """One copy of a column's rows for every chart drawn from it."""
        uses: dict[str, list] = {}
        for i, s in picks:
            uses.setdefault(s[1], []).append(F.struct(F.lit(i).alias("chart"), F.lit(s[0]).alias("kind")))
        table = F.create_map(*[x for c, u in uses.items() for x in (F.lit(c), F.array(*u))])
        return source.select("*", F.inline(table[F.col(column)]))

    parts = []
    hist = kind_of("histogram", "density", "violin")
    if hist:
        h = spread(histogram_data(df, list(dict.fromkeys(s[1] for _, s in hist))), hist, "column")
        parts.append(shaped(h, F.col("chart"), F.col("kind"), F.col("column"), nulls, F.col("bin_start"), F.col("count")))
    boxes = kind_of("box")
    if boxes:
        long = to_long(nan_to_null(df), list(dict.fromkeys(s[1] for _, s in boxes)), "double").where("value is not null")
        b = spread(box_data(long, "value", "column"), boxes, "column")
        b = inline_rows(b, [{"series": F.lit(m), "y": F.col(m)} for m in ("whisker_low", "q1", "median", "q3", "whisker_high")],
                        ["chart", "kind", "column"])
        parts.append(shaped(b, F.col("chart"), F.col("kind"), F.col("column"), F.col("series"), nulls, F.col("y")))
    bars = kind_of("bar", "pie")
    if bars:
        top = spread(top_labels(df, list(dict.fromkeys(s[1] for _, s in bars)), PIE_TOP), bars, "column")
        top = top.where("kind <> 'pie' or rank <= 8")
        parts.append(shaped(top, F.col("chart"), F.col("kind"), F.col("value"), F.col("column"), F.col("rank"), F.col("count")))
    for i, (kind, x, y) in kind_of("scatter"):
        p = points(df, x, y, n=n_points, key=key)
        parts.append(shaped(p, F.lit(i), F.lit(kind), nulls, nulls, col(x), col(y)))
    for i, (kind, x, y) in kind_of("line", "area"):
        names = [c for c in (x, y) if c]
        order = list(key) or names
        picked = sample_rows(df.select(*dict.fromkeys([*names, *order])), n_points, order)
        placed = sorted_index(picked.withColumn("_o", F.struct(*[col(k) for k in order])), "_o", "_place")
        for c in names:
            parts.append(shaped(placed, F.lit(i), F.lit(kind), nulls, F.lit(c), F.col("_place"), col(c)))
    for i, _ in kind_of("heatmap"):
        r = heatmap_data(df)
        parts.append(shaped(r, F.lit(i), F.lit("heatmap"), F.col("a"), F.col("b"), nulls, F.col("corr")))
    for i, _ in kind_of("missing"):
        m = missing_bar(df, 10)
        parts.append(shaped(m, F.lit(i), F.lit("missing"), F.col("column"), nulls, nulls, F.col("missing_pct")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
