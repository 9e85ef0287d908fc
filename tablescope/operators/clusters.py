"""Density clusters (DBSCAN) by grid cells, and connected components."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.checkpoints import checkpointed
from tablescope.functions.columns import as_double, col, nan_to_null, scalar_stats
from tablescope.functions.indexing import sorted_index
from tablescope.operators.transform import small_join

NOISE = -1
GRID_DIMS = 3  # cell numbers that neighbours are looked up by; the others only decide


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``; the root is the smallest node.

    Alternates large-star and small-star steps, which takes a logarithmic number of rounds. Each
    round is a grouped minimum and a join; neighbour lists are never gathered.
    """
    both = edges.where("a <> b")
    current = checkpointed(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _mark(current)
    while True:
        around = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = around.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(
            "a <> b").distinct()
        large = checkpointed(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a")
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            moved.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        current = checkpointed(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = _mark(current)
        if now == seen:
            break
        seen = now
    nodes = both.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = current.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.join(roots, F.col("node") == F.col("a"), "left").select("node", F.coalesce("root", "node").alias("root"))


def _distance2(dims: Sequence[str], left: str, right: str) -> Column:
    return sum(((F.col(f"{left}.{d}") - F.col(f"{right}.{d}")) * (F.col(f"{left}.{d}") - F.col(f"{right}.{d}")) for d in dims), F.lit(0.0))


def _near_cells(d: int) -> list[tuple[int, ...]]:
    """Offsets, in the first cell numbers, of the cells that can hold a point within eps; the side is eps / sqrt(d)."""
    reach = math.ceil(math.sqrt(d))
    gap = lambda o: max(0, abs(o) - 1)
    return [o for o in itertools.product(range(-reach, reach + 1), repeat=min(d, GRID_DIMS)) if sum(gap(x) ** 2 for x in o) <= d]


def _shifted(cells: Sequence[str], offsets: Sequence[tuple[int, ...]]) -> Column:
    return F.explode(F.array(*[F.struct(*[(F.col(c) + o).alias(c) for c, o in zip(cells, off)]) for off in offsets]))


def _linked_cells(core: DataFrame, dims: Sequence[str], cells: Sequence[str], side: float, eps: float) -> DataFrame:
    """Pairs of cells with core points within eps, found by halving boxes instead of comparing points.

    Two boxes farther apart than eps are dropped, two boxes wholly within eps settle their cells;
    only the rest is cut in half and looked at again. A box of one point is always decided.
    """
    eps2 = eps * eps * (1 + 1e-12)

    def boxes(level: int) -> DataFrame:
        width = side / 2 ** level
        subs = [F.floor(F.col(d) / width).alias(f"s{i}") for i, d in enumerate(dims)]
        ups = [F.floor(F.col(d) / (width * 2)).alias(f"u{i}") for i, d in enumerate(dims)]
        return core.select(*cells, *subs, *ups, *dims).groupBy(
            *cells, *[f"s{i}" for i in range(len(dims))], *[f"u{i}" for i in range(len(dims))]).agg(
            *[F.min(d).alias(f"lo{i}") for i, d in enumerate(dims)], *[F.max(d).alias(f"hi{i}") for i, d in enumerate(dims)])

    def packed(b: DataFrame) -> DataFrame:
        r = range(len(dims))
        return b.select(F.struct(*cells).alias("cell"), F.struct(*[F.col(f"s{i}").alias(f"k{i}") for i in r]).alias("sub"),
                        F.struct(*[F.col(f"u{i}").alias(f"k{i}") for i in r]).alias("up"),
                        F.struct(*[f"lo{i}" for i in r], *[f"hi{i}" for i in r]).alias("box"))

    def judged(pairs: DataFrame) -> DataFrame:
        low = high = F.lit(0.0)
        for i in range(len(dims)):
            al, ah, bl, bh = (F.col(f"{t}.{e}{i}") for t in ("box_a", "box_b") for e in ("lo", "hi"))
            apart = F.greatest(F.lit(0.0), bl - ah, al - bh)
            far = F.greatest(bh - al, ah - bl)
            low, high = low + apart * apart, high + far * far
        return pairs.withColumn("_low", low).withColumn("_high", high).where(F.col("_low") <= eps2)

    start = packed(boxes(0))
    grid = cells[:GRID_DIMS]
    asked = start.select(
        F.col("cell").alias("cell_a"), F.col("sub").alias("sub_a"), F.col("box").alias("box_a"),
        *[F.col(f"cell.{c}").alias(c) for c in grid]).withColumn("_to", _shifted(grid, _near_cells(len(dims)))).drop(*grid)
    other = start.select(F.struct(*[F.col(f"cell.{c}").alias(c) for c in grid]).alias("_to"), F.col("cell").alias("cell_b"),
                         F.col("sub").alias("sub_b"), F.col("box").alias("box_b"))
    pairs = checkpointed(judged(asked.join(other, "_to").where(F.col("cell_a") < F.col("cell_b")).drop("_to")))
    linked, level = None, 0
    while True:
        sure = checkpointed(pairs.where(F.col("_high") <= eps2).select("cell_a", "cell_b").distinct())
        linked = sure if linked is None else checkpointed(linked.unionByName(sure))
        open_ = pairs.where(F.col("_high") > eps2).join(sure, ["cell_a", "cell_b"], "left_anti")
        if open_.isEmpty():
            return linked
        level += 1
        child = packed(boxes(level))
        a = child.select(F.col("cell").alias("cell_a"), F.col("up").alias("sub_a"), F.col("sub").alias("next_a"), F.col("box").alias("box_a"))
        b = child.select(F.col("cell").alias("cell_b"), F.col("up").alias("sub_b"), F.col("sub").alias("next_b"), F.col("box").alias("box_b"))
        grown = open_.select("cell_a", "sub_a", "cell_b", "sub_b").join(a, ["cell_a", "sub_a"]).join(b, ["cell_b", "sub_b"])
        pairs = checkpointed(judged(grown.select(
            "cell_a", F.col("next_a").alias("sub_a"), "box_a", "cell_b", F.col("next_b").alias("sub_b"), "box_b")))


def cluster_dbscan(df: DataFrame, features: Sequence[str], eps: float = 0.5, min_pts: int = 5, scale: bool = True) -> DataFrame:
    """Rows with ``cluster`` 0..k-1, or -1 for noise, over standardised features.

    Cells have a diagonal of eps: points of a cell holding ``min_pts`` rows are core points without
    any comparison, and the others are fewer than ``min_pts`` per cell, so the points compared grow
    linearly with the table. A border point joins the first of the clusters it touches.
    """
    if not features:
        raise ValueError("at least one feature is needed")
    data = nan_to_null(df).dropna(subset=list(features))
    dims = [f"x{i}" for i in range(len(features))]
    if scale:
        stats = scalar_stats(data, **{f"{m}{i}": f(as_double(c)) for i, c in enumerate(features)
                                      for m, f in (("mean", F.avg), ("std", F.stddev_pop))})
        placed = data.withColumn("_s", stats).withColumns({
            d: (as_double(c) - F.col(f"_s.mean{i}")) / F.coalesce(F.nullif(F.col(f"_s.std{i}"), F.lit(0.0)), F.lit(1.0))
            for i, (d, c) in enumerate(zip(dims, features))}).drop("_s")
    else:
        placed = data.withColumns({d: as_double(c) for d, c in zip(dims, features)})
    side = eps / math.sqrt(len(dims))
    cells = [f"c{i}" for i in range(len(dims))]
    grid = cells[:GRID_DIMS]
    points = checkpointed(placed.groupBy(*dims).agg(F.count("*").alias("n")).withColumns(
        {c: F.floor(F.col(d) / side) for c, d in zip(cells, dims)}))
    eps2 = eps * eps * (1 + 1e-12)
    sizes = points.groupBy(*cells).agg(F.sum("n").alias("size"))
    sized = points.join(sizes, cells)
    sparse = sized.where(F.col("size") < min_pts).select(*dims, *cells)
    # fewer than min_pts points per sparse cell look at their surroundings
    asking = sparse.select(*dims, _shifted(grid, _near_cells(len(dims))).alias("_to")).select(
        *dims, *[F.col(f"_to.{c}").alias(c) for c in grid])
    hits = asking.alias("q").join(points.alias("p"), [F.col(f"q.{c}") == F.col(f"p.{c}") for c in grid]).where(
        _distance2(dims, "q", "p") <= eps2)
    own = [F.col(f"q.{d}").alias(d) for d in dims]
    busy = hits.groupBy(*own).agg(F.sum("p.n").alias("around")).where(F.col("around") >= min_pts).select(*dims)
    core = checkpointed(sized.where(F.col("size") >= min_pts).select(*dims, *cells).unionByName(
        sparse.join(busy, dims, "left_semi").select(*dims, *cells)))
    links = _linked_cells(core, dims, cells, side, eps)
    alone = core.select(F.struct(*cells).alias("node")).distinct()
    grown = connected_components(links.select(F.col("cell_a").alias("a"), F.col("cell_b").alias("b")))
    roots = alone.join(grown, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    names = sorted_index(roots.select("root").distinct(), "root", "cluster")
    labels = checkpointed(small_join(roots, names.withColumnRenamed("root", "_root"), F.col("root") == F.col("_root")).select(
        *[F.col(f"node.{c}").alias(c) for c in cells], F.col("cluster").cast("int").alias("cluster")))
    of_core = core.join(labels, cells).select(*dims, *cells, "cluster")
    loose = sparse.join(core.select(*dims), dims, "left_anti")
    asking = loose.select(*dims, _shifted(grid, _near_cells(len(dims))).alias("_to")).select(
        *dims, *[F.col(f"_to.{c}").alias(c) for c in grid])
    border = asking.alias("q").join(of_core.alias("p"), [F.col(f"q.{c}") == F.col(f"p.{c}") for c in grid]).where(
        _distance2(dims, "q", "p") <= eps2).groupBy(*own).agg(F.min("p.cluster").alias("cluster"))
    found = of_core.select(*dims, "cluster").unionByName(border)
    return placed.join(found, dims, "left").select(
        *[col(c) for c in df.columns], F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    """``(cluster, size)`` with noise as cluster -1."""
    return labelled.groupBy("cluster").agg(F.count("*").alias("size"))
