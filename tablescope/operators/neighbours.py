"""Exact nearest neighbours, and what is built on them: kNN imputation and kNN prediction.

Points may lack coordinates: the distance runs over those that both have, scaled up for the others. A bounded set of donors is
broadcast. More donors are sorted along a Z-order curve of quantile ranks, points with the same gaps together, and cut into boxes of
boxes: each box keeps the range of every coordinate, which bounds the distance of all its points from below. A query takes a first
bound from the nearest boxes on its way down, then visits every box that isn't beyond the bound. One search serves all patterns of gaps,
levels are joined on the number of the box above, and no candidate is left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.checkpoints import checkpointed
from tablescope.functions.columns import as_double, col, nan_to_null, numeric_columns, scalar_stats

BROADCAST_DONORS = 20_000
MOST_DONORS = 100_000      # broadcast all the same if they make up to
MOST_PAIRS = 3_000_000_000 # pairs with the queries, which cost less than boxes do
BROADCAST_BYTES = 8 << 20  # of boxes
SAMPLE_DONORS = 256        # donors in a smallest box
GROWTH = 64                # boxes in the box above
FIRST_BOXES = 2            # boxes per level that give a query its first bound
DONORS_PER_RANGE = 500_000
CODE_BITS = 60             # of the Z-order code, shared by the coordinates
CHUNK = 4_000_000  # distances held at once in a task
PAIRS = 1_000_000  # queries times donors that a task joins


def _order(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_d2", "_payload")


def first_k(found: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Keep the nearest donors of each query until ``k`` rows are covered; ``_take`` counts them.

    The rank filter is pushed below the shuffle, so a query sends at most ``k`` rows per task.
    """
    order = _order(keys)
    top = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    before = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    return top.withColumn("_left", F.lit(k) - before).where("_left > 0").withColumn(
        "_take", F.least("_left", "_n")).drop("_r", "_left")


def _names(kind: str, width: int) -> list[str]:
    return [f"{kind}{i}" for i in range(width)]


def _total(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _squares(gaps: Sequence[Column], shared: Sequence[Column]) -> tuple[Column, Column]:
    """Sum of squared gaps (NULL counts as zero) scaled to all coordinates, and how many coordinates are shared."""
    both = _total([s.cast("int") for s in shared])
    return _total([F.coalesce(g * g, F.lit(0.0)) for g in gaps]) * (F.lit(float(len(gaps))) / both), both


def _against(asks: DataFrame, donors: DataFrame, width: int, k: int) -> DataFrame:
    """Candidates from a counted, small donor table held by every task."""
    xs, ys = _names("x", width), _names("y", width)
    held = donors.select(*ys, "_payload", "_n").toPandas().sort_values(["_payload", *ys])  # bounded by the caller
    shared = asks.sparkSession.sparkContext.broadcast((held[[*ys, "_payload"]].to_numpy(float), held["_n"].to_numpy()))
    whole = bool(held[ys].notna().to_numpy().all())

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, count = shared.value
        keep, step = min(k, len(table)), max(1, CHUNK // max(1, len(table)))
        columns = [np.ascontiguousarray(table[:, i]) for i in range(width)]
        for batch in batches if len(table) else ():
            x, wanted = batch[xs].to_numpy(float), batch["_j"].to_numpy()
            for start in range(0, len(x), step):
                part, j = x[start:start + step], wanted[start:start + step]
                payload = table[:, j].T  # -1 is the last column, the payload of its own
                d2 = np.zeros((len(part), len(table)))
                if whole and not np.isnan(part).any():  # every coordinate is shared
                    for i in range(width):
                        gap = part[:, i, None] - columns[i]
                        gap *= gap
                        d2 += gap
                    d2[np.isnan(payload)] = np.inf
                else:
                    both = np.zeros((len(part), len(table)))
                    for i in range(width):
                        gap = part[:, i, None] - columns[i]
                        d2 += np.where(np.isnan(gap), 0.0, gap * gap)
                        both += ~np.isnan(gap)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        d2 = np.where((both > 0) & ~np.isnan(payload), d2 * (width / both), np.inf)
                bound = np.partition(d2, keep - 1, axis=1)[:, keep - 1]
                row, donor = np.nonzero((d2 <= bound[:, None]) & np.isfinite(d2))
                yield pd.DataFrame(part[row], columns=xs).assign(
                    _j=j[row], _payload=payload[row, donor], _n=count[donor], _d2=d2[row, donor])

    schema = ", ".join(f"{x} double" for x in xs) + ", _j int, _payload double, _n long, _d2 double"
    return nan_to_null(asks.select(*xs, "_j").mapInPandas(search, schema))


def bit_order(spreads: Sequence[float], bits: int) -> list[int]:
    """The coordinate that gives each next bit of a code: the one whose cells are widest so far, up to ``bits`` times each."""
    left, out = [(-s, i, 0) for i, s in enumerate(spreads)], []
    while left:
        width, i, used = min(left)
        left.remove((width, i, used))
        out.append(i)
        if used + 1 < bits:
            left.append((width / 2, i, used + 1))
    return out


def _z_order(donors: DataFrame, ys: Sequence[str]) -> Column:
    """Place on a Z-order curve through the quantile ranks of the coordinates; wide coordinates are halved before narrow ones, so that
    boxes come out about as long as they are broad."""
    bits = max(1, min(10, CODE_BITS // len(ys)))
    used = list(ys)[:CODE_BITS]
    probs = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = [np.array(c) for c in donors.approxQuantile(used, probs, 0.25 / (1 << bits))]  # at most 1023 numbers each
    spread = lambda c: float(c[-1] - c[0]) if len(c) and np.isfinite(c[-1] - c[0]) else 0.0
    turns = bit_order([spread(c) for c in cuts], bits)

    def code(*columns: pd.Series) -> pd.Series:
        ranks = [np.where(np.isnan(v), 0, np.searchsorted(c, v)) for c, v in zip(cuts, (s.to_numpy(float) for s in columns))]
        out = np.zeros(len(columns[0]), np.int64)
        left = [bits] * len(ranks)
        for i in turns:
            left[i] -= 1
            out = (out << 1) | (ranks[i] >> left[i] & 1)
        return pd.Series(out)

    return F.pandas_udf(code, "bigint")(*used)


def _boxed(donors: DataFrame, width: int, leaf: int, fan: int) -> tuple[DataFrame, list[tuple[DataFrame, int]]]:
    """Donors with the number of their box, and per level, top first, the boxes with ``_up`` and an upper limit of their count.

    A box has per coordinate the least and largest value, whether all points have it, and the rows that do.
    """
    ys = _names("y", width)
    gaps = F.concat(*[F.col(y).isNull().cast("int").cast("string") for y in ys])
    order = ["_gaps", "_z", *ys, "_payload"]
    ranges = max(1, -(-donors.count() // DONORS_PER_RANGE))
    placed = checkpointed(
        donors.withColumns({"_gaps": gaps, "_z": _z_order(donors, ys)}).repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order).drop("_gaps", "_z")
        .withColumns({"_part": F.spark_partition_id().cast("bigint"), "_at": F.monotonically_increasing_id()}))
    in_part = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    longest = int(placed.agg(F.max(in_part)).first()[0] or 0).bit_length()
    places = longest + (ranges - 1).bit_length()
    placed = placed.withColumn("_box", F.shiftright(F.shiftleft("_part", longest) + in_part, leaf)).drop("_part", "_at")
    boxes = checkpointed(placed.groupBy("_box").agg(
        *[F.min(y).alias(f"lo{i}") for i, y in enumerate(ys)], *[F.max(y).alias(f"hi{i}") for i, y in enumerate(ys)],
        *[F.bool_and(F.col(y).isNotNull()).alias(f"all{i}") for i, y in enumerate(ys)],
        *[F.sum(F.when(F.col(y).isNotNull(), F.col("_n")).otherwise(0)).alias(f"rows{i}") for i, y in enumerate(ys)],
        F.sum(F.when(F.col("_payload").isNotNull(), F.col("_n")).otherwise(0)).alias("rows")))
    levels = []
    left = places - leaf
    while True:
        levels.append((boxes.withColumn("_up", F.shiftright("_box", fan)), 1 << max(0, left)))
        left -= fan
        if left <= 0:
            return placed, levels[::-1]
        boxes = boxes.groupBy(F.shiftright("_box", fan).alias("_box")).agg(
            *[f(f"{n}{i}").alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max), ("all", F.bool_and), ("rows", F.sum))
              for i in range(width)], F.sum("rows").alias("rows"))


def _down(asks: DataFrame, level: tuple[DataFrame, int], width: int) -> DataFrame:
    """Queries with the boxes below theirs that hold a wanted value, and ``_least``, which no distance in the box is below."""
    boxes, limit = level
    xs = _names("x", width)
    boxes = boxes.withColumnRenamed("_box", "_below")
    if limit * (3 * width + 2) * 8 <= BROADCAST_BYTES:
        boxes = F.broadcast(boxes)
    met = asks.join(boxes, F.col("_box") == F.col("_up"))
    gaps = [F.when(F.col(f"all{i}"), F.greatest(F.col(f"lo{i}") - F.col(x), F.col(x) - F.col(f"hi{i}"), F.lit(0.0)))
            for i, x in enumerate(xs)]
    # greatest() passes over NULL: a missing coordinate of the query has no gap
    gaps = [F.when(F.col(x).isNotNull(), g) for x, g in zip(xs, gaps)]
    least, both = _squares(gaps, [F.col(x).isNotNull() & F.col(f"lo{i}").isNotNull() for i, x in enumerate(xs)])
    held = F.coalesce(*[F.when(F.col("_j") == i, F.col(f"rows{i}")) for i in range(width)], F.col("rows"))
    return met.withColumns({"_both": both, "_held": held}).where("_both > 0 AND _held > 0").select(
        *asks.drop("_box").columns, F.col("_below").alias("_box"), least.alias("_least"), "_held")


def _inside(asks: DataFrame, placed: DataFrame, width: int, leaf: int) -> DataFrame:
    """Distances of queries to the donors of their boxes, of up to 2 ** ``leaf`` donors. A task gets about ``PAIRS`` of them: a box with
    many queries has its queries in pieces, and its donors once per piece."""
    xs = _names("x", width)
    asks = checkpointed(asks)
    most = max(1, PAIRS >> leaf >> 2)   # queries in a piece
    tasks = max(1, -(-(asks.count() << leaf) // PAIRS))
    pieces = asks.groupBy("_box").agg((1 + F.floor(F.count("*") / most)).cast("int").alias("_pieces"))
    pieces = pieces.withColumnRenamed("_box", "_up")
    spread = F.pmod(F.xxhash64(*xs, "_j"), F.col("_pieces")).cast("int")
    split = asks.join(pieces, F.col("_box") == F.col("_up")).withColumn("_piece", spread).drop("_pieces", "_up").repartition(
        tasks, "_box", "_piece")
    held = placed.withColumnRenamed("_box", "_up").join(pieces, "_up").withColumn(
        "_of", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces").repartition(tasks, "_up", "_of")
    met = split.join(held.hint("merge"), (F.col("_box") == F.col("_up")) & (F.col("_piece") == F.col("_of")))
    payload = F.coalesce(F.col("_payload"), *[F.when(F.col("_j") == i, F.col(f"y{i}")) for i in range(width)])
    gaps = [F.col(x) - F.col(f"y{i}") for i, x in enumerate(xs)]
    d2, both = _squares(gaps, [g.isNotNull() for g in gaps])
    kept = ["_bound"] if "_bound" in asks.columns else []
    return met.withColumns({"_value": payload, "_both": both}).where("_value IS NOT NULL AND _both > 0").select(
        *xs, "_j", *kept, F.col("_value").alias("_payload"), "_n", d2.alias("_d2"))


def _search(asks: DataFrame, donors: DataFrame, width: int, k: int, broadcast_limit: int | None = None,
            sample: int | None = None) -> DataFrame:
    """First ``k`` donors of each distinct query: (x..., _j, _payload, _n, _d2, _take).

    ``asks`` has x0... and ``_j``, the coordinate whose value is wanted or -1 for ``_payload``; ``donors`` has y0..., ``_payload`` and
    ``_n``, the rows a donor stands for. ``sample`` is the number of donors in a smallest box.
    """
    xs = _names("x", width)
    keys = [*xs, "_j"]
    held = donors.count()
    if held <= (BROADCAST_DONORS if broadcast_limit is None else broadcast_limit):
        return first_k(_against(asks, donors, width, k), keys, k)
    if broadcast_limit is None and held <= MOST_DONORS:
        asks = checkpointed(asks.select(*keys))
        pairs = asks.count() * held
        if pairs <= MOST_PAIRS:
            tasks = max(1, -(-pairs // CHUNK // 4))
            return first_k(_against(asks.repartition(min(tasks, 200), *keys), donors, width, k), keys, k)
    leaf, fan = (max(1, (n - 1).bit_length()) for n in (SAMPLE_DONORS if sample is None else sample, GROWTH))
    placed, levels = _boxed(checkpointed(donors), width, leaf, fan)
    asks = checkpointed(asks.select(*keys))

    first = asks.withColumn("_box", F.lit(0).cast("bigint"))
    nearest_boxes = Window.partitionBy(*keys).orderBy(F.desc(F.col("_held") >= k), "_least", "_box")
    for level in levels:
        first = _down(first, level, width).withColumn("_r", F.row_number().over(nearest_boxes)).where(
            F.col("_r") <= FIRST_BOXES).drop("_r", "_least", "_held")
    seen = first_k(_inside(first, placed, width, leaf), keys, k).groupBy(*keys).agg(
        F.sum("_take").alias("_seen"), F.max("_d2").alias("_bound"))
    # fewer than k rows give no bound
    bounds = seen.select(*[F.col(c).alias(f"b{c}") for c in keys], F.when(F.col("_seen") >= k, F.col("_bound")).alias("_bound"))
    same = [F.col(c).eqNullSafe(F.col(f"b{c}")) for c in keys]
    within = checkpointed(asks.join(bounds, same, "left").select(*keys, "_bound")).withColumn("_box", F.lit(0).cast("bigint"))
    for level in levels:
        within = _down(within, level, width).where("_bound IS NULL OR _least <= _bound").drop("_least", "_held")
    found = _inside(within, placed, width, leaf).where("_bound IS NULL OR _d2 <= _bound").drop("_bound")
    return first_k(found, keys, k)


def nearest(queries: DataFrame, donors: DataFrame, dims: Sequence[str], k: int, broadcast_limit: int | None = None,
            sample: int | None = None) -> DataFrame:
    """``(dims..., _payload, _n, _d2, _take)``: per distinct query point its first ``k`` donors.

    Donors are ordered by distance, then payload. ``dims`` hold no NULL; ``_payload`` is a double.
    """
    ys = _names("y", len(dims))
    asks = queries.select(*[F.col(d).alias(f"x{i}") for i, d in enumerate(dims)]).distinct().withColumn("_j", F.lit(-1))
    counted = donors.select(*[F.col(d).alias(y) for d, y in zip(dims, ys)], "_payload").where("_payload IS NOT NULL").groupBy(
        *ys, "_payload").agg(F.count("*").alias("_n"))
    # of donors at one point only the first k payloads can ever be taken
    at_point = Window.partitionBy(*ys).orderBy("_payload")
    counted = counted.withColumn("_r", F.row_number().over(at_point)).where(F.col("_r") <= k).drop("_r")
    found = _search(asks, counted, len(dims), k, broadcast_limit, sample)
    return found.select(*[F.col(f"x{i}").alias(d) for i, d in enumerate(dims)], "_payload", "_n", "_d2", "_take")


# --- imputation ----------------------------------------------------------------------------


def impute_knn(df: DataFrame, cols: Sequence[str] | None = None, k: int = 5, **limits: int) -> DataFrame:
    """Fill numeric columns with the mean of the ``k`` nearest rows that have the value.

    Distance is Euclidean over the columns both rows have, scaled up for the missing ones. Rows
    that share no column with any donor get the column mean.
    """
    data = nan_to_null(df)
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not cols:
        return data
    width = len(cols)
    xs = _names("x", width)
    points = data.select(*[as_double(c).alias(x) for c, x in zip(cols, xs)]).groupBy(*xs).agg(F.count("*").alias("_n"))
    gaps = F.filter(F.array(*[F.when(F.col(x).isNull(), F.lit(i)) for i, x in enumerate(xs)]), lambda i: i.isNotNull())
    asks = points.where(F.coalesce(*xs).isNotNull()).select(*xs, F.explode(gaps).alias("_j"))
    donors = points.select(*[F.col(x).alias(f"y{i}") for i, x in enumerate(xs)], F.lit(None).cast("double").alias("_payload"), "_n")
    best = _search(asks, donors, width, k, **limits)
    mean = F.sum(F.col("_payload") * F.col("_take")) / F.sum("_take")
    per = best.groupBy(*xs, "_j").agg(mean.alias("_fill"))
    filled = per.groupBy(*xs).agg(*[F.max(F.when(F.col("_j") == j, F.col("_fill"))).alias(f"f{j}") for j in range(width)])
    means = scalar_stats(data, **{f"m{i}": F.avg(as_double(c)) for i, c in enumerate(cols)})
    same = [as_double(c).eqNullSafe(F.col(f"f.{x}")) for c, x in zip(cols, xs)]
    out = data.withColumn("_s", means).alias("d").join(filled.alias("f"), same, "left")
    made = {c: F.coalesce(as_double(c), F.col(f"f{i}"), F.col(f"_s.m{i}")) for i, c in enumerate(cols)}
    return out.select(*[made[c].alias(c) if c in made else col(c) for c in data.columns])


# --- prediction ----------------------------------------------------------------------------


def predict_knn(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, task: str, k: int = 5,
                **limits: int) -> DataFrame:
    """Vote or mean of the ``k`` nearest training rows in standardised features.

    Equal votes go to the smallest label. Rows with a missing feature get no prediction.
    """
    stats = scalar_stats(train, **{f"{m}{i}": f(as_double(c)) for i, c in enumerate(features)
                                   for m, f in (("mean", F.avg), ("std", F.stddev_pop))})

    def scaled(df: DataFrame) -> DataFrame:
        with_s = nan_to_null(df).withColumn("_s", stats)
        return with_s.withColumns({
            f"x{i}": (as_double(c) - F.col(f"_s.mean{i}")) / F.coalesce(F.nullif(F.col(f"_s.std{i}"), F.lit(0.0)), F.lit(1.0))
            for i, c in enumerate(features)}).drop("_s")

    dims = [f"x{i}" for i in range(len(features))]
    givers = scaled(train).withColumn("_payload", as_double(target)).dropna(subset=[*dims, "_payload"])
    asked = scaled(test)
    hits = nearest(asked.dropna(subset=dims), givers, dims, k, **limits)
    if task == "classification":
        votes = hits.groupBy(*dims, "_payload").agg(F.sum("_take").alias("_votes"))
        answer = votes.groupBy(*dims).agg(F.min_by("_payload", F.struct(-F.col("_votes"), "_payload")).alias("prediction"))
    else:
        answer = hits.groupBy(*dims).agg((F.sum(F.col("_payload") * F.col("_take")) / F.sum("_take")).alias("prediction"))
    return asked.join(answer, dims, "left").select(*[col(c) for c in test.columns], "prediction")
