"""Mix sources to target weights: cube-method balanced sampling.

Each document of a source gets the same expected number of copies, target / source size. Its whole part
is taken outright; the rest is an inclusion probability. The flight phase moves the probabilities of three
documents at a time along the null space of the two balancing constraints (sum of sizes, number of
documents), so both totals stay exact while documents become 0 or 1. It runs per block of a source; the at
most two undecided documents of each block meet in the next round, until one small landing problem per source
is left (these and a dozen documents held back for it). There the rounding closest to the expected totals is taken.

Defined results: null text has size 0; a null source is a source of its own, sorted last; a source without words
has target 0 and its documents are taken 0 times; repeated rows are documents of their own; an empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.common import column, count_words, numbered, pieces, shared_folder, write

BLOCK = 4096
FAN = 256
HELD = 12  # documents per source left to the landing beside the at most two open ones
EPS = 1e-9


def flight(sizes: np.ndarray, probs: np.ndarray, seed: str) -> np.ndarray:
    """Move ``probs`` to 0 or 1, keeping sum(probs) and sum(sizes * probs); at most two stay between."""
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "big"))
    p = probs.astype(float).tolist()
    s = sizes.tolist()
    draws = iter(rng.random(len(p) + 3).tolist())
    active: list[int] = []
    for i in range(len(p)):
        if EPS < p[i] < 1 - EPS:
            active.append(i)
        while len(active) == 3:
            a, b, c = active
            u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
            if u == (0, 0, 0):
                u = (1, -1, 0)
            up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(active, u) if d)
            down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(active, u) if d)
            step = up if next(draws, 0.5) * (up + down) < down else -down
            for j, d in zip(active, u):
                p[j] += step * d
            rest = []
            for j in active:
                if p[j] <= EPS:
                    p[j] = 0.0
                elif p[j] >= 1 - EPS:
                    p[j] = 1.0
                else:
                    rest.append(j)
            active = rest
    return np.round(np.array(p), 12)


def land(sizes: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Round the few open probabilities to the outcome nearest in total size, then in number."""
    open_ = np.flatnonzero((probs > EPS) & (probs < 1 - EPS))
    out = np.where(probs >= 1 - EPS, 1.0, 0.0)
    if len(open_):
        words, count = float(sizes[open_] @ probs[open_]), float(probs[open_].sum())
        masks = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        best = min(range(len(masks)), key=lambda m: (abs(masks[m] @ sizes[open_] - words), abs(masks[m].sum() - count), m))
        out[open_] = masks[best]
    return out


def source_targets(sized: DataFrame, weights: Sequence[int], ceiling: float) -> DataFrame:
    """Per source its size, its target and its expected copies: a share by weight, at most ``ceiling`` sizes.

    The excess of sources at the ceiling goes to the others by weight until none is above: every target is
    min(ceiling * size, level * weight), and the level is found among the sources sorted by ceiling / weight.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(ceiling))
    order = Window.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - before) / after
    per = per.withColumn("level", level).withColumn(
        "final", F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(everything))
    share = F.coalesce(F.col("final") * F.col("weight"), F.col("most"))
    target = F.least(F.col("most"), share)
    copies = F.when(F.col("source_size") > 0, F.round(target / F.col("source_size"), 12)).otherwise(0.0)
    return per.select("source", "source_size", "n_docs", target.alias("target"), copies.alias("copies"))


def mix_sources(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source",
                weights: Sequence[int] = (1, 2, 3), ceiling: float = 3.0, seed: str = "mix") -> DataFrame:
    """One row per document: key, size, source_size, target, taken (words), copies, source."""
    spark = docs.sparkSession

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), b.column("source"), b.column("spread"), pa.array(count_words(b.column("text")), pa.int64())],
                ["doc", "source", "spread", "size"])

    plain = docs.select(column(key).alias("doc"), column(source).alias("source"), column(text).alias("text"),
                        F.xxhash64(column(key), column(text)).alias("spread"))
    kind = plain.schema["doc"].dataType.simpleString()
    root = shared_folder(spark, "mix")
    sized, row = numbered(plain.mapInArrow(measure, f"doc {kind}, source string, spread bigint, size bigint"), f"{root}/sizes")
    targets = write(source_targets(sized, weights, ceiling).coalesce(1), f"{root}/targets")
    most = targets.agg(F.max("n_docs")).first()[0] or 0

    open_ = (sized.join(targets.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own")))
             .withColumn("p", F.col("copies") - F.floor("copies"))
             .select(F.col(row).alias("row"), "source", "spread", "size", "p", "n_docs"))
    # a block of a source: a hash of its documents, so that no group holds more than about BLOCK of them
    open_ = open_.withColumn("block", F.expr(f"pmod(spread, ceil(n_docs / {BLOCK}))"))
    blocks, level, decided = max(1, -(-most // BLOCK)), 0, []
    while True:
        last = blocks == 1
        step = write(_fly(open_, f"{seed}/{level}", last), f"{root}/level{level}")
        decided.append(step.where("p = 0 OR p = 1").select("row", "p"))
        if last:
            break
        level, blocks = level + 1, -(-blocks // FAN)
        open_ = step.where("p > 0 AND p < 1").withColumn(
            "block", F.lit(0).cast("bigint") if blocks == 1 else F.expr(f"floor(block / {FAN})"))
    chosen = decided[0]
    for more in decided[1:]:
        chosen = chosen.union(more)
    result = (sized.join(targets.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own")))
              .join(chosen.withColumnRenamed("row", row), row)
              .withColumn("n", (F.floor("copies") + F.col("p")).cast("long")))
    return result.select(F.col("doc").alias(key), "size", "source_size", "target",
                         (F.col("size") * F.col("n")).alias("taken"), F.col("n").alias("copies"), "source")


def _fly(open_: DataFrame, seed: str, last: bool) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "spread", "row"], ascending=[False, True, True], kind="stable")
        name = f"{seed}/{group['source'].iloc[0]}/{group['block'].iloc[0]}"
        sizes = group["size"].to_numpy()
        p = group["p"].to_numpy(dtype=float, copy=True)
        moving = np.flatnonzero((p > EPS) & (p < 1 - EPS))
        if last:  # a few documents of all lengths wait for the landing
            moving = np.setdiff1d(moving, moving[np.linspace(0, len(moving) - 1, min(HELD, len(moving))).astype(int)])
        p[moving] = flight(sizes[moving], p[moving], name)
        return group.assign(p=land(sizes, p) if last else p)[["row", "source", "spread", "size", "p", "block"]]

    return open_.select("row", "source", "spread", "size", "p", "block").groupBy("source", "block").applyInPandas(
        run, "row bigint, source string, spread bigint, size bigint, p double, block bigint")
