"""Shard records evenly by bytes: sampled splitters and range partitioning.

Records are ordered by (hash of the text, id), so copies of a text lie side by side. A sample drawn with
probability proportional to size gives quantile boundaries of many fine ranges; the bytes of each range are
then counted exactly, and ranges that came out overfull are cut again by a denser sample of their own. Equal texts stay in
one range unless they alone exceed several ranges; such a group is cut by id. Shards are runs of ranges, numbered so that
their bytes are near equal, and slots count on from range to range.

Defined results: a null text has 0 bytes (size 8) and CRC 0; null ids sort first; repeated rows get slots of
their own; an empty table gives an empty result. Extra columns are ignored unless ``carry`` keeps them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.common import column, fresh, numbered, shared_folder, write

PER_SHARD = 64          # fine ranges in a shard
DRAWS = 16              # sampled records in a range
RANGE_BYTES = 256 << 20
MOST_RANGES = 65_536    # bounds what the driver holds
GROUP_RANGES = 4        # copies of one text are cut only beyond so many ranges
HOT = 4096              # a group of equal rows is hot beyond one row in HOT
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def cut_points(sample: pd.DataFrame, width: float) -> list[tuple[int, int]]:
    """Upper bounds (h, id) of ranges of about ``width`` bytes, from size-weighted draws."""
    cuts: list[tuple[int, int]] = []
    held = 0.0
    for h, group in sample.sort_values(["h", "id"]).groupby("h", sort=True):
        weight = float(group["w"].sum())
        if weight > GROUP_RANGES * width and len(group) > 1:  # a hot group of equal texts
            inside = 0.0
            for i, w in zip(group["id"].tolist(), group["w"].tolist()):
                inside += w
                if inside >= width:
                    cuts.append((h, i))
                    inside = 0.0
            if not cuts or cuts[-1] != (h, HIGHEST):
                cuts.append((h, HIGHEST))
            held = 0.0
            continue
        held += weight
        if held >= width:
            cuts.append((h, HIGHEST))
            held = 0.0
    return sorted(set(cuts))


def range_of(cuts: list[tuple[int, int]]):
    """A column function: how many of ``cuts`` lie below (h, id)."""
    hs = np.array([c[0] for c in cuts], dtype=np.int64)
    ids = np.array([c[1] for c in cuts], dtype=np.int64)

    @F.pandas_udf(T.LongType())
    def place(h: pd.Series, i: pd.Series) -> pd.Series:
        hv, iv = h.to_numpy(), i.to_numpy()
        low, high = np.searchsorted(hs, hv, "left"), np.searchsorted(hs, hv, "right")
        for j in np.unique(low[(high - low) > 1]):  # texts with cuts inside
            rows = np.flatnonzero((low == j) & (high > low))
            low[rows] = j + np.searchsorted(ids[j:high[rows[0]]], iv[rows], "left")
        one = np.flatnonzero((high - low) == 1)
        one = one[hs[low[one]] == hv[one]]
        low[one] += ids[low[one]] < iv[one]
        return pd.Series(low)

    return place


def draw(rows: DataFrame, rate: Column, salt: int) -> pd.DataFrame:
    """Records kept with probability size * rate; ``w`` is the bytes each stands for."""
    u = (F.xxhash64("h", "id", F.lit(salt)).cast("double") / float(1 << 64)) + 0.5
    return (rows.where(u < F.col("size") * rate)
            .select("h", "id", F.greatest(F.col("size").cast("double"), 1.0 / rate).alias("w")).toPandas())


def splitters(rows: DataFrame, shards: int, rounds: int = 6) -> tuple[list[tuple[int, int]], DataFrame]:
    """Cuts such that no range is overfull unless one record is, and the exact bytes and rows of each range."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = int(min(MOST_RANGES, max(shards * PER_SHARD, total // RANGE_BYTES)))
    width = max(1.0, total / ranges)
    cuts = cut_points(draw(rows, F.lit(DRAWS / width), 0), width) if total else []
    for salt in range(1, rounds + 1):
        placed = rows.withColumn("r", range_of(cuts)("h", "id"))
        full = (placed.groupBy("r").agg(F.sum("size").alias("bytes"), F.max("size").alias("largest"),
                                        F.min("h").alias("h0"), F.max("h").alias("h1"))
                .where((F.col("bytes") > 2 * width) & (F.col("largest") < 0.5 * F.col("bytes"))
                       & ((F.col("h0") < F.col("h1")) | (F.col("bytes") > GROUP_RANGES * width))))
        heavy = [r[0] for r in full.select("r").collect()]
        if not heavy:
            break
        inside = F.broadcast(rows.sparkSession.createDataFrame([(r,) for r in heavy], "r bigint"))
        more = cut_points(draw(placed.join(inside, "r", "left_semi"), F.lit(4 * DRAWS / width), salt), width)
        if set(more) <= set(cuts):
            break
        cuts = sorted(set(cuts) | set(more))
    per = (rows.withColumn("r", range_of(cuts)("h", "id")).groupBy("r")
           .agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    return cuts, per


def layout(per: DataFrame, shards: int) -> DataFrame:
    """Shard of each range and the slot its first record gets; ``per`` has at most a bounded number of ranges."""
    order = Window.orderBy("r")
    before = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    total = F.sum("bytes").over(Window.partitionBy())
    shard = F.least(F.lit(shards - 1), F.floor((before + F.col("bytes") / 2) * shards / total)).cast("int")
    first = F.sum("n").over(Window.partitionBy("shard").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return per.select("r", "n", shard.alias("shard")).select("r", "shard", first.alias("first"))


def told_apart(rows: DataFrame, rest: DataFrame, h: str, id_: str, row: str) -> DataFrame:
    """``rest`` with new ids for rows that share text and id with more than one row in HOT of all, so that they can be drawn and cut
    like others. There are fewer than HOT such groups, so they are broadcast."""
    total = rows.count()
    hot = rows.groupBy("h", "id").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") * HOT > total))
    marks = F.broadcast(hot.select(F.col("h").alias("_hot_h"), F.col("id").alias("_hot_id")))
    joined = rest.join(marks, (F.col(h) == F.col("_hot_h")) & (F.col(id_) == F.col("_hot_id")), "left")
    return joined.withColumn(id_, F.when(F.col("_hot_h").isNotNull(), F.xxhash64(F.col(id_), F.col(row))).otherwise(F.col(id_))
                             ).drop("_hot_h", "_hot_id")


def shard_records(docs: DataFrame, shards: int = 24, *, key: str = "doc_id", text: str = "text",
                  carry: bool = False, row: str | None = None) -> DataFrame:
    """Key, size, text_crc32, law, shard, slot, grown_shard; with ``carry`` all columns of ``docs`` (but ``row``) and shard, slot.

    ``row`` names a column that tells the rows of ``docs`` apart and stays the same however often they are read.
    """
    spark = docs.sparkSession
    body = F.coalesce(column(text), F.lit(""))
    kept = [c for c in docs.columns if c != row]
    if carry and row is None:
        docs, row = numbered(docs)
    number = column(row) if row else F.monotonically_increasing_id()
    whole = docs.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    derived = {"h": F.xxhash64(body), "id": F.coalesce(column(key).cast("long") if whole else F.xxhash64(column(key)), F.lit(LOWEST)),
               "size": F.octet_length(body).cast("long") + 8, "crc": F.crc32(body.cast("binary"))}
    root = shared_folder(spark, "shards")
    first_rows = write(docs.select(column(key).alias("doc"), *[v.alias(k) for k, v in derived.items()], number.alias("row")), f"{root}/rows")
    rows = told_apart(first_rows, first_rows, "h", "id", "row")
    cuts, per = splitters(rows, shards)
    plan = write(layout(per, shards).coalesce(1), f"{root}/layout")
    if carry:
        names = {k: fresh(docs.columns, f"_{k}") for k in ("h", "id", "r")}
        placed = told_apart(first_rows, docs.withColumn(names["h"], derived["h"]).withColumn(names["id"], derived["id"]),
                            names["h"], names["id"], row)
        placed = placed.withColumn(names["r"], range_of(cuts)(names["h"], names["id"]))
    else:
        names = {k: k for k in ("h", "id", "r")}
        placed = rows.withColumn("r", range_of(cuts)("h", "id"))
    turn = F.row_number().over(Window.partitionBy(names["r"]).orderBy(names["h"], names["id"])) - 1
    shard, slot, first = (fresh(placed.columns if not carry else [*kept, *names.values()], c) for c in ("shard", "slot", "first"))
    placed = placed.withColumn(slot, turn).join(
        plan.select(F.col("r").alias(names["r"]), F.col("shard").alias(shard), F.col("first").alias(first)), names["r"])
    out_slot = (F.col(first) + F.col(slot)).cast("long")
    if carry:
        return placed.select(*[column(c) for c in kept], F.col(shard), out_slot.alias(slot))
    return placed.select(F.col("doc").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                         F.col(shard).alias("shard"), out_slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
