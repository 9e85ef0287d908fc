"""Near-equal labels of text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.columns import require_columns, text_columns, to_long

# Fixed value: similarity from which two labels count as near duplicates.
THRESHOLD = 0.92


def fuzzy_duplicates(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of different labels with ``1 - edit distance / longer length >= threshold``, at any length.

    If ``d`` edits turn the shorter text into the longer one and the shorter is cut into ``d + 1`` pieces, one piece stays
    whole and moves by at most ``d`` places. So for every pair of lengths that can meet, the shorter text is listed under
    its pieces and the longer one under its substrings around those places; equal texts meet in an
    equi-join, and only such pairs are compared. No pair is missed.
    """
    cols = list(cols) if cols is not None else text_columns(df)
    require_columns(df, cols)
    labels = to_long(df, cols, "string").where("value is not null").distinct().withColumn("n", F.length("value"))
    edits = f"CAST(floor(long * {1 - threshold!r} + 1e-9) AS int)"
    start = "CAST(floor(i * short / (d + 1)) AS int)"
    size = "CAST(floor((i + 1) * short / (d + 1)) AS int) - at"
    base = ["column", "value", "short", "long", "d", "i"]
    pieces = (labels.select("column", "value", F.col("n").alias("short"), F.explode(F.expr(
        f"sequence(n, CAST(floor(n / {threshold!r} + 1e-9) AS int))")).alias("long"))
        .withColumn("d", F.expr(edits)).where("d > 0 AND long - short <= d")
        .withColumn("i", F.explode(F.expr("sequence(0, d)"))).withColumn("at", F.expr(start)).withColumn("size", F.expr(size))
        .select(*base, F.expr("substring(value, at + 1, size)").alias("piece")))
    around = (labels.select("column", "value", F.col("n").alias("long")).withColumn("d", F.expr(edits)).where("d > 0")
              .withColumn("short", F.explode(F.expr("sequence(greatest(long - d, 1), long)")))
              .withColumn("i", F.explode(F.expr("sequence(0, d)"))).withColumn("at", F.expr(start)).withColumn("size", F.expr(size))
              .withColumn("p", F.explode(F.expr("sequence(greatest(0, at - d), greatest(0, least(long - size, at + d)))")))
              .select(*base, F.expr("substring(value, p + 1, size)").alias("piece")).distinct())
    keys = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("column", "short", "long", "i", "piece")]
    met = pieces.alias("a").join(around.alias("b"), [*keys, F.col("a.value") != F.col("b.value")]).select(
        F.col("a.column").alias("column"), F.least("a.value", "b.value").alias("a"), F.greatest("a.value", "b.value").alias("b")).distinct()
    longer = F.greatest(F.length("a"), F.length("b"), F.lit(1))
    return met.withColumn("similarity", 1 - F.levenshtein("a", "b") / longer).where(F.col("similarity") >= threshold)
