"""Pairwise sums of many numeric columns in one pass.

Every task multiplies its Arrow batches into k x k partial sums; only those small matrices are
shuffled and added up. The number of columns, not of rows, sets the size of what moves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.columns import as_double, scalar_stats

# below this share of its raw square sum a variance is rounding noise
NOISE = 1e-12


def _partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for batch in batches:
        x = batch.to_numpy(dtype=float)
        present = ~np.isnan(x)
        x, p = np.where(present, x, 0.0), present.astype(float)
        sums = np.stack([p.T @ p, x.T @ p, (x * x).T @ p, x.T @ x])
        total = sums if total is None else total + sums
    if total is not None:
        i, j = np.indices(total.shape[1:])
        n, s, ss, xy = total
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "n": n.ravel(), "sx": s.ravel(), "sy": s.T.ravel(),
                            "sxx": ss.ravel(), "syy": ss.T.ravel(), "sxy": xy.ravel()})


def pair_sums(df: DataFrame, cols: Sequence[str], centred: bool = True) -> DataFrame:
    """``(i, j, n, sx, sy, sxx, syy, sxy)`` over the rows where columns ``i`` and ``j`` are both present.

    Centred sums subtract the column mean first, which
    keeps variances exact; a constant column becomes exactly zero.
    """
    data = df
    made = [as_double(c).alias(f"c{k}") for k, c in enumerate(cols)]
    if centred:
        data = df.withColumn("_s", scalar_stats(df, **{
            f"{m}{k}": f(as_double(c)) for k, c in enumerate(cols)
            for m, f in (("mean", F.avg), ("lo", F.min), ("hi", F.max))}))
        made = [F.when(as_double(c).isNotNull(),
                       F.when(F.col(f"_s.lo{k}") < F.col(f"_s.hi{k}"), as_double(c) - F.col(f"_s.mean{k}"))
                       .otherwise(0.0)).alias(f"c{k}") for k, c in enumerate(cols)]
    sums = ("n", "sx", "sy", "sxx", "syy", "sxy")
    parts = data.select(*made).mapInPandas(_partial_sums, "i int, j int, " + ", ".join(f"{c} double" for c in sums))
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in sums])


def pair_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(i, j, n, corr)`` for all ordered pairs; NULL where a side does not vary."""
    sums = pair_sums(df, cols)
    n = F.col("n")
    vx, vy = (F.col(f"s{v}{v}") - F.try_divide(F.col(f"s{v}") * F.col(f"s{v}"), n) for v in "xy")
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    varies = (vx > F.col("sxx") * NOISE) & (vy > F.col("syy") * NOISE)
    r = F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
    return sums.select("i", "j", n.cast("bigint").alias("n"), F.when(varies, bounded).alias("corr"))
