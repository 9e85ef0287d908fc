"""Short passes over binned tables, and neighbours among a moderate number of donors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.functions import histograms
from tablescope.operators import neighbours


@pytest.mark.parametrize("held, few", [(1 << 22, 8), (1 << 22, 0), (0, 8)])
def test_passes_over_a_binned_table_agree_however_it_is_kept(spark, monkeypatch, held, few):
    monkeypatch.setattr(histograms, "HELD_ROWS", held)
    monkeypatch.setattr(histograms, "FEW_TASKS", few)
    monkeypatch.setattr(histograms, "TASK_ROWS", 300)
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    table = histograms.Binned(spark.range(1000).select((F.col("id") % 7).cast("double").alias("label")))
    assert table.tasks == 4 and table.held == (held > 0)
    if held:
        assert table.rows.rdd.getNumPartitions() == 4

    def tally(b):
        label = b.column("label").to_numpy().astype(int)
        yield 0, np.bincount(label, minlength=7).astype(float)
        yield -1, np.array([float(label.max())])

    found = table.tallied(tally)
    assert found[0].tolist() == np.bincount(np.arange(1000) % 7).tolist() and found[-1].tolist() == [6.0]
    after = table.replaced(table.rows.withColumn("label", F.col("label") + 1))
    assert after.tallied(lambda b: [(0, np.array([float(b.num_rows)]))])[0].tolist() == [1000.0]
    after.drop()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


@pytest.mark.parametrize("gaps", [False, True])
def test_moderate_donors_are_compared_directly_and_exactly(spark, monkeypatch, gaps):
    monkeypatch.setattr(neighbours, "BROADCAST_DONORS", 10)
    monkeypatch.setattr(neighbours, "_boxed", lambda *a: pytest.fail("boxes cost more than the pairs"))
    rng = np.random.default_rng(3)
    x, y = rng.random((40, 3)).round(3), rng.random((300, 3)).round(3)
    if gaps:
        y[::4, 1] = np.nan
    values = lambda a, n: spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in a], n)
    asks = values(x, "x0 double, x1 double, x2 double").withColumn("_j", F.lit(-1))
    donors = values(y, "y0 double, y1 double, y2 double").withColumns({"_payload": F.col("y0"), "_n": F.lit(1).cast("bigint")})
    found = neighbours._search(asks, donors, 3, 5).groupBy("x0", "x1", "x2").agg(F.sort_array(F.collect_list("_d2")).alias("d")).collect()
    assert len(found) == 40
    d2 = np.nansum((x[:, None] - y) ** 2, 2) * 3 / (~np.isnan(y)).sum(1)
    brute = {tuple(r): sorted(d)[:5] for r, d in zip(x, d2)}
    assert all(np.allclose(brute[(r.x0, r.x1, r.x2)], r.d) for r in found)


def test_many_pairs_go_down_the_boxes(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BROADCAST_DONORS", 10)
    monkeypatch.setattr(neighbours, "MOST_PAIRS", 100)
    points = spark.range(60).select(F.col("id").cast("double").alias("a"), F.col("id").cast("double").alias("_payload"))
    found = neighbours.nearest(points, points, ["a"], 1, sample=8).collect()
    assert {(r["a"], r["_payload"]) for r in found} == {(float(i), float(i)) for i in range(60)}
