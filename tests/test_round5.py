"""Forests on labels that are not whole numbers, cuts of drawn features, and boosting in one task or in few."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablescope.functions import histograms
from tablescope.functions.histograms import tallied as histograms_tallied
from tablescope.operators import boosting, kernels, models, trees
from tablescope.sources import store


def frame(spark, x, y):
    return spark.createDataFrame([(Vectors.dense(row.tolist()), float(v)) for row, v in zip(x, y)], ["features", "label"])


def prices(seed, n):
    rng = np.random.default_rng(seed)
    return np.stack([rng.integers(0, 4, n), rng.integers(0, 3, n)], 1).astype(float), rng.integers(90_000, 10_500_000, n) / 100


def test_two_parts_of_prices_add_up_exactly():
    x, y = prices(1, 5000)
    parts = trees.grains(np.abs(y).sum(), len(y))
    batch = lambda rows: pa.RecordBatch.from_arrays(
        [pa.array(rows), pa.array(x[rows].tolist()), pa.array(y[rows])], ["row", "x", "label"])
    sums = []
    for order in (np.arange(5000), np.arange(5000)[::-1]):
        held = trees.Totals(3, True, 42)
        for part in np.split(order, [100, 3000]):
            held.add(trees.Merged(batch(part), 2, 0, True, parts))
        found = {tuple(v): (s, r, a, b) for v, s, r, a, b in zip(*(list(held.seen())[1][1].joined().__dict__[k] for k in ("x", "sums", "row", "low", "high")))}
        sums.append({k: tuple(map(tuple, [s, [r, a, b]])) for k, (s, r, a, b) in found.items()})
    assert sums[0] == sums[1] and len(sums[0]) == 12
    w = trees.copies(np.arange(5000), 1, 42)
    for v, ((n, coarse, fine), (_, low, high)) in sums[0].items():
        own = (x == v).all(1) & (w > 0)
        assert n == w[own].sum() and (low, high) == (y[own].min(), y[own].max())
        assert coarse + fine == pytest.approx(math.fsum(w[own] * y[own]), rel=1e-15)


def test_vectors_with_prices_travel_once_and_not_row_by_row(spark, monkeypatch):
    """Before, every row went to every tree where labels were not whole."""
    monkeypatch.setattr(trees, "LOCAL", 500)
    x, y = prices(2, 3000)
    sent, gathered = [], trees.gathered

    def seen(*args):
        made = gathered(*args)
        sent.append(made.agg(F.sum(F.length("row") / 8)).first()[0])
        return made

    monkeypatch.setattr(trees, "gathered", seen)
    said = []
    for tasks in (1, 5):
        data = frame(spark, x, y).repartition(tasks)
        forest = trees.fit_forest(data, trees.REGRESSION, trees=4, bootstrap=False, tries="all")
        assert sent.pop() <= 4 * 12 * tasks and all(len(t.feature) == 1 for t in forest.tops)
        said.append({tuple(r.features): r.prediction for r in trees.scored(data, forest).select("features", "prediction").collect()})
    assert said[0] == said[1] and len(said[0]) == 12  # however the rows are laid out
    for v, p in said[0].items():
        assert p == pytest.approx(y[(x == v).all(1)].mean(), rel=1e-12)


@pytest.mark.parametrize("task, classes", [(boosting.CLASSIFICATION, 3), (boosting.REGRESSION, 0)])
def test_boosting_in_one_task_equals_boosting_in_many(spark, monkeypatch, task, classes):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (700, 3)).astype(float)
    y = (x[:, 0] + x[:, 1] * rng.random(700) > 6).astype(float) + (x[:, 2] > 6)
    data, jobs, found = frame(spark, x, y), [], []
    for rows in (0, 200_000):
        monkeypatch.setattr(histograms, "HERE_ROWS", rows)
        jobs.append([])
        monkeypatch.setattr(histograms, "tallied", lambda *a, real=histograms_tallied, made=jobs[-1], **k: made.append(1) or real(*a, **k))
        made = boosting.fit_boosted(data, task, classes, rounds=4)
        ada = boosting.fit_adaboost(data, task, rounds=4)
        found.append((made.raw(x), made.importance, ada.outputs(x), [s.alpha for s in ada.stages]))
    assert jobs[0] and not jobs[1]
    assert all(np.allclose(a, b, rtol=1e-9) for a, b in zip(*found))


def test_a_large_table_is_cut_into_few_tasks(spark, monkeypatch):
    """Before, a task per 8192 rows: 300 of them for every pass over 2.4 million."""
    monkeypatch.setattr(histograms, "TASK_ROWS", 10)
    table = histograms.Binned(spark.range(1000).select(F.col("id").cast("double").alias("label")))
    assert table.tasks == max(histograms.FEW_TASKS, spark.sparkContext.defaultParallelism)
    table.drop()


def test_kernel_squares_of_equal_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 5, (600, 2)).astype(float)
    data, mapped = frame(spark, x, np.sin(x[:, 0]) * 9 + x[:, 1] + rng.random(600)), []
    said = []
    real = kernels.KernelMapModel._transform
    monkeypatch.setattr(kernels.KernelMapModel, "_transform", lambda self, d: mapped.append(d.count()) or real(self, d))
    for many in (10_000, 100):
        monkeypatch.setattr(kernels, "MANY_ROWS", many)
        fit = models.estimator("svr", models.REGRESSION, rows=600, label_std=2.0).fit(data)
        assert mapped.pop(0) == (600 if many > 600 else 25)
        said.append(np.array(sorted(r.prediction for r in fit.transform(data).select("prediction").collect())))
        mapped.clear()
        path = store.scratch_dir(spark)
        models.save_model(Pipeline(stages=[models.estimator("svr", models.REGRESSION, rows=600, label_std=2.0)]).fit(data), path)
        again = sorted(r.prediction for r in models.load_model(path).transform(data).select("prediction").collect())
        assert np.allclose(again, said[-1], rtol=1e-9)
        mapped.clear()
    assert np.allclose(said[0], said[1], rtol=1e-6)


def test_only_drawn_features_are_looked_at(monkeypatch):
    """Before, all six were, and two of them drawn afterwards; features that can't be cut are passed over all the same."""
    rng = np.random.default_rng(5)
    x, y = rng.random((300, 6)), rng.integers(0, 2, 300).astype(float)
    x[:, np.random.default_rng(0).random((1, 6)).argsort(1)[0, 0]] = 1.0   # the first one drawn
    drawn = np.random.default_rng(0).random((1, 6)).argsort(1)[0, 1:3]
    looked, real = [], trees.exact_cuts
    monkeypatch.setattr(trees, "exact_cuts", lambda xs, *a: looked.append(len(xs)) or real(xs, *a))
    nodes, _ = trees.grow(x, y, np.ones(300), 2, 2, False, 1, np.random.default_rng(0))
    assert looked == [300, 300, 300]

    def best(f):
        gains = []
        for c in np.sort(x[:, f])[:-1]:
            sums = [np.bincount(y[m].astype(int), minlength=2) for m in (x[:, f] <= c, x[:, f] > c)]
            gains.append(sum((s ** 2).sum() / s.sum() for s in sums))
        return max(gains)

    assert nodes.feature[0] == max(drawn, key=best)


def test_bins_lead_down_a_top_as_values_do(spark):
    rng = np.random.default_rng(6)
    x = rng.random((200, 2)).round(2)
    x[:5, 1] = np.nan
    cuts, top = [np.arange(0, 1, 0.1), np.array([0.25, 0.5])], trees.Top()
    below = top.split(0, 0, float(cuts[0][4]))
    top.split(below, 1, 0.25)
    rows = spark.createDataFrame([(i, v.tolist(), 0.0) for i, v in enumerate(x)], "row long, x array<double>, label double")
    found = trees.binned_rows(rows, cuts).orderBy("row").toArrow().column("x").combine_chunks()
    shape = top.nodes()
    by_value = shape.leaves(x)
    shape.cut = np.array([np.searchsorted(cuts[f], c) if f >= 0 else 0 for f, c in zip(shape.feature.tolist(), shape.cut.tolist())])
    assert np.array_equal(shape.leaves(histograms.bin_matrix(found, 2)), by_value) and len(set(by_value)) == 3
