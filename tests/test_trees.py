"""Boosting against plain NumPy, fully grown trees, random cuts, kernel features."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablescope.functions.histograms import bin_numbers, feature_cuts
from tablescope.operators import boosting, models, trees
from tablescope.sources import store


def frame(spark, x, y):
    return spark.createDataFrame([(Vectors.dense(row.tolist()), float(v)) for row, v in zip(x, y)], ["features", "label"])


def grid(seed, n, classes=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, 3)).astype(float)
    y = ((x[:, 0] > 5).astype(int) + (x[:, 1] > 7) + (rng.random(n) < 0.1)) % classes
    return x, y.astype(float)


def plain_samme(x, y, classes, rounds):
    w, stages = np.ones(len(y)), []
    for _ in range(rounds):
        best = None
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                sides = [np.bincount(y[m].astype(int), w[m], classes) for m in (x[:, f] <= cut, x[:, f] > cut)]
                gain = sum((s ** 2).sum() / s.sum() for s in sides)
                if best is None or gain > best[0] * (1 + 1e-9):
                    best = (gain, f, cut, [s.argmax() for s in sides])
        _, f, cut, says = best
        said = np.where(x[:, f] <= cut, *says)
        miss = said != y
        error = (w * miss).sum() / w.sum()
        alpha = math.log((1 - error) / error) + math.log(classes - 1)
        stages.append((alpha, f, cut, says))
        w = w * np.exp(alpha * miss)
        w /= w.mean()
    votes = np.zeros((len(y), classes))
    for alpha, f, cut, says in stages:
        votes[np.arange(len(y)), np.where(x[:, f] <= cut, *says)] += alpha
    return [s[0] for s in stages], votes / votes.sum(1, keepdims=True)


def test_samme_equals_plain_numpy(spark, monkeypatch):
    monkeypatch.setattr(boosting, "WRITES", 3)
    x, y = grid(1, 500)
    model = boosting.fit_adaboost(frame(spark, x, y), rounds=8)
    alphas, votes = plain_samme(x, y, 3, 8)
    assert [s.alpha for s in model.stages] == pytest.approx(alphas, rel=1e-9)
    assert np.allclose(model.outputs(x), votes)


def plain_tree(x, r, w, depth):
    """Leaf number of every row after the best squared-error cuts."""
    groups = [np.arange(len(r))]
    for _ in range(depth):
        after = []
        for g in groups:
            best = (1e-12, None)
            for f in range(x.shape[1]):
                for cut in np.unique(x[g, f])[:-1]:
                    left = x[g, f] <= cut
                    a, b = w[g][left].sum(), w[g][~left].sum()
                    gap = np.average(r[g][left], weights=w[g][left]) - np.average(r[g][~left], weights=w[g][~left])
                    gain = a * b / (a + b) * gap ** 2
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, left)
            after += [g] if best[1] is None else [g[best[1]], g[~best[1]]]
        groups = after
    return groups


def test_r2_equals_plain_numpy(spark):
    x, y = grid(2, 300)
    y = y * 7 + x[:, 2]
    model = boosting.fit_adaboost(frame(spark, x, y), boosting.REGRESSION, rounds=4)
    w, alphas, said = np.ones(len(y)), [], []
    for _ in range(4):
        p = np.zeros(len(y))
        for g in plain_tree(x, y, w, 3):
            p[g] = np.average(y[g], weights=w[g])
        miss = np.abs(p - y)
        miss /= miss.max()
        error = (w * miss).sum() / w.sum()
        beta = error / (1 - error)
        alphas.append(math.log(1 / beta))
        said.append(p)
        w = w * beta ** (1 - miss)
        w /= w.sum()
    assert [s.alpha for s in model.stages] == pytest.approx(alphas, rel=1e-9)
    order = np.argsort(np.array(said).T, 1, kind="stable")
    seen = np.cumsum(np.array(alphas)[order], 1)
    at = (seen >= 0.5 * sum(alphas) - 1e-12).argmax(1)
    want = np.take_along_axis(np.array(said).T, np.take_along_axis(order, at[:, None], 1), 1)
    assert np.allclose(model.outputs(x), want)


@pytest.mark.parametrize("classes", [2, 3])
def test_softmax_boosting_equals_plain_numpy(spark, monkeypatch, classes):
    monkeypatch.setattr(boosting, "WRITES", 2)
    x, y = grid(3, 300, classes)
    model = boosting.fit_boosted(frame(spark, x, y), boosting.CLASSIFICATION, classes, rounds=3)
    prior = np.bincount(y.astype(int), minlength=classes) / len(y)
    raw = np.tile(np.log(prior) if classes > 2 else [math.log(prior[1] / prior[0])], (len(y), 1))
    for _ in range(3):
        p = np.exp(raw) / np.exp(raw).sum(1, keepdims=True) if classes > 2 else 1 / (1 + np.exp(-raw))
        for k in range(raw.shape[1]):
            r = (y == (k if classes > 2 else 1)) - p[:, k]
            for g in plain_tree(x, r, np.ones(len(y)), 3):
                scale = (classes - 1) / classes if classes > 2 else 1
                raw[g, k] += 0.1 * scale * r[g].sum() / (np.abs(r[g]) * (1 - np.abs(r[g]))).sum()
    assert np.allclose(model.raw(x), raw)


def test_bins_keep_the_order_of_values(spark):
    rng = np.random.default_rng(4)
    x = np.stack([rng.normal(size=2000), (rng.random(2000) < 0.001).astype(float)], 1)
    cuts = feature_cuts(frame(spark, x, x[:, 0]))
    bins = bin_numbers(x, cuts)
    assert all(len(c) < 256 for c in cuts) and len(np.unique(bins[:, 0])) > 200
    order = np.argsort(x[:, 0])
    assert (np.diff(bins[order, 0].astype(int)) >= 0).all() and set(bins[x[:, 1] > 0, 1]).isdisjoint(bins[x[:, 1] == 0, 1])


@pytest.mark.parametrize("local", [200_000, 150])
def test_trees_are_grown_until_pure(spark, monkeypatch, local):
    """A chequered board needs depth; noise labels need a leaf per row. Both also when histograms grow the top."""
    monkeypatch.setattr(trees, "LOCAL", local)
    rng = np.random.default_rng(5)
    x = rng.random((800, 3))
    y = (np.floor(x[:, 0] * 8) + np.floor(x[:, 1] * 8)) % 2
    y[:40] = rng.integers(0, 2, 40)
    data = frame(spark, x, y)
    for options in ({"bootstrap": False, "trees": 1, "tries": "all"}, {"bootstrap": False, "trees": 2, "at_random": True}):
        forest = trees.fit_forest(data, trees.CLASSIFICATION, 2, **options)
        assert trees.scored(data, forest).where("prediction = label").count() == 800
        assert forest.importance.sum() == pytest.approx(1) and (len(forest.tops[0].feature) > 1) == (local == 150)
    number = frame(spark, x, x[:, 0] * 3 + x[:, 2])
    exact = trees.scored(number, trees.fit_forest(number, trees.REGRESSION, trees=1, bootstrap=False, tries="all"))
    assert exact.where("abs(prediction - label) > 1e-9").count() == 0
    assert trees.fit_forest(data, trees.CLASSIFICATION, 2, trees=1, bootstrap=False, depth=2).subtrees.count() <= 4


def test_forest_draws_and_repeats(spark):
    """Poisson weights of mean and variance one; the same forest however the table is laid out."""
    w = trees.copies(np.arange(100_000), 3, 42)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    assert abs(np.corrcoef(w, trees.copies(np.arange(100_000), 4, 42))[0, 1]) < 0.02
    x, y = grid(6, 400)
    data = frame(spark, x, y).coalesce(1)
    a, b = (trees.scored(data, trees.fit_forest(data, trees.CLASSIFICATION, 3, trees=5)).select("probability").collect() for _ in range(2))
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_random_cuts_differ_from_the_best():
    rng = np.random.default_rng(7)
    x, y = rng.random((400, 2)), (rng.random(400) < 0.5).astype(float)
    drawn = [trees.grow(x, y, np.ones(400), 2, 2, True, 1, np.random.default_rng(s))[0].cut[0] for s in range(30)]
    best = [trees.grow(x, y, np.ones(400), 2, 2, False, 1, np.random.default_rng(s))[0].cut[0] for s in range(3)]
    assert len(set(drawn)) > 20 and len(set(best)) == 1 and all(0 < c < 1 for c in drawn)
    same, _ = trees.grow(np.ones((5, 2)), np.array([0.0, 1, 0, 1, 1]), np.ones(5), 2, 2, False, 9, rng)
    assert same.feature.tolist() == [-1] and same.value[0].tolist() == [0.4, 0.6]


def test_kernel_machine_separates_rings(spark):
    rng = np.random.default_rng(8)
    angle, ring = rng.uniform(0, 2 * np.pi, 600), rng.integers(0, 2, 600)
    radius = 1 + 2 * ring + rng.normal(0, 0.2, 600)
    x = np.stack([radius * np.cos(angle), radius * np.sin(angle)], 1)
    data = frame(spark, x, ring)
    hit = lambda m: m.transform(data).where("prediction = label").count() / 600
    assert hit(models.estimator("svm", models.CLASSIFICATION, rows=600).fit(data)) > 0.95
    assert hit(models.estimator("logistic", models.CLASSIFICATION, rows=600).fit(data)) < 0.75
    height = frame(spark, x, radius)
    missed = {}
    for name in ("svr", "linear"):
        fit = models.estimator(name, models.REGRESSION, rows=600, label_std=1.0).fit(height)
        missed[name] = fit.transform(height).select(F.avg(F.pow(F.col("prediction") - F.col("label"), 2))).first()[0]
    assert missed["svr"] < 0.1 * radius.var() and missed["linear"] > 0.9 * radius.var()


@pytest.mark.parametrize("name", ["gbt", "extra_trees", "svm"])
def test_saved_models_predict_the_same(spark, name):
    x, y = grid(9, 200, 2)
    data = frame(spark, x, y)
    model = Pipeline(stages=[models.estimator(name, models.CLASSIFICATION, 2, trees=3, rows=200)]).fit(data)
    path = store.scratch_dir(spark)
    models.save_model(model, path)
    again = models.load_model(path)
    pick = lambda m: sorted(str(r) for r in m.transform(data).select("features", "prediction").collect())
    assert pick(model) == pick(again)


def test_classes_are_counted_where_the_caller_does_not(spark):
    x, y = grid(10, 200)
    data = frame(spark, x, y)
    for name in ("decision_tree", "gbt"):
        fit = models.estimator(name, models.CLASSIFICATION, trees=3).fit(data)
        assert len(fit.transform(data).first()["probability"]) == 3


def test_equal_vectors_travel_and_are_scored_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.stack([rng.integers(0, 4, 3000), rng.integers(0, 3, 3000)], 1).astype(float)
    y = x[:, 0] * 10 + rng.integers(0, 5, 3000)
    rows = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))], "row long, x array<double>, label double")
    whole = trees.gathered(rows.coalesce(1), [trees.Top()] * 2, True, 42, 2, 0).where("tree = 1").toArrow()
    merged, w = trees.received(whole, 2, 2), trees.copies(np.arange(3000), 1, 42)
    assert len(np.frombuffer(whole.column("row")[0].as_py(), np.int64)) == len(merged.x) == 12
    for v, sums, low, high in zip(merged.x, merged.sums, merged.low, merged.high):
        own = (x == v).all(1) & (w > 0)
        assert (sums.tolist(), low, high) == ([w[own].sum(), (w * y)[own].sum()], y[own].min(), y[own].max())
    apart = trees.received(trees.gathered(rows, [trees.Top()], True, 42, 2, 0, False).toArrow(), 2, 2, False)
    seen = np.flatnonzero(trees.copies(np.arange(3000), 0, 42))
    assert np.array_equal(apart.row, seen) and np.array_equal(apart.x, x[seen]) and np.array_equal(apart.low, y[seen])
    args = (0, 2, False, 99, np.random.default_rng(0))
    a, b = trees.grow_vectors(merged, *args)[0], trees.grow(x[w > 0], y[w > 0], w[w > 0], *args)[0]
    assert all(np.array_equal(p, q) for p, q in zip(vars(a).values(), vars(b).values()))
    for classes, label in ((0, y), (4, x[:, 0])):
        data, asked, routed = frame(spark, x, label), [], trees.routed
        monkeypatch.setattr(trees, "routed", lambda rows, *a: asked.append(rows.count()) or routed(rows, *a))  # noqa: B023
        forest = trees.fit_forest(data, trees.CLASSIFICATION if classes else trees.REGRESSION, 2, trees=3)
        said = trees.scored(data, forest)
        assert asked == [12] and said.count() == 3000 and said.where("prediction is null").count() == 0
        monkeypatch.undo()
    assert said.where("prediction <> label").count() == 0
