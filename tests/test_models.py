"""Training and prediction invariants."""

import random

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tablescope.operators import evaluate, models
from tablescope.sources import store

from .conftest import SF_DIR


@pytest.fixture(scope="module")
def easy(spark):
    rnd = random.Random(0)
    rows = []
    for i in range(400):
        x, y = rnd.uniform(-3, 3), rnd.uniform(-3, 3)
        label = "high" if x + y > 0.3 else "low" if x + y < -0.3 else None
        if label:
            rows.append((i, x, None if i % 17 == 0 else y, rnd.choice("ab") if i % 13 else None, label, 3 * x - 2 * y + 1))
    return spark.createDataFrame(rows, "id int, x double, y double, s string, label_text string, target double").cache()


@pytest.mark.parametrize("name", ["random_forest", "gbt", "decision_tree", "logistic", "svm", "naive_bayes"])
def test_separable_classes_are_learned(easy, name):
    data = easy.where("y is not null")
    _, preds, run = models.train_model(data, "label_text", name, ["x", "y"], key=["id"])
    metrics = run.first()["metrics"]
    assert metrics["accuracy"] > 0.88
    right = preds.where(F.col("predicted") == F.col("label_text")).count() / preds.count()
    assert right == pytest.approx(metrics["accuracy"])


@pytest.mark.parametrize("name", ["linear", "ridge", "svr", "gbt"])
def test_linear_target_is_learned(easy, name):
    data = easy.where("y is not null")
    _, _, run = models.train_model(data, "target", name, ["x", "y"], key=["id"], task="regression")
    assert run.first()["metrics"]["r2"] > 0.85


def test_adaboost(easy):
    data, _ = models.encode_target(easy.where("y is not null"), "label_text")
    ready = models.preprocess(data, "label_text", ["x", "y"]).fit(data).transform(data).select("features", "label")
    weak = models.train_adaboost(ready, rounds=1)
    strong = models.train_adaboost(ready, rounds=8)
    score = lambda s: evaluate.classification_metrics(models.predict_adaboost(s, ready)).where("metric = 'accuracy'").first()["value"]
    assert score(strong) > max(0.85, score(weak))
    numbers = ready.withColumn("label", F.col("label") * 10 + 1)
    stages = models.train_adaboost(numbers, models.REGRESSION, rounds=4)
    r2 = evaluate.regression_metrics(models.predict_adaboost(stages, numbers, models.REGRESSION)).where("metric = 'r2'").first()["value"]
    assert r2 > 0.6


def test_preprocessing_of_missing_and_unknown_labels(easy, spark):
    for encoding, size in (("onehot", 4), ("ordinal", 3)):
        pipe = models.preprocess(easy, "label_text", ["x", "y", "s"], encoding=encoding)
        model = pipe.fit(easy)
        new = spark.createDataFrame([(1.0, None, "unseen"), (1.0, 2.0, None)], "x double, y double, s string")
        vecs = [r["features"].toArray().tolist() for r in model.transform(new).collect()]
        assert {len(v) for v in vecs} == {size}
        assert vecs[0][2:] == ([0.0, 0.0] if encoding == "onehot" else [-1.0])
        assert all(v == v for vec in vecs for v in vec)


def test_interactions_leave_out_squares(spark):
    df = spark.createDataFrame([(2.0, 3.0, 5.0, 1), (7.0, 11.0, 13.0, 0)], "a double, b double, c double, t int")
    pipe = models.preprocess(df, "t", scaling="none", interactions=True)
    v = pipe.fit(df).transform(df).first()["features"].toArray().tolist()
    assert sorted(v) == sorted([2.0, 3.0, 5.0, 6.0, 10.0, 15.0])


def test_split_and_folds_keep_shares(easy):
    flagged = evaluate.split_flag(easy, "label_text", 0.2, ["id"])
    for r in flagged.groupBy("label_text").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect():
        assert abs(r["t"] - 0.2 * r["n"]) <= 1
    again = evaluate.split_flag(easy.repartition(7), "label_text", 0.2, ["id"])
    assert flagged.where("is_test").select("id").exceptAll(again.where("is_test").select("id")).count() == 0
    folds = evaluate.with_folds(easy, 5, ["id"], "label_text").groupBy("label_text", "fold").count().collect()
    sizes = {}
    for r in folds:
        sizes.setdefault(r["label_text"], []).append(r["count"])
    assert all(len(s) == 5 and max(s) - min(s) <= 2 for s in sizes.values())


def test_cross_validation_and_leaderboard(easy):
    data, _ = models.encode_target(easy, "label_text")
    prep = models.preprocess(easy, "label_text", ["x", "y"])
    pipe = Pipeline(stages=[*prep.getStages(), models.estimator("logistic", models.CLASSIFICATION)])
    scores = [r["score"] for r in models.cross_validate(data, pipe, models.CLASSIFICATION, 3, ["id"]).collect()]
    assert len(scores) == 3 and min(scores) > 0.8
    board = models.automl(easy, "target", ["x", "y"], ["linear", "decision_tree", "no_such_model"], 3, ["id"]).collect()
    assert [r["model"] for r in board] == ["linear", "decision_tree", "no_such_model"]
    assert board[2]["mean_score"] is None and "unknown" in board[2]["error"]


def test_saved_model_predicts_the_same(easy, spark):
    model, _, _ = models.train_model(easy, "label_text", "decision_tree", ["x", "y"], key=["id"])
    path = store.scratch_dir(spark)
    models.save_model(model, path)
    pick = lambda m: sorted((r["id"], r["prediction"]) for r in models.predict(m, easy).collect())
    assert pick(model) == pick(models.load_model(path))


def test_feature_importance(easy):
    model, _, _ = models.train_model(easy, "target", "random_forest", ["x", "y", "s"], key=["id"], task="regression")
    rows = models.feature_importance(model, easy).collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1) and rows[0]["importance"] >= rows[-1]["importance"]


def test_hashed_text_features(easy):
    """The encoding for columns with more labels than the driver should keep."""
    _, _, run = models.train_model(easy.where("y is not null"), "label_text", "logistic", ["x", "y", "s"], key=["id"], encoding="hash")
    assert run.first()["metrics"]["accuracy"] > 0.88


def test_unknown_model_name():
    with pytest.raises(ValueError, match="unknown"):
        models.estimator("magic", models.REGRESSION)


def test_kmeans_and_pca(easy):
    data = easy.dropna(subset=["x", "y"])
    rows, sizes = models.cluster_kmeans(easy, ["x", "y"], 3)
    assert sum(r["size"] for r in sizes.collect()) == data.count() == rows.count()
    _, ratios = models.pca(easy, ["x", "y", "target"], 3)
    got = [r["explained_variance_ratio"] for r in ratios.collect()]
    assert got == sorted(got, reverse=True) and sum(got) == pytest.approx(1, abs=1e-6)


def test_mice_recovers_a_linear_column(spark):
    rnd = random.Random(1)
    rows = [(x := rnd.gauss(0, 1), y := rnd.gauss(0, 1), None if i % 6 == 0 else 2 * x - y + 4) for i in range(240)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    worst = models.impute_mice(df).agg(F.max(F.abs(F.col("c") - (2 * F.col("a") - F.col("b") + 4)))).first()[0]
    assert worst < 1e-3


def test_class_metrics_with_a_class_never_predicted(spark):
    p = spark.createDataFrame([(0, 0.0), (0, 0.0), (1, 0.0), (2, 2.0)], "label int, prediction double")
    got = {r["class"]: (r["precision"], r["recall"], r["f1"]) for r in evaluate.class_report(p).collect()}
    assert got[1] == (0.0, 0.0, 0.0) and got[2] == (1.0, 1.0, 1.0)
    m = {r["metric"]: r["value"] for r in evaluate.classification_metrics(p).collect()}
    assert m["accuracy"] == 0.75 and m["precision_weighted"] == pytest.approx((2 / 3 * 2 + 0 + 1) / 4)


def test_number_targets_are_classes(spark):
    """Labels -1/1 and years: indexed, trained on and decoded."""
    rnd = random.Random(3)
    for values in ((-1, 1), (1990, 1991, 1992)):
        rows = [(i, x, values[min(len(values) - 1, int(x))]) for i in range(200) for x in [rnd.uniform(0, len(values))]]
        df = spark.createDataFrame(rows, "id int, x double, y int")
        _, preds, run = models.train_model(df, "y", "decision_tree", ["x"], key=["id"])
        assert run.first()["metrics"]["accuracy"] > 0.9
        assert {r[0] for r in preds.select("predicted").distinct().collect()} <= {str(v) for v in values}


def test_ridge_penalty_against_normal_equations(spark):
    rnd = random.Random(4)
    for n in (50, 4000):
        xs = [rnd.uniform(0, 2) for _ in range(n)]
        df = spark.createDataFrame([(x, 3 * x + 1) for x in xs], "x double, label double")
        ready = models.VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
        mean = sum(xs) / n
        spread = sum((x - mean) ** 2 for x in xs)
        fit = models.estimator("ridge", models.REGRESSION, rows=n, label_std=3 * (spread / n) ** 0.5).fit(ready)
        slope = fit.coefficients[0]
        assert abs(slope - 3 * spread / (spread + 1)) < 1e-4


def test_chained_imputation_against_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 3))
    x = np.column_stack([base[:, 0], base[:, 0] * 2 + base[:, 1], base[:, 1] - base[:, 2] * 0.1 + 50])
    gap = np.zeros_like(x, bool)
    gap[rng.choice(300, 40, False), 1] = True
    gap[rng.choice(300, 60, False), 2] = True
    data = [(int(i), *[None if gap[i, j] else float(x[i, j]) for j in range(3)]) for i in range(300)]
    got = models.impute_mice(spark.createDataFrame(data, "id int, a double, b double, c double"), ["a", "b", "c"], rounds=4, tolerance=0)
    got = np.array([[r["a"], r["b"], r["c"]] for r in got.orderBy("id").collect()])
    want = np.where(gap, np.nan, x)
    want = np.where(gap, np.nanmean(want, axis=0), want)
    for _ in range(4):
        for j in (1, 2):
            others = [k for k in range(3) if k != j]
            design = np.column_stack([np.ones(300), want[:, others]])
            beta = np.linalg.lstsq(design[~gap[:, j]], want[~gap[:, j], j], rcond=None)[0]
            want[gap[:, j], j] = (design @ beta)[gap[:, j]]
    assert np.allclose(got, want, atol=1e-6)


def test_leaderboard_reports_a_model_that_fails(easy):
    board = {r["model"]: r for r in models.automl(easy.where("y is not null"), "label_text", ["x", "y"], ["logistic", "nothing", "knn"],
                                                  k=2, key=["id"]).collect()}
    assert board["nothing"]["mean_score"] is None and "unknown" in board["nothing"]["error"]
    assert board["knn"]["mean_score"] > 0.85 and board["logistic"]["folds"] == 2


@pytest.mark.parametrize("name, width", [("train_adaboost", 5), ("train_adaboost_reg", 4)])
def test_registered_boosting_has_the_whole_table_and_all_rounds(spark, monkeypatch, name, width):
    from tablescope.plans import QUERIES

    class Reached(Exception):
        pass

    def boost(data, *task, **options):
        assert not options and data.count() > 4000 and len(data.first()["features"]) >= width
        raise Reached

    monkeypatch.setattr(models, "train_adaboost", boost)
    with pytest.raises(Reached):
        QUERIES[name](spark, SF_DIR)


@pytest.mark.parametrize("name", ["automl", "automl_reg"])
def test_registered_leaderboards_try_every_model(spark, monkeypatch, name):
    from tablescope.plans import QUERIES
    monkeypatch.setattr(models, "automl", lambda df, target, features, chosen=None, **rest: spark.range(0 if chosen else 1))
    assert QUERIES[name](spark, SF_DIR).count() == 1
