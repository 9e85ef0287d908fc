"""Preprocessing, training, validation, prediction, clustering and projection with MLlib."""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml import classification as mlc
from pyspark.ml import regression as mlr
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import (
    PCA, FeatureHasher, Imputer, IndexToString, MaxAbsScaler, MinMaxScaler, OneHotEncoder,
    PolynomialExpansion, RobustScaler, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.checkpoints import discard, stored
from tablescope.functions.gram import pair_sums
from tablescope.functions.columns import as_double, col, nan_to_null, numeric_columns, require_columns, scalar_stats
from tablescope.operators.boosting import CLASSIFICATION, REGRESSION, AdaBoost, BoostedTrees, fit_adaboost, with_outputs
from tablescope.operators.clean import impute, mode_values
from tablescope.operators.evaluate import (
    classification_metrics, detect_task, feature_columns, regression_metrics, roc_auc, train_test_split,
    with_folds,
)
from tablescope.operators.kernels import KernelMap, KernelSquares
from tablescope.operators.trees import GrownTrees

SEED = 42
HASHED_SLOTS = 1 << 18  # of text features encoded with encoding="hash"
MISSING = "missing"

SCALERS = {
    "standard": lambda **io: StandardScaler(withMean=True, withStd=True, **io),
    "minmax": MinMaxScaler, "robust": lambda **io: RobustScaler(withCentering=True, **io), "maxabs": MaxAbsScaler,
}


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def preprocess(df: DataFrame, target: str, features: Sequence[str] = (), encoding: str = "onehot",
               scaling: str = "standard", poly_degree: int = 1, interactions: bool = False,
               text_fill: str = "most_frequent", out: str = "features") -> Pipeline:
    """Pipeline from raw columns to one feature vector.

    Numbers: median for missing, scaling, optionally polynomial or pairwise product terms. Text:
    the most frequent label (or ``missing``) for missing, then one-hot with unknown labels all
    zero, ordinal codes with -1 for unknown labels, or hashed slots (for columns with more labels than the driver should
    keep).
    """
    nums, texts = feature_columns(df, target, features)
    if not nums and not texts:
        raise ValueError("no numeric or text features")
    stages: list[Any] = []
    parts: list[str] = []
    if nums:
        casts = ", ".join(f"cast({_quoted(c)} AS double) AS num_{i}" for i, c in enumerate(nums))
        made = [f"num_{i}" for i in range(len(nums))]
        stages += [SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__"),
                   Imputer(strategy="median", inputCols=made, outputCols=made, relativeError=1e-4),
                   VectorAssembler(inputCols=made, outputCol="num_raw", handleInvalid="keep")]
        last = "num_raw"
        if scaling != "none":
            stages.append(SCALERS[scaling](inputCol=last, outputCol="num_scaled"))
            last = "num_scaled"
        if poly_degree > 1:
            stages.append(PolynomialExpansion(degree=poly_degree, inputCol=last, outputCol="num_poly"))
            last = "num_poly"
        elif interactions and len(nums) > 1:
            # degree-2 terms without the squares; block i holds x_i, x_i*x_0, ..., x_i*x_i
            stages.append(PolynomialExpansion(degree=2, inputCol=last, outputCol="num_square"))
            kept = [i * (i + 3) // 2 + j for i in range(len(nums)) for j in range(i + 1)]
            stages.append(VectorSlicer(inputCol="num_square", outputCol="num_products", indices=kept))
            last = "num_products"
        parts.append(last)
    if texts:
        fills = dict.fromkeys(texts, MISSING)
        if text_fill == "most_frequent":
            fills |= {r["column"]: r["value"] for r in mode_values(df, texts, "string").collect()}
        for i, c in enumerate(texts):
            fill = fills[c].replace("\\", "\\\\").replace("'", "\\'")
            stages.append(SQLTransformer(
                statement=f"SELECT *, coalesce(cast({_quoted(c)} AS string), '{fill}') AS text_{i} FROM __THIS__"))
        idx = [f"code_{i}" for i in range(len(texts))]
        if encoding == "hash":
            stages.append(FeatureHasher(numFeatures=HASHED_SLOTS, inputCols=[f"text_{i}" for i in range(len(texts))], outputCol="hashed"))
            parts.append("hashed")
        else:
            stages.append(StringIndexer(inputCols=[f"text_{i}" for i in range(len(texts))], outputCols=idx,
                                        handleInvalid="keep", stringOrderType="alphabetAsc"))
        if encoding == "onehot":
            hot = [f"hot_{i}" for i in range(len(texts))]
            # the indexer's extra slot for unknown labels is last, and the last slot is dropped
            stages.append(OneHotEncoder(inputCols=idx, outputCols=hot, dropLast=True))
            parts += hot
        elif encoding == "ordinal":
            known = df.agg(*[F.count_distinct(F.coalesce(col(c).cast("string"), F.lit(fills[c]))) for c in texts]).first()
            for i in range(len(texts)):
                stages.append(SQLTransformer(
                    statement=f"SELECT *, CASE WHEN code_{i} >= {known[i]} THEN -1D ELSE code_{i} END AS ord_{i} FROM __THIS__"))
                parts.append(f"ord_{i}")
        elif encoding != "hash":
            raise ValueError(f"unknown encoding {encoding!r}")
    stages.append(VectorAssembler(inputCols=parts, outputCol=out, handleInvalid="keep"))
    return Pipeline(stages=stages)


# --- estimators ----------------------------------------------------------------------------


def estimator(name: str, task: str, classes: int = 2, trees: int = 100, depth: int | None = None, rows: int = 1,
              label_std: float = 1.0) -> Estimator | Pipeline:
    """Estimator for a model name: MLlib's, or the trees of :mod:`trees` and :mod:`boosting`. ``depth`` None grows trees fully
    and boosts trees of three levels.

    Ridge and logistic regression weigh a penalty of one against summed losses; MLlib weighs it against their mean over
    ``rows`` and divides the squared one by the (population) deviation of the label.
    """
    io = {"featuresCol": "features", "labelCol": "label"}
    grown = {
        "random_forest": lambda: GrownTrees(task, classes=classes, trees=trees, depth=depth,
                                            tries="sqrt" if task == CLASSIFICATION else "all"),
        "extra_trees": lambda: GrownTrees(task, classes=classes, trees=trees, depth=depth, bootstrap=False, at_random=True,
                                          tries="sqrt" if task == CLASSIFICATION else "all"),
        "decision_tree": lambda: GrownTrees(task, classes=classes, trees=1, depth=depth, bootstrap=False, tries="all"),
        "gbt": lambda: BoostedTrees(task, classes, trees, min(depth or 3, 3)),
    }
    kernel = {"featuresCol": "mapped", "labelCol": "label"}
    if task == CLASSIFICATION:
        svc = mlc.LinearSVC(maxIter=100, regParam=1 / rows, standardization=False, **kernel)
        made: dict[str, Any] = grown | {
            "logistic": lambda: mlc.LogisticRegression(maxIter=1000, regParam=1 / rows, standardization=False, **io),
            "svm": lambda: Pipeline(stages=[KernelMap(), svc if classes <= 2 else mlc.OneVsRest(classifier=svc, **kernel)]),
            "naive_bayes": lambda: mlc.NaiveBayes(modelType="gaussian", **io),
        }
    else:
        made = grown | {
            "linear": lambda: mlr.LinearRegression(solver="normal", **io),
            "ridge": lambda: mlr.LinearRegression(
                solver="normal", regParam=label_std / rows, elasticNetParam=0.0, standardization=False, **io),
            "lasso": lambda: mlr.LinearRegression(
                regParam=1.0, elasticNetParam=1.0, maxIter=1000, standardization=False, **io),
            "svr": lambda: KernelSquares(rows, label_std),
        }
    if name not in made:
        raise ValueError(f"unknown {task} model {name!r}; known: {', '.join(made)}")
    return made[name]()


def _size_and_spread(train: DataFrame) -> tuple[int, float]:
    row = train.agg(F.count("label").alias("n"), F.stddev_pop("label").alias("s")).first()
    return max(1, row["n"]), row["s"] or 1.0


def encode_target(df: DataFrame, target: str, out: str = "label", task: str | None = None) -> tuple[DataFrame, list[str] | None]:
    """Numeric label column; class labels, texts or numbers, become 0..k-1 in sorted order and their names are returned."""
    numeric = target in numeric_columns(df)
    if numeric and task != CLASSIFICATION:
        return df.where(col(target).isNotNull()).withColumn(out, as_double(target)), None
    names = df.withColumn("_class", col(target).cast("string"))
    indexer = StringIndexer(inputCol="_class", outputCol=out, stringOrderType="alphabetAsc", handleInvalid="skip")
    model = indexer.fit(names)
    coded = model.transform(names).drop("_class")
    return coded if numeric else coded.withColumn(target, col(target).cast("string")), list(model.labels)


def decode_target(preds: DataFrame, labels: Sequence[str], out: str = "predicted") -> DataFrame:
    return IndexToString(inputCol="prediction", outputCol=out, labels=list(labels)).transform(preds)


def _score(preds: DataFrame, task: str) -> float:
    table = classification_metrics(preds) if task == CLASSIFICATION else regression_metrics(preds)
    wanted = "f1_weighted" if task == CLASSIFICATION else "r2"
    return table.where(F.col("metric") == wanted).first()["value"]


def cross_validate(df: DataFrame, pipeline: Pipeline, task: str, k: int = 5, key: Sequence[str] = ()) -> DataFrame:
    """Score per fold; ``df`` has a ``label`` column and folds keep the share of every class."""
    folded, path = stored(with_folds(df, k, key, "label" if task == CLASSIFICATION else None))

    def fold_score(i: int) -> float:
        model = pipeline.fit(folded.where(F.col("fold") != i))
        return _score(model.transform(folded.where(F.col("fold") == i)), task)

    try:
        scores = list(enumerate(at_once(fold_score, range(k))))
    finally:
        discard(df.sparkSession, path)
    return df.sparkSession.createDataFrame(scores, "fold int, score double")


def at_once(work, items: Sequence[Any]) -> list[Any]:
    """Results of ``work`` for the items, whose Spark jobs run side by side; the cluster's scheduler shares the cores."""
    with ThreadPoolExecutor(max(1, len(items))) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(work), items))


def feature_importance(model: PipelineModel, sample: DataFrame, top: int = 20) -> DataFrame:
    """Largest importances with the names of the vector slots, for tree models."""
    weights = model.stages[-1].featureImportances.toArray()
    groups = model.transform(sample.limit(1)).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for attrs in groups.values() for a in attrs}
    rows = sorted(((names.get(i, f"feature_{i}"), float(w)) for i, w in enumerate(weights)), key=lambda r: (-r[1], r[0]))
    return sample.sparkSession.createDataFrame(rows[:top], "feature string, importance double")


def train_model(df: DataFrame, target: str, model: str, features: Sequence[str] = (), task: str | None = None,
                test_size: float = 0.2, key: Sequence[str] = (), cv: int = 0, run_id: str = "run",
                trees: int = 100, depth: int | None = None, **options: Any) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Select, encode, split, preprocess, fit, evaluate.

    Returns the fitted pipeline, the test predictions, and one row for a runs table.
    """
    start = time.time()
    require_columns(df, [target, *features])
    task = task or detect_task(df, target).first()["task"]
    nums, texts = feature_columns(df, target, features)
    data, labels = encode_target(df.select(*dict.fromkeys([*nums, *texts, target, *key])), target, task=task)
    n_classes = len(labels or [])
    train, test = train_test_split(data, "label", test_size, key, stratify=task == CLASSIFICATION)
    train = train.persist(StorageLevel.MEMORY_AND_DISK)  # read by every stage and every iteration
    prep = preprocess(data.drop("label"), target, [*nums, *texts], **options)
    est = estimator(model, task, n_classes, trees, depth, *_size_and_spread(train))
    pipe = Pipeline(stages=[*prep.getStages(), est])
    try:
        fitted = pipe.fit(train)
    finally:
        train.unpersist()
    preds = fitted.transform(test)
    table = classification_metrics(preds) if task == CLASSIFICATION else regression_metrics(preds)
    metrics = {r["metric"]: r["value"] for r in table.collect()}  # a handful of scores
    if n_classes == 2 and "probability" in preds.columns:
        scored = preds.select("label", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
        metrics["roc_auc"] = roc_auc(scored).first()["roc_auc"]
    if cv:
        scores = [r["score"] for r in cross_validate(data, pipe, task, cv, key).collect()]
        metrics["cv_mean"] = sum(scores) / len(scores)
    params = {"model": model, "problem_type": task, "n_features": str(len(nums) + len(texts)), "target": target}
    run = df.sparkSession.createDataFrame(
        [(run_id, model, params, metrics, "done", [task], time.time() - start)],
        "id string, name string, params map<string,string>, metrics map<string,double>, status string, "
        "tags array<string>, seconds double").withColumn("ts", F.current_timestamp())
    return fitted, decode_target(preds, labels) if labels else preds, run


AUTOML = {
    CLASSIFICATION: ("random_forest", "gbt", "logistic", "svm", "decision_tree", "naive_bayes", "extra_trees", "knn"),
    REGRESSION: ("random_forest", "gbt", "linear", "ridge", "svr", "decision_tree", "lasso", "extra_trees", "knn"),
}


def automl(df: DataFrame, target: str, features: Sequence[str] = (), models: Sequence[str] | None = None, k: int = 5,
           key: Sequence[str] = (), trees: int = 100, depth: int | None = None) -> DataFrame:
    """Cross-validated leaderboard ``(model, mean_score, std_score, folds, error)``.

    A model that fails on a fold has its error as a row and no mean, after those scored on all folds.
    """
    task = detect_task(df, target).first()["task"]
    nums, texts = feature_columns(df, target, features)
    data, labels = encode_target(df.select(*dict.fromkeys([*nums, *texts, target, *key])), target, task=task)
    n_classes = len(labels) if labels else 2
    prep = preprocess(data.drop("label"), target, [*nums, *texts])
    folded, path = stored(with_folds(data, k, key, "label" if task == CLASSIFICATION else None))

    def fold_scores(i: int) -> list[tuple[str, float | None, str | None]]:
        # the features are prepared once per fold and shared by all models
        fitted = prep.fit(folded.where(F.col("fold") != i))
        ready, ready_path = stored(fitted.transform(folded).select("features", "label", "fold"))
        seen, held = ready.where(F.col("fold") != i), ready.where(F.col("fold") == i)
        size, found = _size_and_spread(seen), []
        for name in models or AUTOML[task]:
            try:
                if name == "knn":
                    preds = _neighbours_on_vectors(seen, held, task)
                else:
                    preds = estimator(name, task, n_classes, trees, depth, *size).fit(seen).transform(held)
                found.append((name, _score(preds, task), None))
            except Exception as e:  # one model failing must not lose the others; it is reported
                found.append((name, None, f"fold {i}: {type(e).__name__}: {str(e).splitlines()[0][:200]}"))
        discard(df.sparkSession, ready_path)
        return found

    try:
        rows = [r for found in at_once(fold_scores, range(k)) for r in found]
    finally:
        discard(df.sparkSession, path)
    scores = df.sparkSession.createDataFrame(rows, "model string, score double, error string")
    whole = F.count("score") == k
    return scores.groupBy("model").agg(
        F.when(whole, F.avg("score")).alias("mean_score"), F.when(whole, F.stddev_pop("score")).alias("std_score"),
        F.count("score").alias("folds"), F.concat_ws("; ", F.collect_list("error")).alias("error")).orderBy(F.desc_nulls_last("mean_score"), "model")


def _neighbours_on_vectors(seen: DataFrame, held: DataFrame, task: str) -> DataFrame:
    """Predictions of the nearest neighbours of prepared feature vectors."""
    from tablescope.operators.neighbours import predict_knn

    size = len(seen.select(vector_to_array("features").alias("v")).first()["v"])
    names = [f"v{i}" for i in range(size)]
    spread = lambda d: d.select("label", *[F.get(vector_to_array("features"), F.lit(i)).alias(n) for i, n in enumerate(names)])
    return predict_knn(spread(seen), spread(held), names, "label", task)


def predict(model: Transformer, df: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    preds = model.transform(df)
    return decode_target(preds, labels) if labels else preds


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# --- boosting with weighted trees ----------------------------------------------------------


def train_adaboost(df: DataFrame, task: str = CLASSIFICATION, rounds: int = 100) -> AdaBoost:
    """AdaBoost on ``features`` and ``label``: SAMME with stumps for classes, R2 with trees of three levels for numbers."""
    return fit_adaboost(df, task, rounds)


def predict_adaboost(model: AdaBoost, df: DataFrame, task: str = CLASSIFICATION) -> DataFrame:
    """Weighted vote of the stages, or their weighted median."""
    return with_outputs(df, model.outputs, task, len(model.cuts)).select(*df.columns, "prediction")


# --- chained imputation --------------------------------------------------------------------


def _chain_step(rows: DataFrame, names: Sequence[str], target: int, shift: Sequence[float]) -> Column:
    """Least squares of one column on the others, from sums of products; an expression for its prediction."""
    moved = rows.select(*[(F.col(n) - s).alias(n) for n, s in zip(names, shift)])
    k = len(names)
    n, sums, products = 0.0, np.zeros(k), np.zeros((k, k))
    for r in pair_sums(moved, names, centred=False).collect():  # one row per pair of columns
        n, sums[r["i"]], products[r["i"], r["j"]] = r["n"], r["sx"], r["sxy"]
    others = [i for i in range(k) if i != target]
    means = sums / max(n, 1.0)
    spread = products - n * np.outer(means, means)
    slopes = np.linalg.lstsq(spread[np.ix_(others, others)], spread[others, target], rcond=1e-12)[0]
    out = F.lit(float(shift[target] + means[target]))
    for i, b in zip(others, slopes):
        out = out + F.lit(float(b)) * (F.col(names[i]) - F.lit(float(shift[i] + means[i])))
    return out


def impute_mice(df: DataFrame, cols: Sequence[str] | None = None, rounds: int = 10, tolerance: float = 1e-3) -> DataFrame:
    """Fill numeric columns by chained regressions, fewest missing values first.

    Missing cells start at the column mean; every round re-predicts them from the other columns.
    It stops early once no filled cell moves by more than ``tolerance`` of the largest value. A step reads sums of products;
    a round writes the row number and the numeric columns once and deletes what the round before wrote.
    """
    data = nan_to_null(df)
    cols = list(cols) if cols is not None else numeric_columns(df)
    counts = data.agg(*[F.count_if(col(c).isNull()) for c in cols]).first()
    gaps = [i for n, i in sorted(zip(counts, range(len(cols)))) if n]
    if not gaps:
        return data
    if len(cols) < 2:
        return impute(data, "mean", cols)
    spark, names = df.sparkSession, [f"x{i}" for i in range(len(cols))]
    whole, _ = stored(data.withColumn("_row", F.monotonically_increasing_id()))
    facts = whole.agg(*[f(as_double(c)).alias(f"{m}{i}") for i, c in enumerate(cols)
                        for m, f in (("mean", F.avg), ("lo", F.min), ("hi", F.max))]).first()
    shift = [facts[f"mean{i}"] or 0.0 for i in range(len(cols))]
    biggest = max([abs(facts[f"{m}{i}"] or 0.0) for i in range(len(cols)) for m in ("lo", "hi")], default=0.0) or 1.0
    state, path = stored(whole.select(
        "_row", *[F.coalesce(as_double(c), F.lit(s)).alias(n) for c, n, s in zip(cols, names, shift)],
        *[col(cols[i]).isNull().alias(f"g{i}") for i in gaps]))
    for _ in range(rounds):
        step = state.withColumns({f"o{i}": F.col(f"x{i}") for i in gaps})
        for i in gaps:
            fitted = _chain_step(step.where(~F.col(f"g{i}")), names, i, shift)
            step = step.withColumn(f"x{i}", F.when(F.col(f"g{i}"), fitted).otherwise(F.col(f"x{i}")))
        before, (made, path) = path, stored(step)
        discard(spark, before)
        moved = made.agg(F.max(F.greatest(*[F.abs(F.col(f"x{i}") - F.col(f"o{i}")) for i in gaps], F.lit(0.0)))).first()[0]
        state = made.drop(*[f"o{i}" for i in gaps])
        if (moved or 0.0) <= tolerance * biggest:
            break
    found = whole.join(state.select("_row", *[F.col(f"x{i}") for i in gaps]), "_row")
    made_of = {cols[i]: f"x{i}" for i in gaps}
    return found.select(*[F.col(made_of[c]).alias(c) if c in made_of else col(c) for c in data.columns])


# --- clusters and projections --------------------------------------------------------------


def scaled_vector(df: DataFrame, features: Sequence[str], out: str = "scaled") -> DataFrame:
    """Rows complete in the features, with the standardised feature vector."""
    data = nan_to_null(df).dropna(subset=list(features))
    casts = data.withColumns({f"_f{i}": as_double(c) for i, c in enumerate(features)})
    raw = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="_raw").transform(casts)
    model = StandardScaler(inputCol="_raw", outputCol=out, withMean=True, withStd=True).fit(raw)
    return model.transform(raw).drop("_raw", *[f"_f{i}" for i in range(len(features))])


def cluster_kmeans(df: DataFrame, features: Sequence[str], k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rows with their cluster, and ``(cluster, size, silhouette)``."""
    data = scaled_vector(df, features)
    labelled = KMeans(k=k, seed=SEED, featuresCol="scaled", predictionCol="cluster").fit(data).transform(data)
    score = ClusteringEvaluator(featuresCol="scaled", predictionCol="cluster").evaluate(labelled)
    sizes = labelled.groupBy("cluster").agg(F.count("*").alias("size")).withColumn("silhouette", F.lit(score))
    return labelled.drop("scaled"), sizes


def pca(df: DataFrame, features: Sequence[str], n: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows with their component scores, and ``(component, explained_variance_ratio)``."""
    data = scaled_vector(df, features)
    model = PCA(k=n, inputCol="scaled", outputCol="_pc").fit(data)
    scores = vector_to_array("_pc")
    rows = model.transform(data).select(*df.columns, *[F.get(scores, F.lit(i)).alias(f"pc{i + 1}") for i in range(n)])
    ratios = df.sparkSession.createDataFrame(
        [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance)], "component int, explained_variance_ratio double")
    return rows, ratios

