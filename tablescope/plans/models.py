"""Run comparison, training, validation, neighbours, clustering."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from tablescope.operators import clusters, evaluate, models, neighbours, runs
from tablescope.operators.clean import impute_constant
from tablescope.plans.registry import query
from tablescope.sources import store

# --- runs: one run per supplier, scoring quantity * 1500 as a forecast of the price ---------

_RUN = """
SELECT sha256(s_suppkey::VARCHAR) AS id, s_name AS name, s_suppkey, s_acctbal >= 5000 AS rich, sqrt(avg((l_extendedprice - l_quantity * 1500) ** 2)) AS rmse,
  avg(abs(l_extendedprice - l_quantity * 1500)) AS mae,
  avg((abs(l_extendedprice - l_quantity * 1500) < 10000)::INT::DOUBLE) AS accuracy, avg(l_discount) AS f1,
  max(l_shipdate) AS ts FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name, s_acctbal"""


def _runs(t):
    miss = F.col("l_extendedprice") - F.col("l_quantity") * 1500
    per = t.lineitem.groupBy("l_suppkey").agg(
        F.sqrt(F.avg(miss * miss)).alias("rmse"), F.avg(F.abs(miss)).alias("mae"),
        F.avg((F.abs(miss) < 10000).cast("double")).alias("accuracy"), F.avg("l_discount").alias("f1"),
        F.max("l_shipdate").alias("ts"))
    base = F.create_map(F.lit("rmse"), F.col("rmse"), F.lit("mae"), F.col("mae"), F.lit("accuracy"), F.col("accuracy"))
    both = F.map_concat(base, F.create_map(F.lit("f1"), F.col("f1")))
    rich = F.col("s_acctbal") >= 5000  # only these runs report f1
    return per.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.sha2(F.col("s_suppkey").cast("string"), 256).alias("id"), F.col("s_name").alias("name"),
        F.create_map(F.lit("model"), F.lit("rule"), F.lit("n_features"), F.lit("1")).alias("params"),
        F.when(rich, both).otherwise(base).alias("metrics"), F.lit("done").alias("status"),
        F.array(F.when(rich, "rich").otherwise("poor")).alias("tags"), "ts")


@cache
def _id(n: int) -> str:
    from hashlib import sha256
    return sha256(str(n).encode()).hexdigest()


@query("list_experiments", f"SELECT id, name, ts FROM ({_RUN}) WHERE rich ORDER BY ts DESC, id LIMIT 20")
def _(t):
    return runs.list_experiments(_runs(t), "rich", 20).select("id", "name", "ts")


@query("experiment_summary", f"""
SELECT upper(substring(id, 1, 8)) AS run_id, ts, name, 'Unknown' AS problem_type, 'rule' AS model, 1::INTEGER AS n_features,
  round(accuracy, 4) + 0.0 AS accuracy, CASE WHEN rich THEN round(f1, 4) + 0.0 END AS f1, NULL::DOUBLE AS r2,
  round(rmse, 4) + 0.0 AS rmse, NULL::DOUBLE AS "precision", NULL::DOUBLE AS recall FROM ({_RUN})""")
def _(t):
    return runs.experiment_summary(_runs(t))


_LONG = f"""long AS (SELECT id, name, 'rmse' AS metric, rmse AS value FROM ({_RUN}) UNION ALL SELECT id, name, 'mae', mae FROM ({_RUN})
  UNION ALL SELECT id, name, 'accuracy', accuracy FROM ({_RUN}) UNION ALL SELECT id, name, 'f1', f1 FROM ({_RUN}) WHERE rich)"""


@query("best_runs", f"WITH {_LONG} SELECT id, name, metric, round(value, 6) + 0.0 AS value, value = max(value) OVER (PARTITION BY metric) "
       "AS is_best FROM long")
def _(t):
    return runs.best_runs(_runs(t))


@query("common_metrics", f"WITH {_LONG} SELECT metric FROM long WHERE id IN ('{_id(1)}', '{_id(2)}', '{_id(4)}') "
       "GROUP BY metric HAVING count(DISTINCT id) = 3")
def _(t):
    return runs.common_metrics(_runs(t), [_id(1), _id(2), _id(4)])


@query("missing_ids", f"SELECT x AS id FROM (VALUES ('{_id(1)}'), ('nothing'), ('{_id(0)}')) v(x) WHERE x NOT IN (SELECT id FROM ({_RUN}))")
def _(t):
    return runs.missing_ids(_runs(t), [_id(1), "nothing", _id(0)])


def _compare(ids) -> str:
    return f"""
WITH {_LONG}, b AS (SELECT * FROM long WHERE id = '{ids[0]}'),
o AS (SELECT * FROM long WHERE id IN ({', '.join(f"'{i}'" for i in ids[1:])}))
SELECT b.id AS baseline_id, o.id AS comparison_id, metric, round(b.value, 6) + 0.0 AS baseline_value,
  round(o.value, 6) + 0.0 AS comparison_value, round((o.value - b.value) / abs(b.value) * 100, 2) + 0.0 AS change_percent,
  CASE WHEN (metric IN ('rmse', 'mae') AND o.value < b.value) OR (metric NOT IN ('rmse', 'mae') AND o.value > b.value)
    THEN 'improvement' ELSE 'regression' END AS direction FROM b JOIN o USING (metric)
WHERE metric IN (SELECT metric FROM long WHERE id IN ({', '.join(f"'{i}'" for i in ids)}) GROUP BY metric HAVING count(*) = {len(ids)})"""


@query("experiment_compare", _compare([_id(2), _id(4), _id(7)]))
def _(t):
    return runs.experiment_compare(_runs(t), [_id(2), _id(4), _id(7)])


@query("experiment_join", "SELECT comparison_id, metric, baseline_value, comparison_value FROM (" + _compare([_id(3), _id(5)]) + ")")
def _(t):
    return runs.experiment_join(_runs(t), _id(3), [_id(5)])


@query("ab_compare", f"""
SELECT 'accuracy' AS metric, round(a, 6) + 0.0 AS score_a, round(b, 6) + 0.0 AS score_b,
  CASE WHEN a > b THEN 'A' WHEN b > a THEN 'B' ELSE 'Tie' END AS winner,
  round(abs(a - b) / greatest(a, b, 1e-9) * 100, 2) + 0.0 AS improvement_pct
FROM (SELECT max(accuracy) FILTER (s_suppkey = 1) AS a, max(accuracy) FILTER (s_suppkey = 2) AS b FROM ({_RUN}))""")
def _(t):
    return runs.ab_compare(_runs(t), _id(1), _id(2))


# --- splits and scores ---------------------------------------------------------------------


@query("detect_task", """
SELECT 'l_returnflag' AS target, count(DISTINCT l_returnflag) AS distinct_values, 'classification' AS task FROM lineitem
UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber), CASE WHEN count(DISTINCT l_linenumber) <= 20 THEN 'classification' ELSE 'regression' END FROM lineitem
UNION ALL SELECT 'l_extendedprice', count(DISTINCT l_extendedprice), CASE WHEN count(DISTINCT l_extendedprice) <= 20 THEN 'classification' ELSE 'regression' END FROM lineitem""")
def _(t):
    a, b, c = (evaluate.detect_task(t.lineitem, x) for x in ("l_returnflag", "l_linenumber", "l_extendedprice"))
    return a.unionByName(b).unionByName(c)


@query("train_test_split", """
SELECT o_orderpriority, (floor(0.2 * (count(*) - 1)) + 1)::BIGINT AS test_rows, (count(*) - floor(0.2 * (count(*) - 1)) - 1)::BIGINT AS train_rows
FROM orders GROUP BY o_orderpriority""")
def _(t):
    flagged = evaluate.split_flag(t.orders, "o_orderpriority", 0.2, ["o_orderkey"])
    return flagged.groupBy("o_orderpriority").agg(
        F.count_if("is_test").alias("test_rows"), F.count_if(~F.col("is_test")).alias("train_rows"))


_CM = """
c AS (SELECT label, prediction, count(*) AS n FROM predictions GROUP BY ALL),
k AS (SELECT label AS class, sum(n) AS support, sum(n) FILTER (label = prediction) AS hits,
      (SELECT sum(n) FROM c d WHERE d.prediction = c.label) AS predicted FROM c GROUP BY label),
m AS (SELECT class, hits / predicted AS p, hits / support AS r, support, hits FROM k)"""


@query("classification_metrics", f"WITH {_CM}" + """
SELECT 'accuracy' AS metric, sum(hits) / sum(support) AS value FROM m UNION ALL SELECT 'precision_weighted', sum(p * support) / sum(support) FROM m
UNION ALL SELECT 'recall_weighted', sum(r * support) / sum(support) FROM m
UNION ALL SELECT 'f1_weighted', sum(2 * p * r / (p + r) * support) / sum(support) FROM m""", derived=["predictions"], doubles=["value"])
def _(t):
    return evaluate.classification_metrics(t.predictions)


@query("class_report", f"WITH {_CM} SELECT class, p AS \"precision\", r AS recall, 2 * p * r / (p + r) AS f1, support::BIGINT AS support, "
       "hits::BIGINT AS hits FROM m", derived=["predictions"], doubles=['"precision"', "recall", "f1"])
def _(t):
    return evaluate.class_report(t.predictions)


@query("confusion_matrix", "SELECT label, prediction, count(*) AS \"count\" FROM predictions GROUP BY ALL", derived=["predictions"])
def _(t):
    return evaluate.confusion_matrix(t.predictions)


@query("roc_auc", """
WITH s AS (SELECT label, (rank() OVER (ORDER BY score) + count(*) OVER (PARTITION BY score) / 2.0 - 0.5) AS r FROM
  (SELECT label, score::DOUBLE AS score FROM predictions))
SELECT (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
  / (count(*) FILTER (label = 1) * count(*) FILTER (label <> 1)) AS roc_auc FROM s""", derived=["predictions"], doubles=["roc_auc"])
def _(t):
    return evaluate.roc_auc(t.predictions)


@query("regression_metrics", """
WITH m AS (SELECT avg((label - prediction) ** 2) AS mse, avg(abs(label - prediction)) AS mae,
  avg(abs(label - prediction) / greatest(abs(label), 2.220446049250313e-16)) AS mape, var_pop(label) AS v FROM regression_preds)
SELECT 'mse' AS metric, mse AS value FROM m UNION ALL SELECT 'rmse', sqrt(mse) FROM m UNION ALL SELECT 'mae', mae FROM m
UNION ALL SELECT 'r2', 1 - mse / v FROM m UNION ALL SELECT 'mape', mape FROM m""", derived=["regression_preds"], doubles=["value"], digits=3)
def _(t):
    return evaluate.regression_metrics(t.regression_preds)


# --- training ------------------------------------------------------------------------------

FLAG = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"]
PRICE = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _classify(name: str, target: str = "l_returnflag", **options):
    def run(t):
        _, _, run_row = models.train_model(t.lineitem, target, name, FLAG, key=KEY, **options)
        return run_row.select("name", F.explode("metrics").alias("metric", "value"))
    return run


def _regress(name: str, **options):
    def run(t):
        _, _, run_row = models.train_model(t.lineitem, "l_extendedprice", name, PRICE, key=KEY, **options)
        return run_row.select("name", F.explode("metrics").alias("metric", "value"))
    return run


for _name in ("random_forest", "gbt", "extra_trees", "decision_tree", "logistic", "svm", "naive_bayes"):
    query(f"train_{_name}")(_classify(_name))
for _name in ("random_forest", "gbt", "extra_trees", "decision_tree", "linear", "ridge", "lasso", "svr"):
    _key = f"train_{_name}" if _name in ("linear", "ridge", "lasso", "svr") else f"train_{_name}_reg"
    query(_key)(_regress(_name))


@query("train_linear_one_feature", "SELECT regr_slope(l_extendedprice, l_quantity) AS slope, "
       "regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem", doubles=["slope", "intercept"], digits=2)
def _(t):
    from pyspark.ml.feature import VectorAssembler
    ready = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(
        t.lineitem.select("l_quantity", F.col("l_extendedprice").alias("label")))
    fit = models.estimator("linear", models.REGRESSION).fit(ready)
    return t.spark.createDataFrame([(float(fit.coefficients[0]), float(fit.intercept))], "slope double, intercept double")


def _vectors(t, target: str, names):
    data, _ = models.encode_target(t.lineitem.select(*dict.fromkeys([*KEY, target, *names])), target)
    return models.preprocess(data.drop("label"), target, names).fit(data).transform(data).select(*KEY, "features", "label")


@query("train_adaboost")
def _(t):
    seen, held = evaluate.train_test_split(_vectors(t, "l_returnflag", FLAG), "label", 0.2, KEY, stratify=True)
    stages = models.train_adaboost(seen)
    return evaluate.classification_metrics(models.predict_adaboost(stages, held))


@query("train_adaboost_reg")
def _(t):
    seen, held = evaluate.train_test_split(_vectors(t, "l_extendedprice", PRICE), "label", 0.2, KEY, stratify=False)
    stages = models.train_adaboost(seen, models.REGRESSION)
    return evaluate.regression_metrics(models.predict_adaboost(stages, held, models.REGRESSION))


@query("preprocess", "SELECT 6 + count(DISTINCT l_returnflag)::INTEGER AS vector_size, count(*) AS rows FROM lineitem_gaps",
       derived=["lineitem_gaps"])
def _(t):
    prep = models.preprocess(t.lineitem_gaps, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_returnflag"],
                             scaling="minmax", interactions=True)
    made = prep.fit(t.lineitem_gaps).transform(t.lineitem_gaps)
    size = F.size(models.vector_to_array("features"))
    return made.groupBy(size.alias("vector_size")).agg(F.count("*").alias("rows"))


@query("encode_target", """
SELECT o_orderpriority, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS label, count(*) AS rows, o_orderpriority AS back
FROM orders GROUP BY o_orderpriority""")
def _(t):
    data, labels = models.encode_target(t.orders, "o_orderpriority")
    back = models.decode_target(data.withColumn("prediction", F.col("label")), labels, "back")
    return back.groupBy("o_orderpriority", "label", "back").agg(F.count("*").alias("rows"))


def _forest(t):
    return models.train_model(t.orders, "o_orderstatus", "decision_tree", ["o_totalprice", "o_orderpriority"], key=["o_orderkey"])


@query("train_model")
def _(t):
    _, _, run = models.train_model(t.orders, "o_orderstatus", "logistic", ["o_totalprice", "o_orderpriority"],
                                   key=["o_orderkey"], cv=5)
    return run.select("name", F.explode("metrics").alias("metric", "value"))


@query("cross_validate")
def _(t):
    data, _ = models.encode_target(t.orders, "o_orderstatus")
    prep = models.preprocess(t.orders, "o_orderstatus", ["o_totalprice", "o_orderpriority"])
    pipe = models.Pipeline(stages=[*prep.getStages(), models.estimator("decision_tree", models.CLASSIFICATION)])
    return models.cross_validate(data, pipe, models.CLASSIFICATION, 5, ["o_orderkey"])


def _text_facts(t):
    """A table with something to learn: the language of a text from the rates of some letters, its length from counts."""
    share = lambda c: (F.length("text") - F.length(F.replace(F.lower("text"), F.lit(c), F.lit("")))) / F.greatest(F.length("text"), F.lit(1))
    return t.documents.select(
        "doc_id", "lang", "n_chars", *[share(c).alias(f"rate_{i}") for i, c in enumerate(("e", "n", "t", "\u00e9", "\u00fc", "\u00f3"))],
        F.size(F.split("text", " ")).alias("words"), F.size(F.split("text", "\n")).alias("lines"))


@query("automl")
def _(t):
    return models.automl(_text_facts(t), "lang", [f"rate_{i}" for i in range(6)], key=["doc_id"])


@query("automl_reg")
def _(t):
    return models.automl(_text_facts(t), "n_chars", ["words", "lines"], key=["doc_id"])


@query("feature_importance")
def _(t):
    model, _, _ = models.train_model(t.lineitem, "l_extendedprice", "decision_tree", PRICE, key=KEY)
    return models.feature_importance(model, t.lineitem)


@query("predict", "SELECT count(*) AS rows FROM orders")
def _(t):
    model, _, _ = _forest(t)
    return models.predict(model, t.orders).where("prediction is not null").agg(F.count("*").alias("rows"))


@query("save_model", "SELECT count(*) AS same FROM orders")
def _(t):
    model, _, _ = _forest(t)
    path = store.scratch_dir(t.spark)
    models.save_model(model, path)
    a = models.predict(model, t.orders).select("o_orderkey", F.col("prediction").alias("a"))
    b = models.predict(models.load_model(path), t.orders).select("o_orderkey", F.col("prediction").alias("b"))
    return a.join(b, "o_orderkey").agg(F.count_if(F.col("a") == F.col("b")).alias("same"))


@query("load_model", "SELECT o_orderpriority, count(*) AS rows FROM orders GROUP BY o_orderpriority")
def _(t):
    model, _, _ = _forest(t)
    path = store.scratch_dir(t.spark)
    models.save_model(model, path)
    scored = models.predict(models.load_model(path), t.orders).where("prediction is not null")
    return scored.groupBy("o_orderpriority").agg(F.count("*").alias("rows"))


# --- neighbours ----------------------------------------------------------------------------


@query("impute_knn", """
WITH g AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS y FROM customer),
p AS (SELECT q.c_custkey, d.y, row_number() OVER (PARTITION BY q.c_custkey
       ORDER BY ((q.c_custkey - d.c_custkey)::DOUBLE * (q.c_custkey - d.c_custkey) + (q.c_nationkey - d.c_nationkey) * (q.c_nationkey - d.c_nationkey)), d.y) AS r
      FROM g q JOIN g d ON q.y IS NULL AND d.y IS NOT NULL)
SELECT g.c_custkey, g.c_nationkey::BIGINT AS c_nationkey, coalesce(g.y, f.m) AS c_acctbal FROM g LEFT JOIN
  (SELECT c_custkey, avg(y) AS m FROM p WHERE r <= 5 GROUP BY c_custkey) f USING (c_custkey)""", doubles=["c_acctbal"])
def _(t):
    gaps = t.customer.select("c_custkey", "c_nationkey", F.expr(
        "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END").alias("c_acctbal"))
    out = neighbours.impute_knn(gaps)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("c_custkey", "c_nationkey")})


# two columns with gaps: the distance runs over what both rows have, scaled to all three columns
@query("impute_knn_patterns", """
WITH g AS (SELECT c_custkey::DOUBLE AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey::DOUBLE END AS x,
             CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS y FROM customer),
p AS (SELECT q.k, j, CASE j WHEN 1 THEN d.x ELSE d.y END AS v,
        ((q.k - d.k) * (q.k - d.k) + coalesce((q.x - d.x) * (q.x - d.x), 0) + coalesce((q.y - d.y) * (q.y - d.y), 0))
          * (3.0::DOUBLE / (1 + (q.x - d.x IS NOT NULL)::INT + (q.y - d.y IS NOT NULL)::INT)) AS d2
      FROM g q JOIN (VALUES (1), (2)) w(j) ON CASE j WHEN 1 THEN q.x ELSE q.y END IS NULL
      JOIN g d ON CASE j WHEN 1 THEN d.x ELSE d.y END IS NOT NULL),
f AS (SELECT k, j, avg(v) AS m FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY k, j ORDER BY d2, v) <= 5) GROUP BY k, j)
SELECT g.k::BIGINT AS c_custkey, coalesce(g.x, a.m) AS c_nationkey, coalesce(g.y, b.m) AS c_acctbal
FROM g LEFT JOIN f a ON a.k = g.k AND a.j = 1 LEFT JOIN f b ON b.k = g.k AND b.j = 2""", doubles=["c_nationkey", "c_acctbal"])
def _(t):
    gaps = t.customer.select(
        "c_custkey", F.expr("CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END").alias("c_nationkey"),
        F.expr("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END").alias("c_acctbal"))
    return neighbours.impute_knn(gaps).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


# customers are the training rows, suppliers the rows to predict; both have a balance and a nation
_KNN = """
WITH z AS (SELECT avg(c_acctbal) AS m0, stddev_pop(c_acctbal) AS s0, avg(c_nationkey) AS m1, stddev_pop(c_nationkey) AS s1 FROM customer),
p AS (SELECT s_suppkey, {y} AS y, row_number() OVER (PARTITION BY s_suppkey ORDER BY
        pow((s_acctbal - m0) / s0 - (c_acctbal - m0) / s0, 2) + pow((s_nationkey - m1) / s1 - (c_nationkey - m1) / s1, 2), {y}) AS r
      FROM supplier, customer, z)"""


def _suppliers(t):
    return t.supplier.select("s_suppkey", F.col("s_acctbal").alias("c_acctbal"), F.col("s_nationkey").alias("c_nationkey"))


@query("train_knn", _KNN.format(y="c_mktsegment") + """,
v AS (SELECT s_suppkey, y, count(*) AS n FROM p WHERE r <= 5 GROUP BY ALL)
SELECT s_suppkey, y AS segment FROM v QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY n DESC, y) = 1""")
def _(t):
    train, labels = models.encode_target(t.customer, "c_mktsegment")
    preds = neighbours.predict_knn(train, _suppliers(t), ["c_acctbal", "c_nationkey"], "label", models.CLASSIFICATION)
    return models.decode_target(preds, labels, "segment").select("s_suppkey", "segment")


@query("train_knn_reg", _KNN.format(y="c_custkey") + " SELECT s_suppkey, avg(y)::DOUBLE AS prediction FROM p WHERE r <= 5 "
       "GROUP BY s_suppkey", doubles=["prediction"])
def _(t):
    preds = neighbours.predict_knn(t.customer, _suppliers(t), ["c_acctbal", "c_nationkey"], "c_custkey", models.REGRESSION)
    return preds.select("s_suppkey", "prediction")


@query("impute_mice", """
WITH m AS (SELECT regr_slope(l_tax, l_extendedprice) AS b, regr_intercept(l_tax, l_extendedprice) AS a FROM lineitem_gaps)
SELECT l_orderkey, l_linenumber, coalesce(l_tax, a + b * l_extendedprice) AS l_tax FROM lineitem_gaps, m""",
       derived=["lineitem_gaps"], doubles=["l_tax"], digits=5)
def _(t):
    out = models.impute_mice(t.lineitem_gaps, ["l_extendedprice", "l_tax"])
    return out.select("l_orderkey", "l_linenumber", "l_tax")


@query("impute_mice_two")
def _(t):
    gaps = impute_constant(t.lineitem_gaps)
    out = models.impute_mice(gaps, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.agg(F.count("*").alias("rows"), F.count("l_discount").alias("l_discount"), F.count("l_tax").alias("l_tax"),
                   F.avg("l_tax").alias("mean_tax"))


# --- clusters ------------------------------------------------------------------------------


@query("cluster_kmeans")
def _(t):
    _, sizes = models.cluster_kmeans(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], 3)
    return sizes


@query("pca", """
SELECT 1::INTEGER AS component, (1 + abs(corr(l_quantity, l_extendedprice))) / 2 AS explained_variance_ratio FROM lineitem
UNION ALL SELECT 2, (1 - abs(corr(l_quantity, l_extendedprice))) / 2 FROM lineitem""", doubles=["explained_variance_ratio"])
def _(t):
    _, ratios = models.pca(t.lineitem, ["l_quantity", "l_extendedprice"], 2)
    return ratios


@query("pca_four")
def _(t):
    _, ratios = models.pca(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2)
    return ratios


@query("pca_scores")
def _(t):
    rows, _ = models.pca(t.customer, ["c_acctbal", "c_nationkey"], 2)
    return rows


@query("cluster_dbscan", """
WITH RECURSIVE p AS MATERIALIZED (SELECT c_custkey AS i, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS x,
  (c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS y FROM customer),
near AS MATERIALIZED (SELECT a.i, b.i AS j FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.01 * (1 + 1e-12)),
core AS MATERIALIZED (SELECT i FROM near GROUP BY i HAVING count(*) >= 5),
link AS MATERIALIZED (SELECT i, j FROM near WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
reach AS (SELECT i, j FROM link UNION SELECT r.i, l.j FROM reach r JOIN link l ON r.j = l.i)
SELECT (SELECT count(DISTINCT root) FROM (SELECT i, min(j) AS root FROM reach GROUP BY i)) AS clusters,
  (SELECT count(*) FROM p) AS rows,
  (SELECT count(*) FROM p WHERE i NOT IN (SELECT n.i FROM near n JOIN core c ON n.j = c.i)) AS noise""")
def _(t):
    labelled = clusters.cluster_dbscan(t.customer, ["c_acctbal", "c_nationkey"], eps=0.1, min_pts=5)
    found = F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster")))
    return labelled.agg(found.alias("clusters"), F.count("*").alias("rows"), F.count_if(F.col("cluster") < 0).alias("noise"))


@query("cluster_dbscan_sizes")
def _(t):
    labelled = clusters.cluster_dbscan(t.customer, ["c_acctbal", "c_nationkey"], eps=0.1, min_pts=5)
    return clusters.cluster_sizes(labelled)
