"""Comparison of training runs kept in a table.

A runs table has ``id, name, params map<string,string>, metrics map<string,double>, status,
tags array<string>, ts``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Metrics shown in summaries, and those for which less is better.
KEY_METRICS = ("accuracy", "f1", "r2", "rmse", "precision", "recall")
LOWER_IS_BETTER = ("rmse", "mse", "mae", "mape")


def list_experiments(runs: DataFrame, tag: str | None = None, limit: int = 50) -> DataFrame:
    """Newest runs first, optionally with an exact tag."""
    out = runs.where(F.array_contains("tags", tag)) if tag else runs
    return out.orderBy(F.desc("ts"), "id").limit(limit)


def experiment_summary(runs: DataFrame) -> DataFrame:
    metric = lambda m: F.round(F.try_element_at("metrics", F.lit(m)), 4).alias(m)
    param = lambda p, other: F.coalesce(F.try_element_at("params", F.lit(p)), F.lit(other)).alias(p)
    return runs.select(
        F.upper(F.substring("id", 1, 8)).alias("run_id"), "ts", "name", param("problem_type", "Unknown"),
        param("model", "Unknown"), param("n_features", "0").cast("int").alias("n_features"), *[metric(m) for m in KEY_METRICS])


def long_metrics(runs: DataFrame) -> DataFrame:
    """``(id, name, metric, value)``, NaN left out."""
    return runs.select("id", "name", F.explode("metrics").alias("metric", "value")).where(
        "value is not null and not isnan(value)")


def best_runs(runs: DataFrame) -> DataFrame:
    """Every run's metrics with a flag at the largest value of each metric."""
    long = long_metrics(runs)
    best = long.groupBy("metric").agg(F.max("value").alias("best"))
    return long.join(best, "metric").select("id", "name", "metric", "value", (F.col("value") == F.col("best")).alias("is_best"))


def wanted_ids(runs: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The requested ids with their place in the request."""
    return runs.sparkSession.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, place int")


def missing_ids(runs: DataFrame, ids: Sequence[str]) -> DataFrame:
    return wanted_ids(runs, ids).join(runs, "id", "left_anti").select("id")


def common_metrics(runs: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Metric names that all requested runs report."""
    long = long_metrics(runs.where(F.col("id").isin(*ids)))
    return long.groupBy("metric").agg(F.count_distinct("id").alias("runs")).where(
        F.col("runs") == len(set(ids))).select("metric").orderBy("metric")


def compare_to_baseline(runs: DataFrame, ids: Sequence[str], metrics: Sequence[str] | None = None) -> DataFrame:
    """Metrics of the other runs against those of the first, lazily and without checks."""
    picked = long_metrics(runs.where(F.col("id").isin(*ids)))
    if metrics:
        picked = picked.where(F.col("metric").isin(*metrics))
    else:
        picked = picked.join(common_metrics(runs, ids), "metric", "left_semi")
    base = picked.where(F.col("id") == ids[0]).select(
        "metric", F.col("id").alias("baseline_id"), F.col("value").alias("baseline_value"))
    other = picked.where(F.col("id") != ids[0]).select(
        "metric", F.col("id").alias("comparison_id"), F.col("value").alias("comparison_value"))
    b, c = F.col("baseline_value"), F.col("comparison_value")
    inf = F.when(c > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    change = F.when(b != 0, F.round((c - b) / F.nullif(F.abs(b), F.lit(0.0)) * 100, 2)).otherwise(inf)
    better = F.when(F.col("metric").isin(*LOWER_IS_BETTER), c < b).otherwise(c > b)
    return base.join(other, "metric").select(
        "baseline_id", "comparison_id", "metric", "baseline_value", "comparison_value", change.alias("change_percent"),
        F.when(better, "improvement").otherwise("regression").alias("direction"))


def experiment_compare(runs: DataFrame, ids: Sequence[str], metrics: Sequence[str] | None = None) -> DataFrame:
    """Compare two or more runs; unknown ids and runs without a common metric are errors."""
    if len(ids) < 2:
        raise ValueError("at least two runs are needed")
    absent = [r[0] for r in missing_ids(runs, ids).collect()]
    if absent:
        raise ValueError(f"unknown runs: {', '.join(sorted(absent))}")
    if not metrics and common_metrics(runs, ids).isEmpty():
        raise ValueError("the runs have no metric in common")
    return compare_to_baseline(runs, ids, metrics)


def experiment_join(runs: DataFrame, baseline_id: str, ids: Sequence[str]) -> DataFrame:
    """Metrics of the chosen runs beside those of the baseline, by metric name."""
    return compare_to_baseline(runs, [baseline_id, *[i for i in ids if i != baseline_id]]).select(
        "comparison_id", "metric", "baseline_value", "comparison_value")


def ab_compare(runs: DataFrame, a: str, b: str, metric: str = "accuracy") -> DataFrame:
    """Winner between two runs on one metric and by how many percent of the larger score."""
    score = runs.where(F.col("id").isin(a, b)).select(
        "id", F.coalesce(F.try_element_at("metrics", F.lit(metric)), F.lit(0.0)).alias("score"))
    row = score.agg(F.max(F.when(F.col("id") == a, F.col("score"))).alias("score_a"),
                    F.max(F.when(F.col("id") == b, F.col("score"))).alias("score_b"))
    x, y = F.col("score_a"), F.col("score_b")
    return row.where(x.isNotNull() & y.isNotNull()).select(
        F.lit(metric).alias("metric"), x, y, F.when(x > y, "A").when(y > x, "B").otherwise("Tie").alias("winner"),
        F.round(F.abs(x - y) / F.greatest(x, y, F.lit(1e-9)) * 100, 2).alias("improvement_pct"))
