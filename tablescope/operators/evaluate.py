"""Splits, folds and scores of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.checkpoints import checkpointed
from tablescope.functions.columns import as_double, col, inline_rows, numeric_columns, text_columns
from tablescope.functions.quantiles import grouped_quantiles
from tablescope.functions.running import running_sums
from tablescope.operators.transform import small_join

# A target with at most this many values is a class label; smallest MAPE divisor.
CLASS_VALUES = 20
TINY = 2.220446049250313e-16


def detect_task(df: DataFrame, target: str) -> DataFrame:
    """Classification for text and for few distinct values, else regression."""
    distinct = F.count_distinct(col(target))
    is_text = F.lit(target in text_columns(df))
    return df.agg(F.lit(target).alias("target"), distinct.alias("distinct_values"),
                  F.when(is_text | (distinct <= CLASS_VALUES), "classification").otherwise("regression").alias("task"))


def assign_parts(df: DataFrame, cuts: Sequence[float], key: Sequence[str], strata: str | None = None,
                 out: str = "part") -> DataFrame:
    """Number the rows 0..len(cuts) by the quantile of their key hash, inside each stratum.

    The cut values are exact order statistics per stratum, so every part has its share of every
    class to within one row, whatever the partitioning, and no class passes through one task.
    """
    keys = [col(k) for k in key]
    hashed = df.withColumn("_h", F.xxhash64(*keys).cast("double"))
    stratum = col(strata) if strata else F.lit("all")
    hashed = hashed.withColumn("_stratum", stratum.cast("string"))
    found = checkpointed(grouped_quantiles(hashed, ["_stratum"], "_h", cuts).withColumnRenamed("_stratum", "_s"))
    joined = small_join(hashed, found, F.col("_stratum").eqNullSafe(F.col("_s")))
    part = F.size(F.filter("q", lambda c: c < F.col("_h")))
    return joined.withColumn(out, part).drop("_h", "_stratum", "_s", "q")


def split_flag(df: DataFrame, target: str, test_size: float = 0.2, key: Sequence[str] = (),
               stratify: bool = True) -> DataFrame:
    """Add ``is_test``; stratified by the target's labels if wanted."""
    parted = assign_parts(df, [test_size], list(key) or df.columns, target if stratify else None, "_part")
    return parted.withColumn("is_test", F.col("_part") == 0).drop("_part")


def train_test_split(df: DataFrame, target: str, test_size: float = 0.2, key: Sequence[str] = (),
                     stratify: bool = True) -> tuple[DataFrame, DataFrame]:
    flagged = split_flag(df, target, test_size, key, stratify)
    return flagged.where(~F.col("is_test")).drop("is_test"), flagged.where("is_test").drop("is_test")


def with_folds(df: DataFrame, k: int = 5, key: Sequence[str] = (), strata: str | None = None) -> DataFrame:
    return assign_parts(df, [i / k for i in range(1, k)], list(key) or df.columns, strata, "fold")


# --- scores --------------------------------------------------------------------------------


def confusion_matrix(preds: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return preds.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(F.count("*").alias("count"))


def class_report(preds: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class; a zero division counts as 0."""
    cells = confusion_matrix(preds, label, prediction)
    per = cells.select(F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.col("count").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0).alias("hits")),
        F.struct(F.col("prediction").cast(cells.schema["label"].dataType).alias("class"), F.lit(0).cast("bigint").alias("support"),
                 F.col("count").alias("predicted"), F.lit(0).cast("bigint").alias("hits")))))
    per = per.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    p = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    r = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    return per.select("class", p.alias("precision"), r.alias("recall"),
                      F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support", "hits")


def classification_metrics(preds: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 as ``(metric, value)``."""
    rep = class_report(preds, label, prediction)
    n = F.sum("support")
    row = rep.agg(
        F.try_divide(F.sum("hits"), n).alias("accuracy"),
        *[F.try_divide(F.sum(F.col(m) * F.col("support")), n).alias(f"{m}_weighted") for m in ("precision", "recall", "f1")])
    return inline_rows(row, [{"metric": F.lit(c), "value": F.col(c)} for c in row.columns])


def roc_auc(preds: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact area under the ROC curve of a 0/1 label, ties counted half."""
    by_score = preds.groupBy(as_double(score).alias("score")).agg(
        F.count_if(as_double(label) == 1).alias("pos"), F.count_if(as_double(label) != 1).alias("neg"))
    run = running_sums(by_score, "score", ["neg"], ["below"])
    wins = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2))
    return run.agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def regression_metrics(preds: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """MSE, RMSE, MAE, R² and MAPE from one pass."""
    y, p = as_double(label), as_double(prediction)
    mean = preds.agg(F.avg(y)).scalar()
    row = preds.withColumn("_m", mean).agg(
        F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"),
        F.avg((y - F.col("_m")) * (y - F.col("_m"))).alias("var"),
        F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(TINY))).alias("mape"))
    row = row.withColumn("rmse", F.sqrt("mse")).withColumn("r2", 1 - F.try_divide("mse", "var"))
    return inline_rows(row, [{"metric": F.lit(c), "value": F.col(c)} for c in ("mse", "rmse", "mae", "r2", "mape")])


def feature_columns(df: DataFrame, target: str, features: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric and text feature columns."""
    chosen = [c for c in (features or df.columns) if c != target]
    unknown = [c for c in chosen if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown features: {', '.join(unknown)}")
    return [c for c in chosen if c in numeric_columns(df)], [c for c in chosen if c in text_columns(df)]
