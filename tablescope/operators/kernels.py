"""Random Fourier features: a linear machine on them is a machine with an RBF kernel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.histograms import lists, matrix
from tablescope.operators.boosting import JsonReader, JsonWriter

WAVES = 256               # features made; the kernel's error falls with the root of their number
MANY_ROWS = 100_000       # rows beyond which equal vectors are sought before waves are made
REPEATS = 4               # rows per distinct vector that make it worth it


def kernel_width(df: DataFrame, features: str = "features") -> tuple[float, int]:
    """One over the number of features times the variance of all their values, and the number of features."""
    value = F.explode(vector_to_array(features))
    size = df.select(F.size(vector_to_array(features)).alias("n")).first()
    spread = df.select(value.alias("v")).agg(F.var_pop("v")).first()[0]
    n = size["n"] if size else 0
    return 1.0 / (max(n, 1) * (spread or 1.0)), n


def merged_width(merged: DataFrame) -> tuple[float, int]:
    """:func:`kernel_width` of the rows that distinct vectors ``x`` stand for, ``w`` each."""
    values = merged.select("w", F.size("x").alias("n"), F.explode("x").alias("v"))
    n, mean = values.agg(F.max("n"), F.sum(F.col("w") * F.col("v")) / F.sum("w")).first()
    away = F.col("v") - F.lit(mean)
    spread = values.agg(F.sum(F.col("w") * away * away) / F.sum("w")).first()[0]
    return 1.0 / (max(n, 1) * (spread or 1.0)), n


class KernelMap(Estimator):
    """Fits the kernel's width and draws the waves; the model maps ``features`` to ``mapped``."""

    def __init__(self, waves: int = WAVES, seed: int = 42):
        super().__init__()
        self.waves, self.seed = waves, seed

    def _fit(self, dataset: DataFrame) -> KernelMapModel:
        gamma, size = kernel_width(dataset)
        return KernelMapModel(gamma, size, self.waves, self.seed)


class KernelMapModel(Model, MLWritable, MLReadable):
    """sqrt(2 / waves) * cos(x W + b), W normal of variance 2 gamma, b uniform; inner products come near exp(-gamma |x - y|^2)."""

    def __init__(self, gamma: float, size: int, waves: int, seed: int):
        super().__init__()
        self.gamma, self.size, self.waves, self.seed = gamma, size, waves, seed

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rng, size, scale = np.random.default_rng(self.seed), self.size, np.sqrt(2.0 / self.waves)
        turns = rng.normal(0.0, np.sqrt(2 * self.gamma), (size, self.waves))
        shift = rng.uniform(0, 2 * np.pi, self.waves)

        @F.arrow_udf("array<double>")
        def waves(x: pa.Array) -> pa.Array:
            return lists(scale * np.cos(matrix(x, size) @ turns + shift))

        return dataset.withColumn("mapped", array_to_vector(waves(vector_to_array("features"))))

    def line(self, dataset: DataFrame, slopes: np.ndarray, intercept: float) -> DataFrame:
        """``dataset`` with the prediction of a linear model on the waves, which are made and summed up batch by batch."""
        rng, size, scale = np.random.default_rng(self.seed), self.size, np.sqrt(2.0 / self.waves)
        turns = rng.normal(0.0, np.sqrt(2 * self.gamma), (size, self.waves))
        shift = rng.uniform(0, 2 * np.pi, self.waves)

        @F.arrow_udf("double")
        def said(x: pa.Array) -> pa.Array:
            return pa.array(scale * np.cos(matrix(x, size) @ turns + shift) @ slopes + intercept)

        return dataset.withColumn("prediction", said(vector_to_array("features")))

    def write(self) -> MLWriter:
        return JsonWriter(self, {"gamma": self.gamma, "size": self.size, "waves": self.waves, "seed": self.seed})

    @classmethod
    def read(cls) -> MLReader:
        return JsonReader(cls, lambda m: cls(m["gamma"], m["size"], m["waves"], m["seed"]))


class KernelSquares(Estimator):
    """Least squares on the waves of ``features``, with a penalty of one over ``rows``.

    Equal vectors have equal waves, so that many rows of few vectors are fitted as weighted vectors with their mean labels: the sums of squares
    differ by a constant.
    """

    def __init__(self, rows: int, label_std: float):
        super().__init__()
        self.rows, self.label_std = rows, label_std

    def _linear(self, label_std: float, **options) -> LinearRegression:
        return LinearRegression(solver="normal", regParam=label_std / self.rows, elasticNetParam=0.0, standardization=False,
                                featuresCol="mapped", labelCol="label", **options)

    def _fit(self, dataset: DataFrame) -> KernelSquaresModel:
        rows = dataset.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
        count, apart, std = rows.agg(F.count("label"), F.approx_count_distinct(F.xxhash64("x"), 0.02), F.stddev_pop("label")).first()
        if count <= MANY_ROWS or apart * REPEATS > count:
            waves = KernelMap().fit(dataset)
            return KernelSquaresModel.of(waves, self._linear(self.label_std).fit(waves.transform(dataset)))
        merged = rows.where("label IS NOT NULL").groupBy("x").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("w")).persist()
        try:
            waves = KernelMapModel(*merged_width(merged), KernelMap().waves, KernelMap().seed)
            mean = merged.agg(F.sum(F.col("w") * F.col("label")) / F.sum("w")).first()[0]
            away = F.col("label") - F.lit(mean)
            # the linear model divides its penalty by the deviation of the labels it is given
            spread = merged.agg(F.sqrt(F.sum(F.col("w") * away * away) / F.sum("w"))).first()[0]
            ready = waves.transform(merged.withColumn("features", array_to_vector("x")))
            return KernelSquaresModel.of(waves, self._linear(self.label_std * (spread or 1.0) / (std or 1.0), weightCol="w").fit(ready))
        finally:
            merged.unpersist()


class KernelSquaresModel(Model, MLWritable, MLReadable):
    def __init__(self, waves: KernelMapModel, slopes: np.ndarray, intercept: float):
        super().__init__()
        self.waves, self.slopes, self.intercept = waves, slopes, intercept

    @classmethod
    def of(cls, waves: KernelMapModel, line: LinearRegressionModel) -> KernelSquaresModel:
        return cls(waves, line.coefficients.toArray(), float(line.intercept))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.waves.line(dataset, self.slopes, self.intercept)

    def write(self) -> MLWriter:
        w = self.waves
        return JsonWriter(self, {"gamma": w.gamma, "size": w.size, "waves": w.waves, "seed": w.seed, "slopes": self.slopes.tolist(),
                                 "intercept": self.intercept})

    @classmethod
    def read(cls) -> MLReader:
        return JsonReader(cls, lambda m: cls(KernelMapModel(m["gamma"], m["size"], m["waves"], m["seed"]), np.array(m["slopes"]), m["intercept"]))
