"""Datasets and their versions as Parquet folders with two small metadata tables.

Layout under ``root``: ``data/<dataset_id>``, ``versions/<name>/<version_id>`` and the tables
``_datasets`` and ``_versions``. Versions are keyed by the stable dataset name, so undo works
after any number of changes. The current state of a name is its latest dataset; ``_undone`` lists
the versions that an undo has already brought back.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.checkpoints import ensure_checkpoint_dir
from tablescope.functions.columns import (
    col, nan_to_null,
)
from tablescope.operators.aggregate import duplicate_count, null_counts

DATASETS = ("dataset_id string, name string, rows long, n_columns int, columns array<string>, "
            "created_at timestamp")
VERSIONS = ("version_id string, name string, note string, rows long, n_columns int, "
            "created_at timestamp, seq long")
UNDONE = "version_id string, name string"


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


def _now() -> datetime:
    return datetime.now(timezone.utc)


def _append(spark: SparkSession, path: str, schema: str, row: tuple) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def write_dataset(df: DataFrame, root: str, name: str) -> str:
    spark, dataset_id = df.sparkSession, uuid.uuid4().hex
    path = f"{root}/data/{dataset_id}"
    df.write.parquet(path)
    rows = spark.read.parquet(path).count()  # answered from file footers
    _append(spark, f"{root}/_datasets", DATASETS,
            (dataset_id, name, rows, len(df.columns), df.columns, _now()))
    return dataset_id


def read_dataset(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    return spark.read.parquet(f"{root}/data/{dataset_id}")


def list_datasets(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(DATASETS).parquet(f"{root}/_datasets")


def save_version(df: DataFrame, root: str, name: str, note: str) -> str:
    """Snapshot a dataset before a change."""
    spark, version_id = df.sparkSession, uuid.uuid4().hex
    path = f"{root}/versions/{name}/{version_id}"
    df.write.parquet(path)
    rows = spark.read.parquet(path).count()
    now = _now()
    _append(spark, f"{root}/_versions", VERSIONS,
            (version_id, name, note, rows, len(df.columns), now, int(now.timestamp() * 1e6)))
    return version_id


def version_history(spark: SparkSession, root: str, name: str) -> DataFrame:
    log = spark.read.schema(VERSIONS).parquet(f"{root}/_versions")
    return log.where(F.col("name") == name).orderBy("seq").drop("seq")


def restore_version(spark: SparkSession, root: str, name: str, version_id: str) -> DataFrame:
    return spark.read.parquet(f"{root}/versions/{name}/{version_id}")


def current_dataset(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The latest dataset written under a name."""
    found = list_datasets(spark, root).where(F.col("name") == name).agg(F.max_by("dataset_id", "created_at")).first()[0]
    if found is None:
        raise ValueError(f"no dataset {name!r}")
    return read_dataset(spark, root, found)


def undo(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Make the latest snapshot that has not been brought back yet the current dataset; a second undo goes one further."""
    log = spark.read.schema(VERSIONS).parquet(f"{root}/_versions").where(F.col("name") == name)
    used = f"{root}/_undone"
    _append(spark, used, UNDONE, ("", name))  # the table exists from here on
    done = spark.read.schema(UNDONE).parquet(used).where(F.col("name") == name).select("version_id")
    latest = log.join(done, "version_id", "left_anti").agg(F.max_by("version_id", "seq")).first()[0]
    if latest is None:
        raise ValueError(f"no versions of {name!r} left")
    write_dataset(restore_version(spark, root, name, latest), root, name)
    _append(spark, used, UNDONE, (latest, name))
    return current_dataset(spark, root, name)


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """Hash of schema and all rows, the same for any row order or partitioning."""
    fields = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    row = F.xxhash64(*[col(n) for n, _ in fields])
    return df.select(row.alias("h")).agg(
        F.count("*").alias("rows"), F.lit(len(fields)).alias("n_columns"),
        F.sha2(F.concat_ws("|", F.lit(str(fields)), F.count("*"),
                           F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")), 256).alias("fingerprint"))


def dataset_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed between two states of a table as ``(item, metric, before, after, delta)``."""
    def summary(df: DataFrame, tag: str) -> DataFrame:
        missing = null_counts(df).agg(F.sum("nulls")).scalar()
        return duplicate_count(nan_to_null(df)).select(
            F.lit("table").alias("item"), F.inline(F.array(*[
                F.struct(F.lit(m).alias("metric"), v.cast("double").alias(tag)) for m, v in (
                    ("rows", F.col("rows")), ("columns", F.lit(len(df.columns))),
                    ("missing_cells", missing), ("duplicate_rows", F.col("duplicates")))])))

    def columns(df: DataFrame, tag: str) -> DataFrame:
        pcts = null_counts(df).select(
            F.col("column").alias("item"), F.lit("missing_pct").alias("metric"),
            F.round("null_pct", 2).alias(tag))
        present = pcts.select("item", F.lit("present").alias("metric"), F.lit(1.0).alias(tag))
        return pcts.unionByName(present)

    table = summary(before, "before").join(summary(after, "after"), ["item", "metric"])
    cells = columns(before, "before").join(columns(after, "after"), ["item", "metric"], "full")
    common = [c for c in before.columns if c in after.columns]
    pct_rows = cells.where(
        (F.col("metric") == "missing_pct") & F.col("item").isin(*common or [""])
        & ((F.col("before") > 0) | (F.col("after") > 0)))
    moved = cells.where("metric = 'present' and (before is null or after is null)").select(
        "item", F.when(F.col("before").isNull(), "added column").otherwise("removed column").alias("metric"),
        F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after"))
    types = {f.name: f.dataType.simpleString() for f in before.schema.fields}
    retyped = [f.name for f in after.schema.fields if f.name in types and types[f.name] != f.dataType.simpleString()]
    out = table.unionByName(pct_rows).unionByName(moved)
    if retyped:
        out = out.unionByName(cells.where(
            (F.col("metric") == "present") & F.col("item").isin(*retyped)).withColumn("metric", F.lit("changed type")))
    return out.withColumn("delta", F.col("after") - F.col("before"))
