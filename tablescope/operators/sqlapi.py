"""SQL over registered DataFrames and the ready-made query shapes."""

from __future__ import annotations

import time
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.columns import col, numeric_columns


def reads_only(spark: SparkSession, query: str) -> bool:
    """Whether the parsed statement is a query: its plan holds no command and no write at any depth."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    names = [plan.nodeName()] + [line.lstrip("+-:* '").split(" ")[0] for line in plan.treeString().splitlines()]
    writes = ("Insert", "Create", "Drop", "Alter", "Delete", "Update", "Merge", "Truncate", "Set", "Reset", "Add", "Load", "Cache",
              "Uncache", "Clear", "Refresh", "Replace", "Overwrite", "Append", "Rename", "Unresolved3PartName")
    return not any(n.startswith(writes) and not n.startswith("SetOperation") for n in names) and not any(
        n.endswith(("Command", "Statement")) for n in names)


def sql_query(spark: SparkSession, query: str, views: Mapping[str, DataFrame],
              args: Mapping[str, Any] | None = None) -> DataFrame:
    """Run a query over named DataFrames. The views exist for this call only; the result is a
    lazy DataFrame, so filters and column choice reach the file scan."""
    if not reads_only(spark, query):
        raise ValueError("only queries that read are allowed")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(query, args=dict(args) if args else None)
    finally:
        for name in views:
            spark.catalog.dropTempView(name)


def timed_query(spark: SparkSession, query: str, views: Mapping[str, DataFrame], out: str) -> DataFrame:
    """Run a query into a Parquet folder; returns rows, columns and elapsed seconds."""
    start = time.perf_counter()
    result = sql_query(spark, query, views)
    result.write.mode("overwrite").parquet(out)
    rows = spark.read.parquet(out).count()
    return spark.createDataFrame(
        [(rows, result.columns, time.perf_counter() - start)],
        "row_count long, columns array<string>, elapsed_seconds double")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_select_all(df: DataFrame) -> DataFrame:
    return sql_query(df.sparkSession, "SELECT * FROM df", {"df": df})


def sql_count(df: DataFrame) -> DataFrame:
    return sql_query(df.sparkSession, "SELECT count(*) AS total_rows FROM df", {"df": df})


def sql_group_by(df: DataFrame, name: str) -> DataFrame:
    c = _quoted(name)
    return sql_query(df.sparkSession, f"SELECT {c}, count(*) AS count FROM df GROUP BY {c} ORDER BY count DESC, {c}",
                     {"df": df})


def sql_filter(df: DataFrame, name: str, value: Any) -> DataFrame:
    return sql_query(df.sparkSession, f"SELECT * FROM df WHERE {_quoted(name)} = :value", {"df": df}, {"value": value})


def sql_top_n(df: DataFrame, name: str, n: int, key: str) -> DataFrame:
    return sql_query(df.sparkSession, f"SELECT * FROM df ORDER BY {_quoted(name)} DESC, {_quoted(key)} LIMIT :n",
                     {"df": df}, {"n": n})


def sql_distinct(df: DataFrame, name: str) -> DataFrame:
    return sql_query(df.sparkSession, f"SELECT DISTINCT {_quoted(name)} FROM df", {"df": df})


def sql_result_scatter(result: DataFrame) -> DataFrame:
    """The first two numeric columns of a result as points."""
    x, y = numeric_columns(result)[:2]
    return result.select(col(x).cast("double").alias("x"), col(y).cast("double").alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull())
