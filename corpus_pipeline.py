"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing to target weights, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, told apart by a number of their own, so repeated
rows, null ids and extra columns are carried like any others. All stages but the last return the columns of ``docs``.
The mix takes a document up to three times; its copies are rows of their own. SQL can't express alignment or balanced sampling,
so there is no twin; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm.common import discard, numbered_in_place, scratch, shared_folder, write
from tablescope.llm.decontamination import contaminated
from tablescope.llm.mixing import mix_sources
from tablescope.llm.quality_rules import quality_rules
from tablescope.llm.sharding import shard_records
from tablescope.llm.simhash import near_duplicates

ORACLE_SQL = None
SHARDS = 24


def _only(docs: DataFrame, row: str, chosen: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose number is (or, left_anti, isn't) in ``chosen``; the numbers are hashed, the texts not sorted."""
    return docs.join(chosen.select(row).hint("shuffle_hash"), row, how).drop(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    rows, row = numbered_in_place(docs)
    return _only(rows, row, quality_rules(rows, key=row, row=row).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the first row."""
    rows, row = numbered_in_place(docs)
    return _only(rows, row, near_duplicates(rows, key=row).where(F.col(row) == F.col("component_id")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    rows, row = numbered_in_place(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _only(rows, row, contaminated(rows, items, key=row, item_key="item_id"), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    rows, row = numbered_in_place(docs)
    taken = mix_sources(rows, key=row).where("copies > 0").select(row, F.col("copies").alias(f"{row}_copies"))
    return (rows.join(taken.hint("shuffle_hash"), row)
            .withColumn(f"{row}_copies", F.explode(F.sequence(F.lit(1), F.col(f"{row}_copies").cast("int"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it."""
    rows, row = numbered_in_place(docs)
    return shard_records(rows, SHARDS, carry=True, row=row)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontamination),
          ("mixing", mixing), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name.replace(" ", "-"))
        with scratch(spark):
            docs = write(stage(spark, docs, sf_dir), path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
