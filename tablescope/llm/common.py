"""Steps the corpus operators share: words, stored intermediate tables, row keys."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.functions.checkpoints import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_MADE: ContextVar[list[str] | None] = ContextVar("folders made", default=None)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder path below the checkpoint folder, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end all shared folders named inside; what is kept must be written elsewhere by then."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        discard(spark, *made)


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs started inside are freed when each ends."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def write(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back; shuffle files of the job are freed when it ends."""
    spark = df.sparkSession
    with freeing(spark):
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: keep ``df`` as a table in the shared folder and read it from there."""
    return write(df, shared_folder(df.sparkSession, name))


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no later plan reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def fresh(taken: list[str], name: str) -> str:
    """``name``, lengthened until it clashes with none of ``taken`` (Spark ignores case)."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, path: str | None = None) -> tuple[DataFrame, str]:
    """``df`` with a column that tells its rows apart, repeated rows included.

    The numbers follow the order of a scan, which changes with the number of cores, so the rows are written with them once (to
    ``path``, or a new shared folder) and every later plan reads that table.
    """
    name = fresh(df.columns, "_row")
    return write(df.withColumn(name, F.monotonically_increasing_id()), path or shared_folder(df.sparkSession, "rows")), name


def numbered_in_place(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number per row that stays the same however they are read: part of the table and place in its file.

    ``docs`` is a table as read. Tables whose files have no part numbers of their own, and docs that are no table, are written with
    numbers first.
    """
    name = fresh(docs.columns, "_row")
    parts = [re.search(r"part-(\d+)(?:[^/]*-c(\d+))?[^/]*$", f) for f in docs.inputFiles()]
    known = [p and (int(p[1]), int(p[2] or 0)) for p in parts]
    if len(known) != 1 and (not known or None in known or len(set(known)) < len(known) or any(c for _, c in known)):
        return numbered(docs)
    part = F.lit(0) if len(known) == 1 else F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
    try:
        return docs.withColumn(name, F.shiftleft(part.cast("bigint"), 40) + F.col("_metadata.row_index")), name
    except AnalysisException:
        return numbered(docs)


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch in order, and the index of the text each belongs to. Null texts have none."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    owners = np.repeat(np.arange(len(lists), dtype=np.int64), pc.list_value_length(lists).to_numpy())
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(real), owners[real.to_numpy(zero_copy_only=False)]


def count_words(texts: pa.Array) -> np.ndarray:
    return np.bincount(split_words(texts, lower=False)[1], minlength=len(texts))


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 16 << 20, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text and at most ``rows`` rows; no row is cut."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy())
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = min(max(start + 1, int(np.searchsorted(ends, base + limit, "right"))), start + rows)
            yield batch.slice(start, stop - start)
            start = stop
