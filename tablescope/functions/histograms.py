"""Binned feature tables and their histograms: what tree learners read instead of rows.

Features are cut once at quantiles into at most 256 bins; rows with equal bins and label are merged with a weight. A pass over that
table adds up one array per slot (a node, a tree, a class) in each task; the arrays are summed on the executors, and only
the sums, whose size does not depend on the rows, come to the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.checkpoints import discard, stored

BINS = 256
TASK_ROWS = 1 << 13       # rows of a small binned table that are worth a task
HELD_ROWS = 1 << 22       # rows up to which a binned table is also kept in memory
FEW_TASKS = 16            # tasks whose sums the driver adds up itself
HERE_ROWS = 200_000       # rows of a binned table up to which one task does all passes
HERE_BATCH = 1 << 14      # rows of a batch there
TALLIES = "slot int, sums binary"


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The rows of a batch of equally long lists of doubles."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), width)


def lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists of doubles."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows, np.float64).ravel()))


def packed(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix."""
    data = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(data.itemsize * data.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def unpacked(cells: pa.Array, width: int, kind: type) -> np.ndarray:
    """The matrix whose rows are equally long cells without nulls."""
    if not len(cells):
        return np.zeros((0, width), kind)
    sort = np.int64 if pa.types.is_large_binary(cells.type) else np.int32
    ends = np.frombuffer(cells.buffers()[1], sort)[cells.offset:cells.offset + len(cells) + 1]
    data = cells.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])) if ends[-1] > ends[0] else b""
    return np.frombuffer(data, kind).reshape(len(cells), width)


def feature_cuts(df: DataFrame, features: str = "features", bins: int = BINS) -> list[np.ndarray]:
    """Rising cuts per feature: the least value and quantiles. A value is in bin b if b cuts are below it."""
    rows = df.select(vector_to_array(features).alias("x"))
    first = rows.first()
    if first is None:
        return []
    shares = [i / (bins - 1) for i in range(1, bins - 1)]
    found = rows.agg(*[f for i in range(len(first.x)) for f in (
        F.percentile_approx(F.get("x", F.lit(i)), shares, 10_000), F.min(F.get("x", F.lit(i))))]).first()
    return [np.unique([*found[2 * i], found[2 * i + 1]]) for i in range(len(first.x))]


def bin_numbers(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8, order="F")
    for f, c in enumerate(cuts):
        out[:, f] = np.searchsorted(c, x[:, f], "left")
    return out


def starts(cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Place of each feature's first bin in a flat histogram; the last value is the length."""
    return np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])]).astype(np.int64)


def binned(df: DataFrame, cuts: Sequence[np.ndarray], mean_label: bool = False) -> DataFrame:
    """x (one byte per feature), label and w, the number of rows that agree in both; or that agree in x, with their mean label.

    The mean label is all that sums of weights and of labels over nodes need.
    """
    rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
    width = len(cuts)

    def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in table:
            found = bin_numbers(matrix(b.column("x"), width), cuts)
            yield pa.RecordBatch.from_arrays([packed(found), b.column("label")], ["x", "label"])

    made, weight = rows.mapInArrow(run, "x binary, label double"), F.count("*").cast("double").alias("w")
    return made.groupBy("x").agg(F.avg("label").alias("label"), weight) if mean_label else made.groupBy("x", "label").agg(weight)


class Binned:
    """A written table that many short passes read. A small one is kept in memory, in as many parts as its rows are worth, or as run side by side."""

    near = False              # what a step makes is written

    def __init__(self, table: DataFrame):
        self.rows, self.path = stored(table)
        self.count = self.rows.count()
        self.tasks = min(max(1, -(-self.count // TASK_ROWS)), max(FEW_TASKS, table.sparkSession.sparkContext.defaultParallelism))
        self.held = self.count <= HELD_ROWS
        if self.held:
            self.rows = self.rows.repartition(self.tasks).persist(StorageLevel.MEMORY_AND_DISK)

    def tallied(self, tally: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
        return tallied(self.rows, tally, few=self.held and self.tasks <= FEW_TASKS)

    def replaced(self, table: DataFrame) -> Binned:
        """What ``table``, made from this one, holds; this one is dropped."""
        after = Binned(table)
        self.drop()
        return after

    def stepped(self, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> Binned:
        """The table that ``step`` makes of this one, which is dropped."""
        return self.replaced(self.rows.mapInArrow(step, schema))

    def worked(self, work: Callable[[Binned | Here], Any]) -> Any:
        """What ``work`` makes of this table, which it drops: plain values and arrays. One with few rows is worked on in a task of its own."""
        if self.count > HERE_ROWS:
            return work(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(work(Here(batches)))], pa.binary())], ["made"])

        made = pickle.loads(self.rows.coalesce(1).mapInArrow(run, "made binary").first()["made"])
        self.drop()
        return made

    def drop(self) -> None:
        if self.held:
            self.rows.unpersist()
        discard(self.rows.sparkSession, self.path)


class Here:
    """A binned table in the memory of one task."""

    near = True

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        whole = [b for b in batches if b.num_rows]
        self.batches = pa.Table.from_batches(whole).combine_chunks().to_batches(HERE_BATCH) if whole else []

    def tallied(self, tally: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
        return summed(part for b in self.batches for part in tally(b))

    def stepped(self, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> Here:
        self.batches = list(step(iter(self.batches)))
        return self

    def drop(self) -> None:
        self.batches = []


def bin_matrix(cells: pa.Array, width: int) -> np.ndarray:
    return np.asfortranarray(unpacked(cells, width, np.uint8))


def merged(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``rows`` rows, but for the last."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        kept.append(b)
        if sum(k.num_rows for k in kept) >= rows:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
            kept = []
    if kept:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


def summed(parts: Iterator[tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The sum of the arrays of a slot; slots below zero take the largest instead."""
    held: dict[int, np.ndarray] = {}
    for slot, sums in parts:
        held[slot] = sums if slot not in held else held[slot] + sums if slot >= 0 else np.maximum(held[slot], sums)
    return held


def tallied(table: DataFrame, tally: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]], rows: int = 1, few: bool = False) -> dict[int, np.ndarray]:
    """Sum over all batches of the arrays that ``tally`` gives per slot, as :func:`summed`.

    Where arrays are large beside a batch, ``rows`` of several batches are tallied at once. The sums of ``few`` tasks are added up
    by the driver, without a shuffle.
    """
    def joined(parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held = summed(parts)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())],
                                         ["slot", "sums"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return joined(part for b in merged(batches, rows) if b.num_rows for part in tally(b))

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return joined((s, np.frombuffer(v, np.float64)) for b in batches
                      for s, v in zip(b.column("slot").to_pylist(), b.column("sums").to_pylist()))

    made = table.mapInArrow(near, TALLIES)
    found = (made if few else made.repartition("slot").mapInArrow(far, TALLIES)).toArrow()
    if few:
        found = pa.Table.from_batches(far(found.to_batches()))
    return {s: np.frombuffer(v, np.float64) for s, v in zip(found.column("slot").to_pylist(), found.column("sums").to_pylist())}
