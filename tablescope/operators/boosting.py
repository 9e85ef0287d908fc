"""Boosted trees over binned features: AdaBoost (SAMME, R2) and gradient boosting (softmax, logistic, squares).

One pass over the binned table per tree level serves all classes at once. Weights and scores are functions of
the row and the stages so far; tasks work them out as they read, and every ``WRITES`` rounds they are written with the rows so
that the work per round stays bounded.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.histograms import Binned, Here, bin_matrix, bin_numbers, binned, feature_cuts, lists, matrix, starts

CLASSIFICATION, REGRESSION = "classification", "regression"
WRITES = 25               # rounds between two writes of weights or scores
TINY = 1e-12


@dataclass
class Tree:
    """A full tree of some depth: the children of node i are 2i + 1 and 2i + 2. A row goes right if its bin is above the cut's."""

    depth: int
    feature: np.ndarray = field(default=None)
    cut: np.ndarray = field(default=None)
    value: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.feature is None:
            self.feature = np.zeros((1 << self.depth) - 1, np.int64)
            self.cut = np.full((1 << self.depth) - 1, 255, np.int64)  # nothing is above it: all rows go left
            self.value = np.zeros(1 << self.depth)

    def facts(self) -> tuple:
        return self.depth, self.feature, self.cut, self.value

    def route(self, x: np.ndarray, levels: int) -> np.ndarray:
        """Number of each row's node within that level."""
        node, rows, flat = np.zeros(len(x), np.int64), np.arange(len(x)), x.ravel("F")
        for _ in range(levels):
            node = 2 * node + 1 + (flat.take(self.feature.take(node) * len(x) + rows) > self.cut.take(node))
        return node - ((1 << levels) - 1)

    @cached_property
    def tables(self) -> tuple[dict[int, np.ndarray], np.ndarray]:
        """For a finished tree of up to three levels: per feature the leaves that each bin leaves open, as bits, and the value of
        each bit. One leaf is open to all features."""
        bins, open_, values = np.arange(256), {}, np.zeros(256)
        for i, (f, cut) in enumerate(zip(self.feature.tolist(), self.cut.tolist())):
            level = (i + 1).bit_length() - 1
            half = 1 << (self.depth - level - 1)
            left = ((1 << half) - 1) << (i - ((1 << level) - 1)) * 2 * half
            kept = np.where(bins > cut, 255 & ~left, 255 & ~(left << half)).astype(np.uint8)
            open_[f] = open_[f] & kept if f in open_ else kept
        values[1 << np.arange(1 << self.depth)] = self.value
        return {f: t & np.uint8((1 << (1 << self.depth)) - 1) for f, t in open_.items()}, values

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not 1 <= self.depth <= 3:
            return self.value[self.route(x, self.depth)]
        open_, values = self.tables
        leaf = None
        for f, table in open_.items():
            found = table.take(x[:, f])
            leaf = found if leaf is None else leaf & found
        return values.take(leaf)


def cut_gains(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Gain of each cut in squared error, from (weight, weighted sum) to the left of it and in all."""
    wl, sl = left[0], left[1]
    wr, sr = total[0] - wl, total[1] - sl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = wl * wr / (wl + wr) * (sl / wl - sr / wr) ** 2
    return np.where((wl > TINY) & (wr > TINY), gain, -1.0)


def best_cut(hist: np.ndarray, first: np.ndarray, gains: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[int, int, float]:
    """Feature, bin and gain of the best cut of one node; hist is (sums, bins of all features). The first of equals."""
    found = (0, 255, TINY)
    for f in range(len(first) - 1):
        part = hist[:, first[f]:first[f + 1]]
        if part.shape[1] < 2:
            continue
        left = np.cumsum(part, axis=1)
        gain = gains(left[:, :-1], left[:, -1:])
        b = int(gain.argmax())
        if gain[b] > found[2] * (1 + TINY):
            found = (f, b, float(gain[b]))
    return found


Members = Callable[[pa.RecordBatch, np.ndarray], Iterator[tuple[int, np.ndarray, list[np.ndarray]]]]


def grown(table: Binned | Here, cuts: Sequence[np.ndarray], depth: int, slots: int, members: Members) -> tuple[list[Tree], list[np.ndarray], np.ndarray]:
    """A tree per slot, the sums in its leaves, and the gain per slot and feature.

    ``members`` gives, for a batch and its bins, (slot, weights, values): the tree fits values[0]; the others are only summed.
    """
    first, width = starts(cuts), len(cuts)
    size = int(first[-1])
    trees, leaves = [Tree(depth) for _ in range(slots)], [None] * slots
    importance = np.zeros((slots, width))
    for level in range(depth):
        def tally(b: pa.RecordBatch, level=level) -> Iterator[tuple[int, np.ndarray]]:
            x = bin_matrix(b.column("x"), width)
            for slot, weight, values in members(b, x):
                node = trees[slot].route(x, level) * size
                out = np.zeros((1 + len(values), size << level))
                weighted = [weight, *(weight * v for v in values)]
                for f in range(width):
                    place = node + (x[:, f] + first[f])
                    for i, v in enumerate(weighted):
                        out[i] += np.bincount(place, v, size << level)
                yield slot, out.ravel()

        for slot, flat in table.tallied(tally).items():
            hist = flat.reshape(-1, 1 << level, size)
            below = np.zeros((len(hist), 2 << level))
            for node in range(1 << level):
                f, b, gain = best_cut(hist[:, node], first, cut_gains)
                at = (1 << level) - 1 + node
                trees[slot].feature[at], trees[slot].cut[at] = f, b
                part = hist[:, node, first[f]:first[f + 1]]
                below[:, 2 * node] = part[:, :b + 1].sum(1)
                below[:, 2 * node + 1] = part[:, b + 1:].sum(1)
                importance[slot, f] += gain if b < 255 else 0
            leaves[slot] = below
    return trees, leaves, importance


# --- gradient boosting ---------------------------------------------------------------------


@dataclass
class Boosted:
    """Trees by round and class over the bins of ``cuts``, and what they add to."""

    task: str
    cuts: list[np.ndarray]
    start: np.ndarray
    trees: list[list[Tree]]
    rate: float
    importance: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = bin_numbers(x, self.cuts)
        out = np.tile(self.start, (len(x), 1))
        for stage in self.trees:
            for k, tree in enumerate(stage):
                out[:, k] += self.rate * tree.scores(bins)
        return out

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities, or the number."""
        raw = self.raw(x)
        return raw if self.task == REGRESSION else shares(raw)

    def as_dict(self) -> dict:
        return {"task": self.task, "cuts": [c.tolist() for c in self.cuts], "start": self.start.tolist(), "rate": self.rate,
                "importance": self.importance.tolist(),
                "trees": [[[t.depth, t.feature.tolist(), t.cut.tolist(), t.value.tolist()] for t in s] for s in self.trees]}

    @staticmethod
    def from_dict(d: dict) -> Boosted:
        trees = [[Tree(t[0], *map(np.array, t[1:])) for t in s] for s in d["trees"]]
        return Boosted(d["task"], [np.array(c) for c in d["cuts"]], np.array(d["start"]), trees, d["rate"], np.array(d["importance"]))


def shares(raw: np.ndarray) -> np.ndarray:
    if raw.shape[1] == 1:
        p = 1 / (1 + np.exp(-np.clip(raw[:, 0], -700, 700)))
        return np.stack([1 - p, p], 1)
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_boosted(df: DataFrame, task: str, classes: int = 2, rounds: int = 100, rate: float = 0.1, depth: int = 3) -> Boosted:
    """Gradient boosting on ``features`` and ``label``. Classes are fitted together: the residuals of all their probabilities are
    grown in the same passes."""
    cuts = feature_cuts(df)
    # squares need only the sum of the labels of equal rows
    table = Binned(binned(df, cuts, mean_label=task == REGRESSION))
    facts = table.rows.groupBy("label" if task == CLASSIFICATION else F.lit(0.0).alias("label")).agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("label")).alias("s")).collect()  # one row per class
    total = sum(r["w"] for r in facts) or 1.0
    if task == CLASSIFICATION:
        classes = max([2, classes, *(int(r["label"]) + 1 for r in facts)])
    outs = 1 if task == REGRESSION or classes <= 2 else classes
    if task == REGRESSION:
        start = np.array([sum(r["s"] for r in facts) / total])
    else:
        part = np.array([sum(r["w"] for r in facts if r["label"] == c) for c in range(classes)]) / total
        part = np.clip(part, 1e-15, 1.0)
        start = np.log(part) if outs > 1 else np.array([math.log(part[1] / part[0])])
    facts, importance = table.worked(lambda held: _boosted(held, task, outs, start, cuts, rounds, rate, depth))
    stages = [[Tree(*t) for t in stage] for stage in facts]
    return Boosted(task, list(cuts), start, stages, rate, importance / (importance.sum() or 1.0))


def _boosted(table: Binned | Here, task: str, outs: int, start: np.ndarray, cuts: Sequence[np.ndarray], rounds: int, rate: float,
             depth: int) -> tuple[list[list[tuple]], np.ndarray]:
    """The facts of the trees by round and class, and what each feature gained; ``table`` is dropped."""
    stages: list[list[Tree]] = []
    fresh: list[list[Tree]] = []   # the stages since the last write
    importance, writes = np.zeros(len(cuts)), 1 if table.near else WRITES

    def raw_scores(b: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
        out = matrix(b.column("raw"), outs).copy() if "raw" in b.schema.names else np.tile(start, (len(x), 1))
        for stage in fresh:
            for k, tree in enumerate(stage):
                out[:, k] += rate * tree.scores(x)
        return out

    def members(b: pa.RecordBatch, x: np.ndarray):
        raw, label, w = raw_scores(b, x), b.column("label").to_numpy(), b.column("w").to_numpy()
        if task == REGRESSION:
            yield 0, w, [label - raw[:, 0]]
            return
        p = shares(raw)
        for k in range(outs):
            c = k if outs > 1 else 1
            gap = (label == c) - p[:, c]
            yield k, w, [gap, np.abs(gap) * (1 - np.abs(gap))]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = raw_scores(b, bin_matrix(b.column("x"), len(cuts)))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("x", "label", "w")), lists(raw)],
                                             ["x", "label", "w", "raw"])

    for r in range(rounds):
        trees, leaves, gains = grown(table, cuts, depth, outs, members)
        for tree, sums in zip(trees, leaves):
            if sums is not None:
                over = sums[2] if task == CLASSIFICATION else sums[0]
                scale = (outs - 1) / outs if outs > 1 else 1.0
                tree.value = np.where(over > 1e-150, scale * sums[1] / np.maximum(over, 1e-150), 0.0)
        fresh.append(trees)
        stages.append(trees)
        importance += gains.sum(0)
        if (r + 1) % writes == 0 and r + 1 < rounds:
            table = table.stepped(scored, "x binary, label double, w double, raw array<double>")
            fresh = []
    table.drop()
    return [[t.facts() for t in stage] for stage in stages], importance


def with_outputs(df: DataFrame, outputs: Callable[[np.ndarray], np.ndarray], task: str, width: int) -> DataFrame:
    """``df`` with prediction and, for classes, probability, from what ``outputs`` gives for a matrix of features."""
    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        return lists(outputs(matrix(x, width)))

    made = df.withColumn("_out", run(vector_to_array("features")))
    if task == REGRESSION:
        return made.withColumn("prediction", F.get("_out", F.lit(0))).drop("_out")
    return (made.withColumn("probability", array_to_vector("_out"))
            .withColumn("prediction", (F.array_position("_out", F.array_max("_out")) - 1).cast("double")).drop("_out"))


class BoostedTrees(Estimator):
    """Gradient boosting as a pipeline stage."""

    def __init__(self, task: str, classes: int = 2, rounds: int = 100, depth: int = 3):
        super().__init__()
        self.task, self.classes, self.rounds, self.depth = task, classes, rounds, depth

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        return BoostedTreesModel(fit_boosted(dataset.select("features", "label"), self.task, self.classes, self.rounds, depth=self.depth))


class BoostedTreesModel(Model, MLWritable, MLReadable):
    def __init__(self, fitted: Boosted):
        super().__init__()
        self.fitted = fitted

    @property
    def featureImportances(self) -> Weights:  # noqa: N802
        return Weights(self.fitted.importance)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return with_outputs(dataset, self.fitted.outputs, self.fitted.task, len(self.fitted.cuts))

    def write(self) -> MLWriter:
        return JsonWriter(self, {"fitted": self.fitted.as_dict()})

    @classmethod
    def read(cls) -> MLReader:
        return JsonReader(cls, lambda meta: cls(Boosted.from_dict(meta["fitted"])))


class Weights:
    """Feature weights with the accessor that model users expect."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def toArray(self) -> np.ndarray:  # noqa: N802
        return self.values


class JsonWriter(MLWriter):
    """Saves a model whose facts fit its metadata."""

    def __init__(self, instance, facts: dict):
        super().__init__()
        self.instance, self.facts = instance, facts

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata=self.facts)


class JsonReader(MLReader):
    def __init__(self, cls, build):
        super().__init__()
        self.cls, self.build = cls, build

    def load(self, path: str):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        made = self.build(meta)
        made._resetUid(meta["uid"])
        return made


# --- AdaBoost ------------------------------------------------------------------------------


@dataclass
class Stage:
    """A tree with its say; ``shift`` keeps the weights' mean at one, ``top`` is the largest error (numbers only)."""

    tree: Tree
    alpha: float
    shift: float = 0.0
    top: float = 1.0


@dataclass
class AdaBoost:
    task: str
    classes: int
    cuts: list[np.ndarray]
    stages: list[Stage]

    def __len__(self) -> int:
        return len(self.stages)

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """Share of the votes per class, or the weighted median."""
        bins = bin_numbers(x, self.cuts)
        alphas = np.array([s.alpha for s in self.stages])
        said = np.stack([s.tree.scores(bins) for s in self.stages], 1)
        if self.task == CLASSIFICATION:
            votes = np.stack([((said == c) * alphas).sum(1) for c in range(self.classes)], 1)
            return votes / alphas.sum()
        order = np.argsort(said, 1, kind="stable")
        seen = np.cumsum(alphas[order], 1)
        at = (seen >= 0.5 * alphas.sum() - TINY).argmax(1)
        return np.take_along_axis(said, np.take_along_axis(order, at[:, None], 1), 1)


def fit_adaboost(df: DataFrame, task: str = CLASSIFICATION, rounds: int = 100) -> AdaBoost:
    """SAMME with stumps for classes, R2 with trees of three levels for numbers, on ``features`` and ``label``."""
    cuts = feature_cuts(df)
    table = Binned(binned(df, cuts).withColumn("log_weight", F.lit(0.0)))
    classes = int(table.rows.agg(F.max("label")).first()[0] or 0) + 1 if task == CLASSIFICATION else 0
    facts = table.worked(lambda held: _adaboost(held, task, classes, cuts, rounds))
    return AdaBoost(task, classes, list(cuts), [Stage(Tree(*t), *rest) for t, *rest in facts])


def _adaboost(table: Binned | Here, task: str, classes: int, cuts: Sequence[np.ndarray], rounds: int) -> list[tuple]:
    """The facts of the stages; ``table`` is dropped."""
    first, width, stages, done = starts(cuts), len(cuts), [], []
    size, writes = int(first[-1]), 1 if table.near else WRITES

    def log_weights(b: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
        out, label = b.column("log_weight").to_numpy().copy(), b.column("label").to_numpy()
        for s in done:
            said = s.tree.scores(x)
            out += (s.alpha * (said != label) if task == CLASSIFICATION else s.alpha * (np.abs(said - label) / s.top - 1)) - s.shift
        return out

    def weights(b: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
        return b.column("w").to_numpy() * np.exp(log_weights(b, x))

    def class_sums(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        x = bin_matrix(b.column("x"), width)
        w, base = weights(b, x), b.column("label").to_numpy().astype(np.int64) * size
        yield 0, sum(np.bincount(base + x[:, f] + first[f], w, classes * size) for f in range(width))

    def gini(left: np.ndarray, total: np.ndarray) -> np.ndarray:
        right = total - left
        wl, wr, all_ = left.sum(0), right.sum(0), float(total.sum())
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (left ** 2).sum(0) / wl + (right ** 2).sum(0) / wr - float((total ** 2).sum()) / all_
        return np.where((wl > TINY) & (wr > TINY), gain / all_, -1.0)

    def errors(tree: Tree) -> Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]:
        def tally(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            x = bin_matrix(b.column("x"), width)
            miss, w = np.abs(tree.scores(x) - b.column("label").to_numpy()), weights(b, x)
            yield 0, np.array([(w * miss).sum(), w.sum()])
            yield -1, np.array([miss.max()])
        return tally

    def numbers(b: pa.RecordBatch, x: np.ndarray):
        yield 0, weights(b, x), [b.column("label").to_numpy()]

    for r in range(rounds):
        if task == CLASSIFICATION:
            sums = table.tallied(class_sums)
            if not sums:
                break
            hist = sums[0].reshape(classes, size)
            f, b, _ = best_cut(hist, first, gini)
            part = hist[:, first[f]:first[f + 1]]
            sides = [part[:, :b + 1].sum(1), part[:, b + 1:].sum(1)]
            tree = Tree(1, np.array([f]), np.array([b]), np.array([float(s.argmax()) for s in sides]))
            error = 1 - sum(s.max() for s in sides) / sum(s.sum() for s in sides)
            if error <= TINY:
                stages.append(Stage(tree, 1.0))
                break
            if error >= 1 - 1 / classes:
                stages += [] if stages else [Stage(tree, 1.0)]
                break
            alpha = math.log((1 - error) / error) + math.log(max(1, classes - 1))
            stage = Stage(tree, alpha, math.log(1 - error + error * math.exp(alpha)))
        else:
            (tree,), (sums,), _ = grown(table, cuts, 3, 1, numbers)
            if sums is None:
                break
            tree.value = np.where(sums[0] > 0, sums[1] / np.where(sums[0] > 0, sums[0], 1.0), 0.0)
            found = table.tallied(errors(tree))
            top = float(found[-1][0])
            error = float(found[0][0] / found[0][1] / top) if top > 0 else 0.0
            if top <= 0 or error <= 0:
                stages.append(Stage(tree, 1.0))
                break
            if error >= 0.5:
                stages += [] if stages else [Stage(tree, 1.0)]
                break
            alpha = math.log((1 - error) / error)
            # weights only shrink, at least by the mean error's factor: that factor is taken back
            stage = Stage(tree, alpha, alpha * (error - 1), top)
        stages.append(stage)
        done.append(stage)
        if (r + 1) % writes == 0 and r + 1 < rounds:
            def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    found = log_weights(b, bin_matrix(b.column("x"), width))
                    yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("x", "label", "w")), pa.array(found)],
                                                     ["x", "label", "w", "log_weight"])

            table = table.stepped(weighed, "x binary, label double, w double, log_weight double")
            done = []
    table.drop()
    return [(s.tree.facts(), s.alpha, s.shift, s.top) for s in stages]
