"""Single trees, random forests and extremely random trees, grown until their leaves are pure.

Growth is hybrid. While a node holds more than ``LOCAL`` rows, its tree grows level by level from histograms of binned
features, all trees in one pass. Each smaller node is then grown to the end in a group of its own, from the rows' exact values, all
groups in parallel. No cut parts rows with equal features, so a task sends each distinct vector it holds once per tree, with its sums
(where sums of labels are exact in any order; else its rows), and forests score each distinct vector once. What comes out is a table of subtrees, as large as growth makes it; only the tops of the trees are held
by the driver. Rows are scored by the same route: down the tops, then in groups with the subtree they reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.checkpoints import discard, stored
from tablescope.functions.histograms import bin_matrix, bin_numbers, feature_cuts, lists, matrix, merged, packed, starts, tallied, unpacked
from tablescope.operators.boosting import CLASSIFICATION, REGRESSION, Weights

LOCAL = 200_000           # rows of a node that one task grows to the end
CELLS = 1 << 24           # numbers of all histograms of one pass
CHUNK = 1 << 18           # rows that a histogram of many nodes is added up from at a time
CHUNK_NUMBERS = 1 << 23   # and their features
PACKET = 1 << 20          # bytes, or so, of distinct vectors that travel as one row
EXACT = 1 << 48           # sum of whole numbers up to which adding up weighted ones is exact
SUBTREE = "tree int, leaf int, feature binary, cut binary, below binary, value binary, importance array<double>"


def mixed(v: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
DRAWS = np.ceil(POISSON * (1 << 53)).astype(np.uint64)   # a draw's top 53 bits are at least as many of these as it gives copies
LEADING = np.searchsorted(DRAWS, np.arange(1 << 16, dtype=np.uint64) << np.uint64(37), "right")  # copies by the first 16 bits
UNCLEAR = LEADING != np.searchsorted(DRAWS, (np.arange(1, (1 << 16) + 1, dtype=np.uint64) << np.uint64(37)) - np.uint64(1), "right")
MOVES = 4                 # levels between two times that the rows of growing nodes are put side by side
BLOCK = 1 << 14           # draws made at a time, which a processor's cache holds


def copies(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree sees each row: a Poisson draw of mean one that depends on row, tree and seed alone."""
    out = np.empty(len(rows))
    for begin in range(0, len(rows), BLOCK):
        part = rows[begin:begin + BLOCK].astype(np.uint64)
        with np.errstate(over="ignore"):
            h = mixed(part * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + tree))
        lead = (h >> np.uint64(48)).astype(np.int64)
        drawn = LEADING.take(lead)
        unclear = np.flatnonzero(UNCLEAR.take(lead))
        drawn[unclear] = np.searchsorted(DRAWS, h[unclear] >> np.uint64(11), "right")
        out[begin:begin + BLOCK] = drawn
    return out


def purity(sums: np.ndarray, classes: int) -> np.ndarray:
    """What a cut makes larger: per side, squared class weights over the weight, or the squared sum over the weight."""
    total = weight(sums, classes)
    with np.errstate(divide="ignore", invalid="ignore"):
        found = (sums ** 2).sum(-1) / total if classes else sums[..., 1] ** 2 / total
    return np.where(total > 0, found, 0.0)


def weight(sums: np.ndarray, classes: int) -> np.ndarray:
    return sums.sum(-1) if classes else sums[..., 0]


def row_sums(label: np.ndarray, w: np.ndarray, classes: int) -> np.ndarray:
    if not classes:
        return np.stack([w, w * label], 1)
    out = np.zeros((len(label), classes))
    out[np.arange(len(label)), label.astype(np.int64)] = w
    return out


def grains(size: float, rows: int) -> tuple[float, float]:
    """Two powers of two: labels as whole multiples of the first, and what is left of them as multiples of the second, add up exactly in
    any order, for up to 16 copies of each of ``rows`` rows whose labels' sizes sum up to ``size``."""
    coarse = 2.0 ** (math.ceil(math.log2(32 * size)) - 52)
    return coarse, 2.0 ** (math.ceil(math.log2(16 * max(rows, 1) * coarse)) - 52)


def distinct_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row the number of its distinct row, in order of first appearance, and where each of these first appears."""
    order = np.lexsort(x.T)
    held = x[order]
    new = np.ones(len(x), bool)
    new[1:] = (held[1:] != held[:-1]).any(1)
    first = order[new]
    by = np.argsort(first)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    number = np.empty(len(x), np.int64)
    number[order] = rank[np.cumsum(new) - 1]
    return number, first[by]


@dataclass
class Vectors:
    """Distinct vectors, or rows, with the sums that trees read; for numbers also the least and the greatest label."""

    row: np.ndarray
    x: np.ndarray
    sums: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def where(self, keep: np.ndarray) -> Vectors:
        return Vectors(*(v[keep] for v in vars(self).values()))

    def joined(self, merge: bool = True) -> Vectors:
        """In order of their first row, equal vectors as one if they are to ``merge``."""
        by = np.argsort(self.row, kind="stable")
        if not merge:
            return self.where(by)
        number, first = distinct_rows(self.x[by])
        group = np.argsort(number, kind="stable")
        at = np.searchsorted(number[group], np.arange(len(first)))
        rows = by[group]
        return Vectors(self.row[by[first]], self.x[by[first]], np.add.reduceat(self.sums[rows], at),
                       np.minimum.reduceat(self.low[rows], at), np.maximum.reduceat(self.high[rows], at))


class Merged:
    """A batch of rows by distinct vector, or row by row if equal ones are not to ``merge``. Labels that don't add up exactly are summed
    in two parts, multiples of ``parts``."""

    def __init__(self, b: pa.RecordBatch, width: int, classes: int, merge: bool, parts: tuple[float, float] | None = None):
        ids, x = b.column("row").to_numpy(), matrix(b.column("x"), width)
        order = np.argsort(ids, kind="stable")
        number, first = distinct_rows(x[order]) if merge else (np.arange(len(x)), np.arange(len(x)))
        self.row, self.x, self.classes = ids[order[first]], x[order[first]], classes
        by = np.argsort(number, kind="stable")
        self.ids, self.label, self.number = ids[order[by]], b.column("label").to_numpy()[order[by]], number[by]
        self.at = np.searchsorted(self.number, np.arange(len(first)))
        self.summed = [self.label]
        if classes:
            self.cell = self.number * classes + self.label.astype(np.int64)
        elif parts:
            coarse = np.rint(self.label / parts[0]) * parts[0]
            self.summed = [coarse, np.rint((self.label - coarse) / parts[1]) * parts[1]]

    def seen(self, tree: int, bootstrap: bool, seed: int) -> Vectors:
        """What a tree sees; vectors it doesn't see weigh nothing."""
        n, label = len(self.row), self.label
        w = copies(self.ids, tree, seed) if bootstrap else np.ones(len(label))
        if self.classes:
            sums = np.bincount(self.cell, w, n * self.classes).reshape(n, self.classes)
            return Vectors(self.row, self.x, sums, np.zeros(n), np.zeros(n))
        if n == len(label):
            sums, added = [w, *(w * v for v in self.summed)], lambda v: v
        else:
            sums, added = [w, *(w * v for v in self.summed)], lambda v: np.add.reduceat(v, self.at)
        return Vectors(self.row, self.x, np.stack([added(v) for v in sums], 1),
                       np.minimum.reduceat(np.where(w > 0, label, np.inf), self.at),
                       np.maximum.reduceat(np.where(w > 0, label, -np.inf), self.at))


class Totals:
    """The distinct vectors of many batches, with the sums of every tree; of one for all if trees see the same."""

    def __init__(self, trees: int, bootstrap: bool, seed: int):
        self.trees, self.bootstrap, self.seed, self.numbers, self.held = trees, bootstrap, seed, {}, []

    def add(self, found: Merged) -> None:
        at = np.array([self.numbers.setdefault((v + 0.0).tobytes(), len(self.numbers)) for v in found.x])
        apart = len(np.unique(at)) == len(at)
        for t in range(self.trees if self.bootstrap else 1):
            seen = found.seen(t, self.bootstrap, self.seed)
            if not self.held or len(self.held) == t:
                self.held.append(self.none(0, seen))
            if len(self.held[t].row) < len(self.numbers):
                more = self.none(max(len(self.numbers), 2 * len(self.held[t].row)), seen)
                for new, old in zip(vars(more).values(), vars(self.held[t]).values()):
                    new[:len(old)] = old
                self.held[t] = more
            all_ = self.held[t]
            all_.x[at] = seen.x
            if apart:
                all_.sums[at] += seen.sums
                for kept, v, f in ((all_.row, seen.row, np.minimum), (all_.low, seen.low, np.minimum), (all_.high, seen.high, np.maximum)):
                    kept[at] = f(kept[at], v)
            else:
                np.add.at(all_.sums, at, seen.sums)
                for kept, v, f in ((all_.row, seen.row, np.minimum), (all_.low, seen.low, np.minimum), (all_.high, seen.high, np.maximum)):
                    f.at(kept, at, v)

    @staticmethod
    def none(n: int, like: Vectors) -> Vectors:
        return Vectors(np.full(n, np.iinfo(np.int64).max), np.zeros((n, like.x.shape[1])), np.zeros((n, like.sums.shape[1])),
                       np.full(n, np.inf), np.full(n, -np.inf))

    def numbers_held(self) -> int:
        return sum(v.size for h in self.held for v in vars(h).values())

    def seen(self) -> Iterator[tuple[int, Vectors]]:
        """By tree, the vectors that it sees."""
        for t in range(self.trees if self.held else 0):
            kept = self.held[t if self.bootstrap else 0]
            yield t, kept.where(kept.sums.any(1))


def leaf_values(sums: np.ndarray, classes: int) -> np.ndarray:
    """Class shares, or the mean, per node."""
    total = np.maximum(weight(sums, classes), 1e-300)[:, None]
    return sums / total if classes else sums[:, 1:] / total


def choice(gains: np.ndarray, tries: int, rng: np.random.Generator) -> np.ndarray:
    """Per node the feature of the best cut among ``tries`` features drawn from those that can be cut; -1 if none can."""
    able = gains > -np.inf
    if tries < gains.shape[1]:
        drawn = np.where(able, rng.random(gains.shape), 2.0)
        able &= drawn.argsort(1).argsort(1) < tries
    best = np.where(able, gains, -np.inf)
    return np.where(able.any(1), best.argmax(1), -1)


def sides(left: np.ndarray, total: np.ndarray, classes: int) -> np.ndarray:
    """What cuts make of purity, from the sums to the left of them and in all, a line per sum."""
    out = None
    for part in (left, total - left):
        over = part[0]
        if classes:
            over, squares = part[0] + part[1], part[0] ** 2 + part[1] ** 2
            for v in part[2:]:
                over = over + v
                squares += v ** 2
        else:
            squares = part[1] ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            found = np.where(over > 0, squares / over, 0.0)
        out = found if out is None else out + found
    return out


def exact_cuts(xs: np.ndarray, sums: np.ndarray, seg: np.ndarray, at: np.ndarray, total: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Best gain and cut per node over the rows sorted by node and value; nodes start at ``at``. A line per sum."""
    run = np.cumsum(sums, axis=1)
    base = np.where(at > 0, run[:, np.maximum(at - 1, 0)], 0.0)
    ok = np.flatnonzero((seg[:-1] == seg[1:]) & (xs[:-1] < xs[1:]))
    best, cut = np.full(len(at), -np.inf), np.zeros(len(at))
    if not len(ok):
        return best, cut
    mine = seg.take(ok)
    gain = sides(run.take(ok, axis=1) - base.take(mine, axis=1), total.take(mine, axis=1), classes)
    begins = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
    nodes, most = mine[begins], np.maximum.reduceat(gain, begins)
    best[nodes] = most
    where = np.flatnonzero(gain == best.take(mine))
    held, first = np.unique(mine.take(where), return_index=True)
    i = ok[where[first]]
    middle = xs[i] / 2 + xs[i + 1] / 2
    cut[held] = np.where((middle >= xs[i]) & (middle < xs[i + 1]), middle, xs[i])
    return best, cut


def random_cuts(xs: np.ndarray, sums: np.ndarray, seg: np.ndarray, at: np.ndarray, total: np.ndarray, classes: int,
                drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One uniform cut between the least and the greatest value per node, at a share ``drawn`` of the way, and its gain."""
    low, high = np.minimum.reduceat(xs, at), np.maximum.reduceat(xs, at)
    cut = low + drawn * (high - low)
    cut = np.where(cut >= high, low, cut)
    left = np.add.reduceat(sums * (xs <= cut.take(seg)), at, axis=1)
    return np.where(high > low, sides(left, total, classes), -np.inf), cut


class Looks:
    """Cuts of the features drawn for each node, looked at in the order drawn until ``tries`` of them can be cut."""

    def __init__(self, lines: np.ndarray, sums: np.ndarray, classes: int, tries: int, at_random: bool):
        self.lines, self.flat, self.sums = lines, lines.ravel(), sums
        self.classes, self.tries, self.at_random = classes, tries, at_random
        self.row_bits = max(1, lines.shape[1] - 1).bit_length()
        if not at_random:
            self.ranks = np.stack([np.unique(v, return_inverse=True)[1].reshape(-1) for v in lines]).ravel().astype(np.int64) << self.row_bits

    def moved(self, lines: np.ndarray, sums: np.ndarray, rows: np.ndarray) -> None:
        """Only ``rows`` are left, in that order."""
        if not self.at_random:
            self.ranks = self.ranks.reshape(len(lines), -1).take(rows, axis=1).ravel()
        self.lines, self.flat, self.sums = lines, lines.ravel(), sums

    def cuts(self, rows: np.ndarray, sizes: np.ndarray, total: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Gain and cut by node and feature, from the rows in order of their nodes; features that no one looked at gain nothing."""
        width, n = self.lines.shape
        gains, cuts = np.full((len(sizes), width), -np.inf), np.zeros((len(sizes), width))
        shares = np.stack([rng.random(len(sizes)) for _ in range(width)], 1) if self.at_random else None
        order = rng.random(gains.shape).argsort(1)
        found, seg = np.zeros(len(sizes), np.int64), np.repeat(np.arange(len(sizes)), sizes)
        for rank in range(width):
            asks = found < self.tries
            if not asks.any():
                break
            nodes = np.flatnonzero(asks)
            mine, own, counts = (rows, seg, sizes) if len(nodes) == len(sizes) else (
                (kept := asks.take(seg), rows[kept])[1], np.repeat(np.arange(len(nodes)), sizes[nodes]), sizes[nodes])
            f, at = order[nodes, rank], np.cumsum(counts) - counts
            place = np.repeat(f * n, counts)
            if not self.at_random:
                bits = 2 * self.row_bits
                if bits + len(nodes).bit_length() < 63:
                    key = (own << bits) | self.ranks.take(place + mine) | mine
                    key.sort()
                    mine = key & ((1 << self.row_bits) - 1)
                else:
                    mine = mine[np.lexsort((mine, self.ranks.take(place + mine), own))]
            xs, added = self.flat.take(place + mine), self.sums.take(mine, axis=1)
            whole = total.take(nodes, axis=1)
            gain, cut = (random_cuts(xs, added, own, at, whole, self.classes, shares[nodes, f]) if self.at_random
                         else exact_cuts(xs, added, own, at, whole, self.classes))
            gains[nodes, f], cuts[nodes, f] = gain, cut
            found[nodes] += gain > -np.inf
        return gains, cuts


def parted(order: np.ndarray, right: np.ndarray, lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
    """Rows in order of their nodes, each node cut into its rows to the left and to the right; ``lefts`` and ``rights`` count them per node."""
    out, goes = np.empty_like(order), right.take(order)
    before = np.cumsum(lefts + rights) - lefts - rights
    for side, sizes, at in ((order[~goes], lefts, before), (order[goes], rights, before + lefts)):
        out[np.arange(len(side)) + np.repeat(at - (np.cumsum(sizes) - sizes), sizes)] = side
    return out


@dataclass
class Nodes:
    """A tree as arrays; children of node i are below[i] and below[i] + 1, leaves have feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            f = self.feature[node[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            at = node[rows]
            node[rows] = self.below[at] + ~(x[rows, f] <= self.cut[at])
        return node


def grow(x: np.ndarray, label: np.ndarray, w: np.ndarray, classes: int, tries: int, at_random: bool, depth: int,
         rng: np.random.Generator) -> tuple[Nodes, np.ndarray]:
    """A tree from rows in memory, all nodes of a level at once, until leaves are pure, uncuttable or ``depth`` deep."""
    return grow_vectors(Vectors(np.arange(len(x)), x, row_sums(label, w, classes), label, label), classes, tries, at_random, depth, rng)


def grow_vectors(held: Vectors, classes: int, tries: int, at_random: bool, depth: int, rng: np.random.Generator) -> tuple[Nodes, np.ndarray]:
    """The tree of the rows that vectors stand for."""
    n, width = held.x.shape
    lines = np.ascontiguousarray(held.x.T)
    flat = lines.ravel()
    stats, high, low_ = np.ascontiguousarray(held.sums.T), held.high, held.low
    looks = Looks(lines, stats, classes, tries, at_random) if tries < width and n else None
    # rows in order of node and value; cuts at random of counted classes, and of drawn features, need no order of values
    orders = [np.argsort(lines[f], kind="stable") for f in range(1 if looks or at_random and classes else width)]
    node, importance = np.zeros(n, np.int64), np.zeros(width)
    feature, cut, below, value = [np.array([-1])], [np.zeros(1)], [np.zeros(1, np.int64)], [held.sums.sum(0)[None]]
    low, size, level = 0, 1, 0   # the nodes of this level are low .. low + size - 1
    while size and level < depth and n:
        total = value[-1]
        live = orders[0]
        # nodes with one class, or one number, are done
        spread = np.zeros(size, bool)
        if classes:
            spread = (total > 0).sum(1) > 1
        else:
            begins = np.searchsorted(node.take(live), low + np.arange(size))
            spread = np.maximum.reduceat(high.take(live), begins) > np.minimum.reduceat(low_.take(live), begins)
        tried = np.flatnonzero(spread)
        if not len(tried):
            break
        short = np.full(size, -1)
        short[tried] = np.arange(len(tried))
        if len(tried) < size:
            alive = np.zeros(n, bool)
            alive[live] = short[node[live] - low] >= 0
            orders = [o[alive.take(o)] for o in orders]
        if level % MOVES == MOVES - 1:  # rows of a node side by side, so that a processor's cache holds what is read together
            rows = orders[0]
            place = np.empty(n, np.int64)
            place[rows] = np.arange(len(rows))
            lines, stats, high, low_ = (np.ascontiguousarray(v.take(rows, axis=-1)) for v in (lines, stats, high, low_))
            node, orders, n, flat = node.take(rows), [place.take(o) for o in orders], len(rows), lines.ravel()
            if looks:
                looks.moved(lines, stats, rows)
        sizes = np.bincount(node[orders[0]] - low, minlength=size)[tried]
        if looks:
            gains, cuts = looks.cuts(orders[0], sizes, np.ascontiguousarray(total[tried].T), rng)
            best = np.where((gains > -np.inf).any(1), gains.argmax(1), -1)
        else:
            gains, cuts = np.full((len(tried), width), -np.inf), np.zeros((len(tried), width))
            seg, at = np.repeat(np.arange(len(tried)), sizes), np.cumsum(sizes) - sizes
            whole = np.ascontiguousarray(total[tried].T)
            for f in range(width):
                rows = orders[f % len(orders)]
                if not f or len(orders) > 1:
                    added = stats.take(rows, axis=1)
                args = (lines[f].take(rows), added, seg, at, whole, classes)
                gains[:, f], cuts[:, f] = random_cuts(*args, rng.random(len(at))) if at_random else exact_cuts(*args)
            best = choice(gains, tries, rng)
        split = np.flatnonzero(best >= 0)
        chosen = best[split]
        np.add.at(importance, chosen, gains[split, chosen] - purity(total[tried[split]], classes))
        grown = np.full(size, -1)
        grown[tried[split]] = np.arange(len(split))
        feature[-1][tried[split]], cut[-1][tried[split]] = chosen, cuts[split, chosen]
        below[-1][tried[split]] = low + size + 2 * np.arange(len(split))
        child = np.full(n, -1)
        rows = orders[0]
        mine = grown.take(node.take(rows) - low)
        rows, mine = rows[mine >= 0], mine[mine >= 0]
        right = ~(flat.take(chosen.take(mine) * n + rows) <= cuts[split, chosen].take(mine))
        child[rows] = low + size + 2 * mine + right
        went = np.zeros(n, bool)
        went[rows] = right
        rights = np.bincount(mine[right], minlength=len(split))
        lefts = np.bincount(mine, minlength=len(split)) - rights
        stays = child >= 0
        orders = [parted(o[stays.take(o)], went, lefts, rights) for o in orders]
        low, size, level = low + size, 2 * len(split), level + 1
        node = child
        below_sums, own = np.zeros((size, len(stats))), child.take(rows) - low
        for s, v in enumerate(stats):
            below_sums[:, s] = np.bincount(own, v.take(rows), size)
        feature.append(np.full(size, -1))
        cut.append(np.zeros(size))
        below.append(np.zeros(size, np.int64))
        value.append(below_sums)
    return Nodes(np.concatenate(feature), np.concatenate(cut), np.concatenate(below),
                 leaf_values(np.concatenate(value), classes)), importance


# --- tops of trees over more rows than one task takes ---------------------------------------


@dataclass
class Top:
    """The part of a tree that histograms grew."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    below: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: float) -> int:
        self.feature[node], self.cut[node], self.below[node] = feature, cut, len(self.feature)
        for _ in range(2):
            self.feature.append(-1)
            self.cut.append(0.0)
            self.below.append(0)
        return self.below[node]

    def nodes(self) -> Nodes:
        return Nodes(np.array(self.feature), np.array(self.cut), np.array(self.below), np.zeros((len(self.feature), 0)))


def histogram_cuts(hist: np.ndarray, first: np.ndarray, values: Sequence[np.ndarray], classes: int, at_random: bool,
                   rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Gain and bin of the best, or of a random, cut per feature of one node."""
    width = len(first) - 1
    gains, bins = np.full(width, -np.inf), np.zeros(width, np.int64)
    for f in range(width):
        part = hist[first[f]:first[f + 1]]
        left = np.cumsum(part, axis=0)
        held = np.flatnonzero(weight(part, classes) > 0)
        if len(held) < 2:
            continue
        spots = np.arange(held[0], held[-1])     # a cut after any of these bins leaves rows on both sides
        if at_random:
            edge = values[f]
            drawn = edge[held[0]] + rng.random() * (edge[min(held[-1], len(edge) - 1)] - edge[held[0]])
            spots = np.array([np.clip(np.searchsorted(edge, drawn, "right") - 1, held[0], held[-1] - 1)])
        gain = purity(left[spots], classes) + purity(left[-1] - left[spots], classes)
        gains[f], bins[f] = gain.max(), spots[gain.argmax()]
    return gains, bins


def binned_rows(rows: DataFrame, cuts: Sequence[np.ndarray]) -> DataFrame:
    """row, x as the bin of each feature, label."""
    width = len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row"), packed(bin_numbers(matrix(b.column("x"), width), cuts)), b.column("label")],
                                             ["row", "x", "label"])

    return rows.mapInArrow(run, "row bigint, x binary, label double")


def grow_tops(rows: DataFrame, total: int, trees: int, classes: int, bootstrap: bool, tries: int, at_random: bool, depth: int,
              seed: int, cuts: Sequence[np.ndarray], importance: np.ndarray) -> list[Top]:
    """Grow every node of more than ``LOCAL`` rows, a level of all trees at a time. A cut is a bin's, so bins tell where a row goes."""
    first, width = starts(cuts), len(cuts)
    size, stats, tops = int(first[-1]), classes or 2, [Top() for _ in range(trees)]
    rng = np.random.default_rng(seed)
    if total <= LOCAL:
        return tops
    open_ = [(t, 0) for t in range(trees)]
    level = 0
    binned, path = stored(binned_rows(rows, cuts))
    while open_ and level < depth:
        after = []
        step = max(1, CELLS // (size * stats))
        for begin in range(0, len(open_), step):
            part = open_[begin:begin + step]
            by_tree: dict[int, list[tuple[int, int]]] = {}
            for slot, (t, node) in enumerate(part):
                by_tree.setdefault(t, []).append((node, slot))
            shapes = {t: tops[t].nodes() for t in by_tree}
            for shape in shapes.values():
                shape.cut = np.array([np.searchsorted(cuts[f], c) if f >= 0 else 0 for f, c in zip(shape.feature.tolist(), shape.cut.tolist())])

            def tally(b: pa.RecordBatch, by_tree=by_tree, shapes=shapes) -> Iterator[tuple[int, np.ndarray]]:
                bins, ids, label = bin_matrix(b.column("x"), width), b.column("row").to_numpy(), b.column("label").to_numpy()
                kind = label.astype(np.int64) if classes else None
                for t, nodes in by_tree.items():
                    w = copies(ids, t, seed) if bootstrap else np.ones(len(ids))
                    reached = shapes[t].leaves(bins)
                    place = np.full(len(shapes[t].feature), -1)
                    place[[node for node, _ in nodes]] = np.arange(len(nodes))
                    at = place.take(reached)
                    own = np.flatnonzero((at >= 0) & (w > 0))
                    at, w = at.take(own), w.take(own)
                    out = np.zeros((len(nodes), size, stats))
                    for f in range(width):
                        span = int(first[f + 1] - first[f])
                        spot = at * span + bins[:, f].take(own)
                        if classes:
                            found = np.bincount(spot * classes + kind.take(own), w, len(nodes) * span * classes).reshape(len(nodes), span, classes)
                        else:
                            found = np.stack([np.bincount(spot, v, len(nodes) * span) for v in (w, w * label.take(own))], 1).reshape(len(nodes), span, 2)
                        out[:, first[f]:first[f + 1]] = found
                    for k in np.unique(at):
                        yield nodes[k][1], out[k].ravel()

            for slot, flat in sorted(tallied(binned, tally, max(1, min(CHUNK, CHUNK_NUMBERS // width))).items()):
                t, node = part[slot]
                hist = flat.reshape(size, stats)
                whole = hist[first[0]:first[1]].sum(0)
                if weight(whole, classes) <= LOCAL or (classes and (whole > 0).sum() < 2):
                    continue
                gains, bins = histogram_cuts(hist, first, cuts, classes, at_random, rng)
                f = int(choice(gains[None], tries, rng)[0])
                if f < 0:
                    continue
                importance[f] += gains[f] - purity(whole, classes)
                child = tops[t].split(node, f, float(cuts[f][bins[f]]))
                after += [(t, child), (t, child + 1)]
        open_, level = after, level + 1
    discard(rows.sparkSession, path)
    return tops


# --- fitting and scoring -------------------------------------------------------------------


@dataclass
class Forest:
    """Tops by tree, the table of subtrees, and facts for scoring."""

    task: str
    classes: int
    width: int
    tops: list[Top]
    subtrees: DataFrame
    importance: np.ndarray


def _packed(nodes: Nodes) -> tuple[bytes, ...]:
    return (nodes.feature.astype(np.int32).tobytes(), nodes.cut.astype(np.float64).tobytes(),
            nodes.below.astype(np.int32).tobytes(), nodes.value.astype(np.float64).tobytes())


def _unpacked(row: dict, outs: int) -> Nodes:
    return Nodes(np.frombuffer(row["feature"], np.int32), np.frombuffer(row["cut"], np.float64),
                 np.frombuffer(row["below"], np.int32).astype(np.int64), np.frombuffer(row["value"], np.float64).reshape(-1, outs))


def routed(rows: DataFrame, tops: list[Top], bootstrap: bool, seed: int, width: int, chunks: list[np.ndarray] | None = None) -> DataFrame:
    """row, x, label, tree, leaf, w: every row once per tree that sees it; and its chunk of the leaf, out of as many as ``chunks`` has."""
    names = [n for n in ("row", "label") if n in rows.columns]
    shapes = [t.nodes() for t in tops]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids = matrix(b.column("x"), width), b.column("row").to_numpy()
            cells = packed(x)
            for t, shape in enumerate(shapes):
                w = copies(ids, t, seed) if bootstrap else np.ones(len(ids))
                seen, leaf = pa.array(np.flatnonzero(w)), shape.leaves(x)
                made = [*(b.column(n).take(seen) for n in names), cells.take(seen), pa.array(np.full(len(seen), t, np.int32)),
                        pa.array(leaf.astype(np.int32)).take(seen), pa.array(w).take(seen)]
                if chunks is not None:
                    with np.errstate(over="ignore"):
                        spread = mixed(ids.astype(np.uint64)) % chunks[t][leaf].astype(np.uint64)
                    made.append(pa.array(spread.astype(np.int32)).take(seen))
                yield pa.RecordBatch.from_arrays(made, [*names, "x", "tree", "leaf", "w", "chunk"][:len(made)])

    kinds = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    return rows.mapInArrow(run, f"{kinds}x binary, tree int, leaf int, w double" + (", chunk int" if chunks is not None else ""))


def gathered(rows: DataFrame, tops: list[Top], bootstrap: bool, seed: int, width: int, classes: int, merge: bool = True,
             parts: tuple[float, float] | None = None, few: bool = False) -> DataFrame:
    """tree, leaf and, packed, the distinct vectors of a task's rows that reach them. Where they are ``few``, all rows reach the roots,
    and a task adds up its batches."""
    shapes, stats = [t.nodes() for t in tops], classes or 2
    step = max(1, PACKET // (8 * (width + stats + 3)))

    def packets(t: int, shape: Nodes, seen: Vectors) -> Iterator[pa.RecordBatch]:
        own = np.flatnonzero(weight(seen.sums, classes) > 0)
        leaf = shape.leaves(seen.x[own])
        own = own[np.argsort(leaf, kind="stable")]
        found, sizes = np.unique(leaf, return_counts=True)
        for k, part in zip(found.tolist(), np.split(own, np.cumsum(sizes)[:-1])):
            for begin in range(0, len(part), step):
                sent = seen.where(part[begin:begin + step])
                if classes:  # counts, mostly small ones; the labels have no range
                    sent.low = sent.high = np.zeros(0)
                    sent.sums = sent.sums.astype(np.uint8) if sent.sums.max() < 256 else sent.sums
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t], pa.int32()), pa.array([k], pa.int32()),
                     *(pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in vars(sent).values())],
                    ["tree", "leaf", "row", "x", "sums", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = Totals(len(shapes), bootstrap, seed)
        for b in merged(batches, max(1, min(CHUNK, CHUNK_NUMBERS // width))):
            if not b.num_rows:
                continue
            held = Merged(b, width, classes, merge, parts)
            if few:
                totals.add(held)
                if totals.numbers_held() > CELLS:
                    yield from (p for t, seen in totals.seen() for p in packets(t, shapes[t], seen))
                    totals = Totals(len(shapes), bootstrap, seed)
                continue
            seen = None
            for t, shape in enumerate(shapes):
                if bootstrap or seen is None:
                    seen = held.seen(t, bootstrap, seed)
                yield from packets(t, shape, seen)
        yield from (p for t, seen in totals.seen() for p in packets(t, shapes[t], seen))

    return rows.mapInArrow(run, "tree int, leaf int, row binary, x binary, sums binary, low binary, high binary")


def received(table: pa.Table, width: int, stats: int, merge: bool = True, split: bool = False) -> Vectors:
    """The vectors of a group's packets, with one sum of labels where it came ``split`` in two."""
    def column(name: str, kind: type = np.float64) -> np.ndarray:
        return np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table.column(name)])
    row, counts = column("row", np.int64), []
    for ids, sums in zip(table.column("row"), table.column("sums")):
        cells = len(ids.as_buffer()) // 8 * (stats + split)
        counts.append(np.frombuffer(sums.as_buffer(), np.uint8 if cells == len(sums.as_buffer()) else np.float64).astype(np.float64))
    low, high = (v if len(v) else np.zeros(len(row)) for v in (column("low"), column("high")))
    out = Vectors(row, column("x").reshape(-1, width), np.concatenate(counts).reshape(-1, stats + split), low, high).joined(merge)
    if split:
        out.sums = np.stack([out.sums[:, 0], out.sums[:, 1] + out.sums[:, 2]], 1)
    return out


def leaf_chunks(rows: DataFrame, tops: list[Top], width: int) -> list[np.ndarray]:
    """By tree and leaf of its top, the chunks of up to about ``LOCAL`` rows that the rows reaching it make."""
    shapes = [t.nodes() for t in tops]

    def tally(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        x = matrix(b.column("x"), width)
        for t, shape in enumerate(shapes):
            yield t, np.bincount(shape.leaves(x), minlength=len(shape.feature)).astype(float)

    found = tallied(rows, tally)
    return [1 + (found[t] if t in found else np.zeros(len(s.feature))).astype(np.int64) // LOCAL for t, s in enumerate(shapes)]


def doubles(cells: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.concatenate([unpacked(c, width, np.float64) for c in cells.chunks] or [np.zeros((0, width))])


def fit_forest(df: DataFrame, task: str, classes: int = 2, trees: int = 100, bootstrap: bool = True, tries: str = "sqrt",
               at_random: bool = False, depth: int | None = None, seed: int = 42) -> Forest:
    """Trees on ``features`` and ``label``, for at least ``classes`` classes. ``tries``: sqrt or all features are looked at for a cut; ``depth`` None: no limit."""
    cuts = feature_cuts(df)
    width = len(cuts)
    rows, _ = stored(df.select(F.monotonically_increasing_id().alias("row"), vector_to_array("features").alias("x"),
                               F.col("label").cast("double").alias("label")))
    total, top, size, part, apart = rows.agg(F.count("*"), F.max("label"), F.sum(F.abs("label")), F.max(F.abs(F.col("label") - F.rint("label"))),
                                             F.approx_count_distinct(F.xxhash64("x"), 0.02)).first()
    classes = max(2, classes, int(top or 0) + 1) if task == CLASSIFICATION else 0
    merge = classes > 0 or part == 0 and size < EXACT
    # where rows are more than one task takes, labels that don't add up exactly are summed in two parts that do
    parts = grains(size, total) if not merge and total > LOCAL and 1e-200 < size < 1e200 and part is not None and math.isfinite(part) else None
    merge = merge or parts is not None
    few = merge and apart <= LOCAL < total
    looks = max(1, int(math.sqrt(width))) if tries == "sqrt" else width
    deep = depth if depth is not None else 1 << 30
    importance = np.zeros(width)
    tops = grow_tops(rows, apart if few else total, trees, classes, bootstrap, looks, at_random, deep, seed, cuts, importance)

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        tree, leaf = key[0].as_py(), key[1].as_py()
        rng = np.random.default_rng([seed, tree, leaf])
        # in order of rows: the same tree however they arrive
        nodes, gains = grow_vectors(received(table, width, classes or 2, merge, parts is not None), classes, looks, at_random, deep, rng)
        return pa.Table.from_pydict({"tree": [tree], "leaf": [leaf], **dict(zip(("feature", "cut", "below", "value"), ([p] for p in _packed(nodes)))),
                                     "importance": [gains.tolist()]}, pa.schema([
                                         ("tree", pa.int32()), ("leaf", pa.int32()), *((n, pa.binary()) for n in ("feature", "cut", "below", "value")),
                                         ("importance", pa.list_(pa.float64()))]))

    subtrees, _ = stored(gathered(rows, tops, bootstrap, seed, width, classes, merge, parts, few).groupBy("tree", "leaf").applyInArrow(finish, SUBTREE))
    sums = subtrees.select(F.posexplode("importance").alias("f", "gain")).groupBy("f").agg(F.sum("gain").alias("gain")).collect()
    for r in sums:
        importance[r["f"]] += r["gain"]
    return Forest(task, classes, width, tops, subtrees, importance / (importance.sum() or 1.0))


def scored(df: DataFrame, forest: Forest) -> DataFrame:
    """``df`` with prediction and, for classes, probability: the mean over the trees. Its rows are written once with numbers.

    Several trees are asked once for each distinct vector.
    """
    outs, width, taken = forest.classes or 1, forest.width, {c.lower() for c in df.columns}
    name = "_row"
    while name in taken:
        name = f"_{name}"
    rows, _ = stored(df.withColumn(name, F.monotonically_increasing_id()))
    plain = rows.select(F.col(name).alias("row"), vector_to_array("features").alias("x"))
    several = len(forest.tops) > 1
    if several:
        plain, _ = stored(plain.groupBy("x").agg(F.min("row").alias("row")).select("row", "x"))
    small = plain.count() <= LOCAL
    chunks = [np.ones(len(t.feature), np.int64) for t in forest.tops] if small else leaf_chunks(plain, forest.tops, width)
    asked = routed(plain, forest.tops, False, 0, width, chunks)
    # a subtree is copied only for the chunks of its own leaf
    many = [(t, int(leaf), int(c[leaf])) for t, c in enumerate(chunks) for leaf in np.flatnonzero(c > 1)]
    counts = rows.sparkSession.createDataFrame(many, "tree int, leaf int, chunks int")
    last = F.coalesce(F.col("chunks"), F.lit(1)) - 1
    trees = forest.subtrees.drop("importance").join(F.broadcast(counts), ["tree", "leaf"], "left").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), last))).drop("chunks")

    def score(key: tuple, table: pa.Table, nodes: pa.Table) -> pa.Table:
        if not table.num_rows or not nodes.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "out": pa.array([], pa.list_(pa.float64()))})
        tree = _unpacked(nodes.to_pylist()[0], outs)
        found = tree.value[tree.leaves(doubles(table.column("x"), width))]
        return pa.table({"row": table.column("row"), "out": lists(found)})

    keys = ["tree", "leaf", "chunk"]
    said = asked.select("row", "x", *keys).groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(score, "row bigint, out array<double>")
    means = said.groupBy("row").agg(F.array(*[F.avg(F.get("out", F.lit(k))) for k in range(outs)]).alias("_out"))
    if several:
        means = plain.join(means, "row").select(F.col("x").alias(name), "_out")
        rows = rows.withColumn(name, vector_to_array("features"))
    made = rows.join(means.withColumnRenamed("row", name), name, "left").drop(name)
    if forest.task == REGRESSION:
        return made.withColumn("prediction", F.get("_out", F.lit(0))).drop("_out")
    return (made.withColumn("probability", array_to_vector("_out"))
            .withColumn("prediction", (F.array_position("_out", F.array_max("_out")) - 1).cast("double")).drop("_out"))


class GrownTrees(Estimator):
    """Trees as a pipeline stage; the arguments are those of :func:`fit_forest`."""

    def __init__(self, task: str, **options):
        super().__init__()
        self.task, self.options = task, options

    def _fit(self, dataset: DataFrame) -> GrownTreesModel:
        return GrownTreesModel(fit_forest(dataset.select("features", "label"), self.task, **self.options))


class GrownTreesModel(Model, MLWritable, MLReadable):
    def __init__(self, forest: Forest):
        super().__init__()
        self.forest = forest

    @property
    def featureImportances(self) -> Weights:  # noqa: N802
        return Weights(self.forest.importance)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return scored(dataset, self.forest)

    def write(self) -> MLWriter:
        return ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return ForestReader()


class ForestWriter(MLWriter):
    """Facts and tops as metadata, subtrees as a table beside it."""

    def __init__(self, model: GrownTreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        f = self.model.forest
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={
            "task": f.task, "classes": f.classes, "width": f.width, "importance": f.importance.tolist(),
            "tops": [[t.feature, t.cut, t.below] for t in f.tops]})
        f.subtrees.write.parquet(f"{path}/subtrees")


class ForestReader(MLReader):
    def load(self, path: str) -> GrownTreesModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        subtrees = self.sparkSession.read.schema(SUBTREE).parquet(f"{path}/subtrees")
        made = GrownTreesModel(Forest(meta["task"], meta["classes"], meta["width"], [Top(*t) for t in meta["tops"]], subtrees,
                                      np.array(meta["importance"])))
        made._resetUid(meta["uid"])
        return made
