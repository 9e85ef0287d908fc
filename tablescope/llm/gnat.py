"""Product codes of vectors; the nearest codebook entry of each part is found in a geometric near-neighbour access tree.

Vectors become whole numbers, floor(1024 * x), and are cut into four equal parts. A part position's codebook starts as that part
of the 256 vectors with the smallest keys; each of four rounds assigns every part to its nearest entry and moves the entry to
the floored mean of its parts; a last pass assigns again.

The tree over the entries of a codebook: each node has up to 16 split points, far from each other; every other entry
belongs to its nearest split point, and each split point keeps, for each child, the least and the greatest distance to an entry of
that child. A query measures its distance to the split points of a node; if that distance less the greatest, or the least less that
distance, exceeds the best distance so far, no entry of the child can be as near, and the subtree is left out. Roots are
rounded so that bounds only widen, and the test is strict, so an entry at equal distance is never left out; what decides
are squared distances in whole numbers, ties going to the lower index.

Tasks search for batches of vectors with the tree built from the broadcast-sized codebooks (4 x 256 entries, whatever the table
holds), add up their parts per entry, and Spark sums these. Only codebooks reach the driver.

Defined results: vectors that are null or hold null, NaN or infinite components are dropped; a vector shorter than the longest, or
than the next multiple of four, is filled up with zeros; null keys come last and rows of one key in order of their vectors when
the first 256 are chosen; rows are kept apart however often they repeat; an empty table gives an empty result. Components
beyond 2^20 in size are computed with Python's unbounded integers; errors beyond a long are given as the greatest long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import column, shared_folder, write

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
DEGREE = 16               # split points of a node
EXACT = 1 << 20           # components up to this size: sums of squares stay whole in doubles (and fewer than 2048 of them)
LONGEST = 2047
ROWS = 8192               # vectors searched for at once
MAX = (1 << 63) - 1
LIMB = 60
WIDER = 1 + 2.0 ** -50    # covers the rounding of a difference of two roots
HOT = 4096                # labels with more than one row in HOT of all are joined by broadcast: there are fewer than HOT


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """All squared distances, exact: in doubles where every sum stays below 2^53, else in unbounded integers."""
    if points.dtype == object or entries.dtype == object:
        gap = points.astype(object)[:, None, :] - entries.astype(object)[None, :, :]
        return (gap * gap).sum(axis=2) if gap.shape[2] else np.zeros(gap.shape[:2], np.float64)
    return (points * points).sum(1)[:, None] + (entries * entries).sum(1)[None, :] - 2.0 * (points @ entries.T)


def roots(square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number not above and one not below the root of every square."""
    if square.dtype == object:
        whole = [math.isqrt(int(v)) for v in square.flat]
        top = int(np.finfo(np.float64).max)
        near = np.array([float(min(v, top)) for v in whole]).reshape(square.shape)
        over = np.array([v + 1 >= top for v in whole]).reshape(square.shape)
        # the whole root is at most one below the root itself
        return np.nextafter(near, 0), np.where(over, np.inf, np.nextafter(near + 1, np.inf))
    near = np.sqrt(square)
    return np.nextafter(np.nextafter(near, 0), 0), np.nextafter(np.nextafter(near, np.inf), np.inf)


class Gnat:
    """A node of the tree: split points, the distance ranges between split points and children, the children."""

    def __init__(self, entries: np.ndarray, members: np.ndarray):
        self.splits = self.spread(entries, members)
        self.points = entries[self.splits]
        rest = np.setdiff1d(members, self.splits)
        k = len(self.splits)
        near = squares(entries[rest], self.points).argmin(1) if len(rest) else np.zeros(0, np.int64)
        groups = [rest[near == j] for j in range(k)]
        # the ranges are for the entries below a child; its split point itself has been measured
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for j, group in enumerate(groups):
            if len(group):
                below, above = roots(squares(self.points, entries[group]))
                low[:, j], high[:, j] = below.min(1), above.max(1)
        self.low, self.high = low, high
        self.children = [(j, Gnat(entries, g)) for j, g in enumerate(groups) if len(g)]

    @staticmethod
    def spread(entries: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Split points: the first member, then each time the member farthest from those chosen."""
        chosen = [int(members[0])]
        gap = squares(entries[members], entries[chosen])[:, 0]
        while len(chosen) < min(DEGREE, len(members)):
            far = int(gap.argmax())
            if gap[far] <= 0:  # only repeats of chosen points are left
                break
            chosen.append(int(members[far]))
            gap = np.minimum(gap, squares(entries[members], entries[chosen[-1:]])[:, 0])
        return np.array(sorted(chosen))

    def search(self, points: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        """Improve the best squared distance and the entry's index of the rows' points, in place."""
        square = squares(points[rows], self.points)
        nearest = square.argmin(1)  # the lower index of equals, as split points are in order
        least = square[np.arange(len(rows)), nearest]
        entry = self.splits[nearest]
        better = (least < best[rows]) | ((least == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = least[better], entry[better]
        if not self.children:
            return
        below, above = roots(square)
        bound = np.full(square.shape, -np.inf)  # no entry of child j is nearer than bound[:, j]
        with np.errstate(invalid="ignore"):  # an unbounded root less another bounds nothing: fmax passes over NaN
            for i in range(len(self.splits)):
                np.fmax(bound, below[:, i:i + 1] - self.high[i], out=bound)
                np.fmax(bound, self.low[i] - above[:, i:i + 1], out=bound)
        for j, child in self.children:  # the child of the nearest split point first: it brings the best distance down
            own = rows[nearest == j]
            if len(own):
                child.search(points, own, best, index)
        for j, child in self.children:
            _, reach = roots(best[rows])
            left = rows[(nearest != j) & ~(bound[:, j] > reach * WIDER)]
            if len(left):
                child.search(points, left, best, index)


def nearest(trees: list[Gnat], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and squared distance, one column per part, for points cut into parts."""
    indexes, bests = [], []
    width = points.shape[1] // PARTS
    for p, tree in enumerate(trees):
        part = points[:, p * width:(p + 1) * width]
        whole = part.dtype == object or tree.points.dtype == object
        best = np.full(len(part), 1 << 2200 if whole else np.inf, object if whole else np.float64)
        index = np.full(len(part), ENTRIES, np.int64)
        tree.search(part, np.arange(len(part)), best, index)
        indexes.append(index)
        bests.append(best)
    return np.stack(indexes, 1), np.stack(bests, 1)


def scaled(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are kept, and their whole numbers, filled up to ``width``."""
    usable = vectors.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(usable, vectors.value_lengths().fill_null(0).to_numpy(), 0)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    owner = np.repeat(np.arange(len(vectors)), sizes)
    kept = usable.copy()
    kept[owner[~np.isfinite(values)]] = False
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wide = np.zeros((len(vectors), width))
    fits = kept[owner]
    wide[owner[fits], place[fits]] = values[fits]
    wide = wide[kept]
    if width <= LONGEST and (not wide.size or np.abs(wide).max() < EXACT // SCALE):
        return kept, np.floor(wide * SCALE)
    exact = np.empty(wide.shape, object)
    for i, x in np.ndenumerate(wide):
        exact[i] = math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE
    return kept, exact


def book(entries: np.ndarray) -> np.ndarray:
    """Entries as doubles where products stay exact, else as unbounded integers."""
    rows = np.array(entries, dtype=object)
    small = rows.size == 0 or (max(abs(int(v)) for v in rows.flat) <= EXACT and rows.shape[1] * PARTS <= LONGEST + 3)
    return rows.astype(np.float64) if small else rows


def limbs(value: int) -> list[int]:
    """Signed pieces of LIMB bits, the lowest first: Spark adds them up at any size."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value or not out:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def batches(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in table:
        for start in range(0, b.num_rows, ROWS):
            yield b.slice(start, ROWS)


def moved(vectors: DataFrame, books: list[list[list[int]]], width: int) -> list[list[list[int]]]:
    """The codebooks after one round."""
    part = width // PARTS

    def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book(b), np.arange(len(b))) for b in books]
        counts = np.zeros((PARTS, len(books[0])), np.int64)
        sums = np.zeros((PARTS, len(books[0]), part), object)
        for b in batches(table):
            _, points = scaled(b.column("vector"), width)
            index, _ = nearest(trees, points)
            for p in range(PARTS):
                counts[p] += np.bincount(index[:, p], minlength=counts.shape[1])
                own = points[:, p * part:(p + 1) * part]
                if own.dtype == object:
                    np.add.at(sums[p], index[:, p], own)
                    continue
                for c in range(part):  # sums of one batch are whole numbers below 2^53
                    found = np.bincount(index[:, p], weights=own[:, c], minlength=counts.shape[1])
                    sums[p, :, c] += found.astype(np.int64).astype(object)
        used = [(p, e) for p in range(PARTS) for e in range(counts.shape[1]) if counts[p, e]]
        if used:
            yield pa.RecordBatch.from_arrays([
                pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()),
                pa.array([int(counts[u]) for u in used], pa.int64()),
                pa.array([[limbs(int(v)) for v in sums[u]] for u in used], pa.list_(pa.list_(pa.int64())))],
                ["part", "entry", "n", "total"])

    found = vectors.mapInArrow(run, "part int, entry int, n bigint, total array<array<bigint>>")
    counts = found.groupBy("part", "entry").agg(F.sum("n").alias("n"))
    places = found.select("part", "entry", F.posexplode("total").alias("place", "limbs"))
    long = places.select("part", "entry", "place", F.posexplode("limbs").alias("limb", "value"))
    totals = long.groupBy("part", "entry", "place", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
    after = [[list(e) for e in b] for b in books]
    used: dict[tuple, list[int]] = {}
    for r in totals.join(F.broadcast(counts), ["part", "entry"]).collect():  # 256 x width rows, and few more limbs
        used.setdefault((r.part, r.entry, r.place), [0, r.n])[0] += int(r.total) << (LIMB * r.limb)
    for (p, e, place), (total, n) in used.items():
        after[p][e][place] = total // n
    return after


def coded(vectors: DataFrame, books: list[list[list[int]]], width: int) -> DataFrame:
    """vec, label, code, error for every vector that is kept."""
    def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book(b), np.arange(len(b))) for b in books]
        for b in batches(table):
            kept, points = scaled(b.column("vector"), width)
            mask = pa.array(kept)
            index, best = nearest(trees, points)
            yield pa.RecordBatch.from_arrays([
                b.column("vec").filter(mask), b.column("label").filter(mask),
                pa.array(["%02x%02x%02x%02x" % tuple(row) for row in index.tolist()], pa.string()),
                pa.array([min(sum(map(int, row)), MAX) for row in best.tolist()], pa.int64())], ["vec", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInArrow(run, f"vec {kinds['vec']}, label {kinds['label']}, code string, error bigint")


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with the error summed over equal labels, nulls together."""
    sums = codes.groupBy("label").agg(F.count("*").alias("n"), F.least(
        F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MAX)).cast("bigint").alias("label_error"))
    total = codes.count()
    # fewer than HOT labels can each hold more than one row in HOT: these are broadcast, so no task gets a hot label's rows
    often = F.broadcast(sums.where(F.col("n") * HOT > total).select(F.col("label").alias("of"), "label_error"))
    same = F.col("label").eqNullSafe(F.col("of"))
    first = codes.join(often, same, "left").drop("of")
    seldom = sums.where(F.col("n") * HOT <= total).select(F.col("label").alias("of"), F.col("label_error").alias("other"))
    rest = first.where("label_error IS NULL").drop("label_error").join(seldom.hint("shuffle_hash"), same).drop("of")
    return first.where("label_error IS NOT NULL").unionByName(rest.withColumnRenamed("other", "label_error"))


def first_books(vectors: DataFrame, width: int) -> list[list[list[int]]]:
    part = width // PARTS
    whole = F.expr("vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    chosen = vectors.where(whole).orderBy(F.col("vec").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
    if not chosen:
        return [[] for _ in range(PARTS)]
    _, points = scaled(pa.array([r.vector for r in chosen], pa.list_(pa.float64())), width)
    return [[[int(v) for v in row[p * part:(p + 1) * part]] for row in points] for p in range(PARTS)]


def codebooks(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[list[list[list[int]]], int]:
    """Entries by part, and the length that vectors are filled up to, from vec and vector."""
    longest = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    width = PARTS * -(-max(longest, 0) // PARTS)
    books = first_books(vectors, width)
    for _ in range(rounds if books[0] and width else 0):
        books = moved(vectors, books, width)
    return books, width


def digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def product_codes(table: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Key, code (two hex digits a part), error, label_error and codebooks_sha256 for every vector that is kept."""
    vectors = table.select(column(key).alias("vec"), column(vector).cast("array<double>").alias("vector"),
                           column(label).alias("label"))
    books, width = codebooks(vectors)
    root = shared_folder(table.sparkSession, "gnat")
    codes = write(coded(vectors, books, width) if books[0] else coded(vectors.limit(0), books, width), f"{root}/codes")
    return label_errors(codes).select(F.col("vec").alias(key), "code", "error", "label_error",
                                      F.lit(digest(books)).alias("codebooks_sha256"))
