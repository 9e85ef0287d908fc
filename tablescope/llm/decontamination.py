"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are compared lower-cased and without punctuation at their ends. A first pass counts the documents that hold each word triple of
the benchmark. An item's seeds are its rarest triples: a copy that reaches the limit with at most one word in four edited keeps at
least ``0.4 * limit - 2`` of the item's triples, so all triples but that many less one always include a kept one, and the commonest
need not be seeds (for items beyond twice ``LONG_RUN`` words this is counted per stretch). A second pass joins the seeds with the
documents, takes the passage around each group of seeds on nearby diagonals, leaves out passages that share too few words with the
item to reach its limit, and aligns the others with the item. Items come in blocks of bounded size; each block is broadcast and
compared with all documents. A copy with more edits is found when one of the seeds is unchanged.

Defined results: null or empty texts and items match nothing; items of fewer than ``SEED`` words are not searched for; repeated rows and
repeated items are reported each; empty tables give an empty result. Extra columns are ignored. Very long items count as found from
``LONG_RUN`` aligned words on, others from half their words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import column, pieces, shared_folder, split_words, write

SEED = 3
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
SHARE = 0.5           # of an item's words, as alignment score
LONG_RUN = 30.0
LEAST_KEPT = 0.4       # triples kept by the limit's score, less two, at one edit in four words
STRETCH = 46           # triples in the longest such copy that scores LONG_RUN: 48 words
LOOKUPS = 1 << 22      # passage words compared with items at a time
BLOCK_BYTES = 8 << 20  # item text broadcast at a time
BITS = 21              # of a word number; a block holds fewer words than 2 ** BITS
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def plain_words(text: str | None) -> list[str]:
    """Words as they are compared."""
    words = (EDGES.sub("", w.lower()) for w in re.split(r"[\x20\x09-\x0D]+", text or ""))
    return [w for w in words if w]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman with linear gaps: best score, and where in the passage it begins and ends (exclusive)."""
    n = len(passage)
    steps = -GAP * np.arange(n + 1)
    row, start = np.zeros(n + 1), np.arange(n + 1)
    best = (0.0, 0, 0)
    for word in item:
        score = np.where(passage == word, MATCH, MISMATCH)
        cell, origin = np.zeros(n + 1), np.arange(n + 1)
        diagonal, above = row[:-1] + score, row[1:] + GAP
        take = diagonal >= above
        value = np.where(take, diagonal, above)
        came = np.where(take, start[:-1], start[1:])
        live = value > 0
        cell[1:][live], origin[1:][live] = value[live], came[live]
        # gaps in the item: the best cell to the left less its distance
        lead = cell + steps
        top = np.maximum.accumulate(lead)
        where = np.maximum.accumulate(np.where(lead >= top, np.arange(n + 1), 0))
        gapped = top - steps
        better = gapped > cell
        origin = np.where(better, origin[where], origin)
        row, start = np.maximum(cell, gapped), origin
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (float(row[j]), int(start[j]), j)
    return best


class Items:
    """A block of benchmark items: words by number, word triples by code."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        self.numbers: dict[str, int] = {}
        self.words = [np.array([self.numbers.setdefault(w, len(self.numbers)) for w in plain_words(r[1])], np.int64)
                      for r in rows]
        codes = [triples(w) for w in self.words]
        self.codes = np.unique(np.concatenate(codes)) if codes else np.array([], np.int64)
        self.places = [np.searchsorted(self.codes, c) for c in codes]

    def seeds(self, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code, item and position of the triples chosen by ascending document count, sorted by code."""
        chosen = [np.flatnonzero(rarest(frequency[p], self.enough(n), n_words=len(self.words[n]))) for n, p in enumerate(self.places)]
        places = np.concatenate([np.array([], np.int64), *(p[c] for p, c in zip(self.places, chosen))])
        which = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
        position = np.concatenate([np.array([], np.int64), *chosen])
        order = np.argsort(places, kind="stable")
        order = order[frequency[places[order]] > 0]  # others can't be met
        return self.codes[places[order]], which[order], position[order]

    def members(self) -> np.ndarray:
        """Sorted codes of (item, word)."""
        return np.unique(np.concatenate([np.array([], np.int64), *((n << BITS) | w for n, w in enumerate(self.words))]))

    def enough(self, n: int) -> float:
        return min(SHARE * len(self.words[n]), LONG_RUN)


def rarest(frequency: np.ndarray, enough: float, n_words: int) -> np.ndarray:
    """Which triples of an item are seeds, from their document counts; ties leave out the later one."""
    spare = max(0, math.ceil(LEAST_KEPT * enough - 2) - 1)
    width = len(frequency)
    if n_words > 2 * LONG_RUN:  # a copied stretch reaches into two blocks at most
        spare, width = spare // 2, STRETCH
    keep = np.ones(len(frequency), bool)
    for start in range(0, len(frequency) if spare else 0, max(1, width)):
        part = frequency[start:start + width]
        keep[start + np.argsort(part, kind="stable")[max(1, len(part) - spare):]] = False
    return keep


def triples(words: np.ndarray) -> np.ndarray:
    return (words[:-2] << 2 * BITS) | (words[1:-1] << BITS) | words[2:]


def encode(texts: pa.Array, numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all plain words (-1: not in the benchmark), and the text each belongs to."""
    flat, owners = split_words(texts)
    coded = flat.dictionary_encode()
    known = np.array([numbers.get(p, -1) if (p := EDGES.sub("", w.lower())) else -2 for w in coded.dictionary.to_pylist()]
                     or [0], np.int64)
    words = known[coded.indices.to_numpy()]
    real = words > -2
    return words[real], owners[real]


def hits(words: np.ndarray, owners: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose word triple is one of the sorted ``codes``, and which."""
    if len(words) < SEED or not len(codes):
        return np.array([], np.int64), np.array([], np.int64)
    inside = (words[:-2] >= 0) & (words[1:-1] >= 0) & (words[2:] >= 0) & (owners[:-2] == owners[2:])
    at = np.flatnonzero(inside)
    code = (words[at] << 2 * BITS) | (words[at + 1] << BITS) | words[at + 2]
    place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    same = codes[place] == code
    return at[same], place[same]


def frequencies(docs: DataFrame, items: Items) -> np.ndarray:
    """In how many documents each triple of the block occurs; bounded by the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(items.codes), np.int64)
        for b in pieces(batches, "text"):
            words, owners = encode(b.column("text"), items.numbers)
            at, place = hits(words, owners, items.codes)
            once = np.unique(owners[at] * len(items.codes) + place)
            counts += np.bincount(once % max(1, len(items.codes)), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["place", "n"])

    counts = np.zeros(len(items.codes), np.int64)
    for place, n in docs.select("text").mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n")).collect():
        counts[place] = n
    return counts


def passages(items: Items, members: np.ndarray, seeds: tuple[np.ndarray, np.ndarray, np.ndarray], words: np.ndarray,
             owners: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Text, item, first and last word of every passage that shares seeds, and words enough, with an item."""
    codes, which, position = seeds
    single = np.unique(codes)
    lengths = np.array([len(w) for w in items.words], np.int64)
    slack, enough = lengths // 4 + 4, np.minimum(SHARE * lengths, LONG_RUN)
    places, hit = hits(words, owners, single)
    low, high = np.searchsorted(codes, single[hit]), np.searchsorted(codes, single[hit], "right")
    known = np.r_[0, np.cumsum(words >= 0)]
    # texts in turn, so that only the hits of some texts are spread over their items at a time
    spread = np.cumsum(high - low)
    borders = np.flatnonzero(np.r_[True, owners[places[1:]] != owners[places[:-1]]]) if len(places) else np.array([], np.int64)
    before = np.r_[0, spread][borders]
    first = 0
    while first < len(borders):
        after = max(first + 1, int(np.searchsorted(before, before[first] + LOOKUPS, "right")) - 1)
        one, stop = borders[first], borders[after] if after < len(borders) else len(places)
        first = after
        repeats = (high - low)[one:stop]
        entry = np.repeat(low[one:stop], repeats) + ranges(repeats)
        at = np.repeat(places[one:stop], repeats)
        text, item, origin = owners[at], which[entry], at - position[entry]
        order = np.lexsort((origin, item, text))
        text, item, origin = text[order], item[order], origin[order]
        apart = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (np.diff(origin) > slack[item[1:]])
        heads = np.flatnonzero(np.r_[True, apart])
        text, item, last = text[heads], item[heads], origin[np.r_[heads[1:], len(origin)] - 1]
        begin = np.maximum(starts[text], origin[heads] - slack[item])
        end = np.minimum(ends[text], last + lengths[item] + slack[item])
        able = known[end] - known[begin] >= enough[item]
        text, item, begin, end = text[able], item[able], begin[able], end[able]
        able = shared_words(members, words, item, begin, end) >= enough[item]
        yield from zip(text[able].tolist(), item[able].tolist(), begin[able].tolist(), end[able].tolist())


def ranges(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def shared_words(members: np.ndarray, words: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many words of each passage occur in its item: no alignment scores more."""
    shared = np.zeros(len(item), np.int64)
    total = np.cumsum(end - begin)
    first = 0
    while first < len(item):
        base = total[first] - (end - begin)[first]
        stop = max(first + 1, int(np.searchsorted(total, base + LOOKUPS, "right")))
        sizes = (end - begin)[first:stop]
        owner = np.repeat(np.arange(first, stop), sizes)
        word = words[np.repeat(begin[first:stop], sizes) + ranges(sizes)]
        owner, word = owner[word >= 0], word[word >= 0]
        code = (item[owner] << BITS) | word
        found = members[np.minimum(np.searchsorted(members, code), len(members) - 1)] == code
        shared += np.bincount(owner[found], minlength=len(item))
        first = stop
    return shared


def matches(docs: DataFrame, items: Items, seeds: tuple[np.ndarray, np.ndarray, np.ndarray], doc_type: str, item_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = items.members()
        for b in pieces(batches, "text"):
            words, owners = encode(b.column("text"), items.numbers)
            sizes = np.bincount(owners, minlength=b.num_rows)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            for t, i, first, last in passages(items, members, seeds, words, owners, starts, ends):
                passage, item = words[first:last], items.words[i]
                score, begin, end = align(item, passage)
                if score >= items.enough(i) and score > best.get((t, i), (0.0,))[0]:
                    best[t, i] = (score, first + begin - int(starts[t]), first + end - int(starts[t]))
            keys = list(best)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc").take(pa.array([t for t, _ in keys], pa.int64())),
                 pa.array([items.ids[i] for _, i in keys], out_item),
                 pa.array([best[k][0] / len(items.words[k[1]]) for k in keys], pa.float64()),
                 pa.array([best[k][1] for k in keys], pa.int64()), pa.array([best[k][2] for k in keys], pa.int64())],
                ["doc", "item", "score", "start_word", "end_word"])

    out_item = pa.int64() if item_type == "bigint" else pa.int32() if item_type == "int" else pa.string()
    return docs.mapInArrow(run, f"doc {doc_type}, item {item_type}, score double, start_word bigint, end_word bigint")


def contaminated(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text",
                 item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Key, item key, score (share of the item's words), start_word and end_word of every copied item found."""
    spark = docs.sparkSession
    plain = docs.select(column(key).alias("doc"), column(text).alias("text"))
    bench = items.select(column(item_key).alias("item"), column(item_text).alias("text")).where("text IS NOT NULL")
    doc_type, item_type = plain.schema["doc"].dataType.simpleString(), bench.schema["item"].dataType.simpleString()
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) if size else 0
    root = shared_folder(spark, "leaks")
    out = spark.createDataFrame([], f"doc {doc_type}, item {item_type}, score double, start_word bigint, end_word bigint")
    for n in range(blocks):
        held = Items([tuple(r) for r in bench.where(F.expr(f"pmod(xxhash64(item, text), {blocks}) = {n}"))
                      .orderBy("item").collect()])
        found = matches(plain, held, held.seeds(frequencies(plain, held)), doc_type, item_type)
        out = out.union(write(found, f"{root}/block{n}"))
    return out.select(F.col("doc").alias(key), F.col("item").alias(item_key), "score", "start_word", "end_word")
