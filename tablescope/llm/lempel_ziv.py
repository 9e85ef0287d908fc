"""Substring dedup by relative Lempel-Ziv parsing of all documents against the indexed earlier text.

Documents are put in order of their keys and cut into batches of bounded size. The reference is all text before a position,
indexed by its windows of 20 words and split by hash into blocks of bounded size. Each document is factored greedily against
every block: at a position the index names an earlier place with the same 20 words, and the factor runs on as long as the words
after both stay equal. Where a factor ends, the windows across its end are looked up too, so a factor that begins inside
the last one is found. Words under a factor are removed. Windows are judged on the input, not on what is left.

Two things keep the index small. A window is only indexed if its seed (the least hash among its 13 runs of 8 words) occurs at
two places, since equal windows have equal seeds. And a batch sends each different window once, its first place; later
places in the batch point at that one, so a passage that a third of all documents share is as many rows as there are batches.

Windows are equal if two independent hashes are: 64 bits kept, and the one that chooses the block.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text has none and keeps the empty string; documents come
in order of their keys, nulls first, and rows of one key in order of their text, so the second of two equal rows is a copy
of the first; an empty table gives an empty result; extra columns are ignored. One text is one cell and is held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import column, discard, shared_folder, split_words, write

WINDOW = 20               # words of a window
SEED = 8                  # words of a seed
BATCH = 8 << 20           # bytes of text of a batch, exceeded only by a longer text
BLOCK = 2_000_000         # windows or seeds of a block of the index, about
ROOT, CHECK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd factors of the two window hashes


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word; each different word is hashed once."""
    coded = words.dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w.as_buffer()) for w in coded.dictionary], np.uint64)
    return known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def runs(h: np.ndarray, width: int, root: np.uint64) -> np.ndarray:
    """Polynomial hash of every ``width`` successive values, put together from runs of powers of two."""
    done, power = None, h
    factor, size, bits = np.array([root]), 1, width  # arrays wrap round without a warning
    out_size = 0
    while bits:
        if bits & 1:
            if done is None:
                done, out_size = power, size
            else:
                n = len(h) - out_size - size + 1
                done = done[:n] * factor + power[out_size:out_size + n]
                out_size += size
        bits >>= 1
        if bits:
            n = len(power) - size
            power = power[:n] * factor + power[size:]
            factor, size = factor * factor, size * 2
    return done


class Batch:
    """The words of the documents of one batch as arrays; ``starts`` are the places where a window fits."""

    def __init__(self, texts: pa.Array):
        self.words, owners = split_words(texts, lower=False)
        self.sizes = np.bincount(owners, minlength=len(texts))
        h = word_hashes(self.words)
        if len(h) < WINDOW:
            self.starts, self.key, self.check, self.seed, self.at = (np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 3,
                                                                    np.zeros(0, np.int64))
            return
        self.starts = np.flatnonzero(owners[:-WINDOW + 1] == owners[WINDOW - 1:])
        self.key = mixed(runs(h, WINDOW, ROOT))
        self.check = mixed(runs(h, WINDOW, CHECK))
        value = mixed(runs(h, SEED, ROOT))
        at, span = np.arange(len(value)), 1
        while span < WINDOW - SEED + 1:  # the least seed of 1, 2, 4, 8 and at last 13 places; the left one of equals
            step = min(span, WINDOW - SEED + 1 - span)
            right = value[step:] < value[:-step]
            value, at = np.where(right, value[step:], value[:-step]), np.where(right, at[step:], at[:-step])
            span += step
        self.seed, self.at = value[self.starts], at[self.starts]

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """The different seeds, and at how many places each is the seed of windows."""
        if not len(self.starts):
            return self.seed, np.zeros(0, np.int64)
        new = np.flatnonzero(np.diff(self.at, prepend=-1))
        return np.unique(self.seed[new], return_counts=True)


def batches(table: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each batch number; rows of a batch follow each other."""
    held, number = [], None
    for b in table:
        numbers = b.column("batch").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for start, stop in zip(cuts[:-1], cuts[1:]):
            if stop == start:
                continue
            if held and numbers[start] != number:
                yield number, pa.Table.from_batches(held)
                held = []
            number = int(numbers[start])
            held.append(b.slice(start, stop - start))
    if held:
        yield number, pa.Table.from_batches(held)


def split(blocks: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """block and its part of every column, for each block that occurs."""
    order = np.argsort(blocks, kind="stable")
    blocks = blocks[order]
    cuts = np.flatnonzero(np.diff(blocks, prepend=-1, append=-1)) if len(blocks) else []
    columns = [c[order] for c in columns]
    for start, stop in zip(cuts[:-1], cuts[1:]):
        yield (int(blocks[start]), *(c[start:stop] for c in columns))


def joined(values: pa.ChunkedArray, dtype) -> np.ndarray:
    """The arrays that binary cells hold, one after the other."""
    return np.frombuffer(b"".join(v.as_py() for v in values), dtype)


def lengths(values: pa.ChunkedArray, width: int) -> np.ndarray:
    return pc.fill_null(pc.binary_length(values), 0).to_numpy() // width


def flat(values: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], values.type)


def ordered_rows(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """batch, base, doc, text, n: all rows in order of their keys, written once.

    ``base`` is the place of the first word in the whole ordered text; ``batch`` is the base of the first row of the batch.
    """
    plain = docs.select(column(key).alias("doc"), column(text).cast("string").alias("text"))
    # equal rows are told apart by the scan, so that they spread; which of two equal rows comes first doesn't matter
    keyed = plain.withColumn("hash", F.xxhash64("text")).withColumn("spread", F.monotonically_increasing_id())
    keys = ["doc", "hash", "text", "spread"]
    laid = keyed.repartitionByRange("doc", "hash", "spread").sortWithinPartitions(*keys).select("doc", "text")

    def number(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        batch, size = place, 0
        for b in table:
            n = np.bincount(split_words(b.column("text"), lower=False)[1], minlength=b.num_rows)
            bytes_ = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy()
            base, marks = place + np.cumsum(n) - n, np.zeros(b.num_rows, np.int64)
            for i, width in enumerate(bytes_.tolist()):
                if size and size + width > BATCH and base[i] > batch:
                    batch, size = int(base[i]), 0
                size += width
                marks[i] = batch
            place += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(marks), pa.array(base), b.column("doc"), b.column("text"),
                                              pa.array(n.astype(np.int64))], ["batch", "base", "doc", "text", "n"])

    kind = plain.schema["doc"].dataType.simpleString()
    return write(laid.mapInArrow(number, f"batch bigint, base bigint, doc {kind}, text string, n bigint"), path)


def repeated_seeds(rows: DataFrame, blocks: int) -> DataFrame:
    """batch, seeds: the seeds of a batch that occur in another batch as well."""
    def send(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in batches(table):
            seeds, _ = Batch(flat(part.column("text"))).seeds()
            found = list(split((seeds % np.uint64(blocks)).astype(np.int64), seeds))
            yield pa.RecordBatch.from_pydict({
                "block": [f[0] for f in found], "batch": [number] * len(found), "seeds": [f[1].tobytes() for f in found]},
                pa.schema([("block", pa.int64()), ("batch", pa.int64()), ("seeds", pa.binary())]))

    def meet(table: pa.Table) -> pa.Table:
        seeds, owner = joined(table.column("seeds"), np.uint64), np.repeat(
            np.arange(table.num_rows), lengths(table.column("seeds"), 8))
        order = np.argsort(seeds, kind="stable")
        same = np.diff(seeds[order]) == 0
        again = np.zeros(len(seeds), bool)
        again[1:] = same
        again[:-1] |= same
        kept = np.sort(order[again])
        found = list(split(owner[kept], seeds[kept]))
        numbers = table.column("batch").to_pylist()
        return pa.table({"batch": pa.array([numbers[f[0]] for f in found], pa.int64()),
                         "seeds": pa.array([f[1].tobytes() for f in found], pa.binary())})

    sent = rows.select("batch", "text").mapInArrow(send, "block bigint, batch bigint, seeds binary")
    return sent.groupBy("block").applyInArrow(meet, "batch bigint, seeds binary")


INDEX = "block bigint, batch bigint, place binary, key binary, source binary"


def index_entries(rows: DataFrame, seeds: DataFrame, blocks: int) -> DataFrame:
    """Per batch and block the windows to index (place, key), and once per batch those found in the batch itself (place, source)."""
    def send(key: tuple, texts: pa.Table, marks: pa.Table) -> pa.Table:
        number = key[0].as_py()
        texts = texts.sort_by("base")
        held = Batch(flat(texts.column("text")))
        own, count = held.seeds()
        known = np.unique(np.concatenate([own[count > 1], joined(marks.column("seeds"), np.uint64)]))
        if not len(known):
            return pa.Table.from_pylist([], ARROW_INDEX)
        near = np.minimum(np.searchsorted(known, held.seed), len(known) - 1)
        starts = held.starts[known[near] == held.seed]
        keys = held.key[starts]
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = np.diff(keys[order]) != 0
        first = np.empty(len(keys), np.int64)
        first[order] = order[new][np.cumsum(new) - 1] if len(keys) else order
        # two windows of a batch with one key but other words: the second hash tells
        alone = (first == np.arange(len(keys))) | (held.check[starts] != held.check[starts[first]])
        copies, fresh = ~alone, starts[alone]
        found = [(b, number, place.astype(np.uint32).tobytes(), k.tobytes(), None) for b, place, k in split(
            (held.check[fresh] % np.uint64(blocks)).astype(np.int64), fresh, held.key[fresh])]
        if copies.any():
            found.append((number % blocks, number, starts[copies].astype(np.uint32).tobytes(), None,
                          (number + starts[first[copies]]).astype(np.int64).tobytes()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), ARROW_INDEX)], schema=ARROW_INDEX) \
            if found else pa.Table.from_pylist([], ARROW_INDEX)

    texts = rows.select("batch", "base", "text")
    return texts.groupBy("batch").cogroup(seeds.groupBy("batch")).applyInArrow(send, INDEX)


ARROW_INDEX = pa.schema([("block", pa.int64()), ("batch", pa.int64()), ("place", pa.binary()), ("key", pa.binary()),
                         ("source", pa.binary())])


def looked_up(entries: DataFrame) -> DataFrame:
    """batch, place, source: the windows that occur earlier, and the first place in the text where each does."""
    def meet(table: pa.Table) -> pa.Table:
        local = table.filter(table.column("source").is_valid()).select(["batch", "place", "source"])
        table = table.filter(table.column("key").is_valid()).sort_by("batch")
        if not table.num_rows:
            return local
        keys, places = joined(table.column("key"), np.uint64), joined(table.column("place"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(table.num_rows), lengths(table.column("key"), 8))
        numbers = table.column("batch").to_numpy()
        order = np.argsort(keys, kind="stable")  # places rise within and over batches, so the first of equals is the earliest
        new = np.ones(len(keys), bool)
        new[1:] = np.diff(keys[order]) != 0
        first = np.empty(len(keys), np.int64)
        first[order] = order[new][np.cumsum(new) - 1]
        copies = np.flatnonzero(first != np.arange(len(keys)))
        source = (numbers[owner] + places)[first[copies]]
        found = list(split(owner[copies], places[copies], source))
        remote = pa.table({"batch": pa.array([int(numbers[f[0]]) for f in found], pa.int64()),
                           "place": pa.array([f[1].astype(np.uint32).tobytes() for f in found], pa.binary()),
                           "source": pa.array([f[2].tobytes() for f in found], pa.binary())})
        return pa.concat_tables([local, remote])

    return entries.groupBy("block").applyInArrow(meet, "batch bigint, place binary, source binary")


def factors(places: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and source of the greedy factors from the found windows, in order.

    A factor goes on while the next window is found one place further in the same source. The window at which it
    stops going on lies across its end; if that window was found, the next factor begins there.
    """
    if not len(places):
        return places, places, sources
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(places) != 1) | (np.diff(sources) != 1)]))
    ends = np.concatenate([begins[1:], [len(places)]])
    return places[begins], ends - begins + WINDOW - 1, sources[begins]


def parsed(docs: DataFrame, key: str, text: str, finish, schema: str) -> tuple[DataFrame, str]:
    """``finish(texts, held, start, length, source)`` for every batch: its rows, its words, its factors."""
    spark = docs.sparkSession
    root = shared_folder(spark, "lempel-ziv")
    rows = ordered_rows(docs, key, text, f"{root}/rows")
    total = rows.agg(F.sum("n")).first()[0] or 0
    seeds = write(repeated_seeds(rows, 1 + total // (BLOCK * 4)), f"{root}/seeds")
    found = write(looked_up(index_entries(rows, seeds, 1 + total // BLOCK)), f"{root}/found")
    discard(spark, f"{root}/seeds")

    def parse(number: tuple, texts: pa.Table, hits: pa.Table) -> pa.Table:
        texts = texts.sort_by("base")
        held = Batch.__new__(Batch)
        held.words, owners = split_words(flat(texts.column("text")), lower=False)
        held.sizes = np.bincount(owners, minlength=texts.num_rows)
        places, sources = joined(hits.column("place"), np.uint32).astype(np.int64), joined(hits.column("source"), np.int64)
        order = np.argsort(places, kind="stable")
        return finish(texts, held, *factors(places[order], sources[order]))

    return rows.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(parse, schema), root


def kept_texts(held: Batch, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Per text the number of words that no factor covers, and these words joined by one space."""
    edge = np.zeros(len(held.words) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    keep = np.cumsum(edge[:-1]) == 0
    bounds = np.concatenate([[0], np.cumsum(held.sizes)])
    ends = np.concatenate([[0], np.cumsum(keep)])[bounds]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held.words.filter(pa.array(keep)))
    return np.diff(ends), pc.binary_join(lists, " ")


def distinct_words(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_words, n_removed, kept_sha256 (of the kept words, joined by one space), n_factors, longest (words), per row."""
    kind = docs.select(column(key).alias("doc")).schema["doc"].dataType.simpleString()

    def finish(texts: pa.Table, held: Batch, start: np.ndarray, length: np.ndarray, source: np.ndarray) -> pa.Table:
        kept, joined_words = kept_texts(held, start, length)
        owner = np.searchsorted(np.cumsum(held.sizes), start, "right")
        longest = np.zeros(texts.num_rows, np.int64)
        np.maximum.at(longest, owner, length)
        return pa.table({
            "doc": flat(texts.column("doc")), "n_words": pa.array(held.sizes.astype(np.int64)),
            "n_removed": pa.array((held.sizes - kept).astype(np.int64)),
            "kept_sha256": pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in joined_words], pa.string()),
            "n_factors": pa.array(np.bincount(owner, minlength=texts.num_rows).astype(np.int64)), "longest": pa.array(longest)})

    done, _ = parsed(docs, key, text, finish, f"doc {kind}, n_words bigint, n_removed bigint, kept_sha256 string, "
                                              "n_factors bigint, longest bigint")
    return done.withColumnRenamed("doc", key)


def distinct_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and the text without its copied words, for every row."""
    kind = docs.select(column(key).alias("doc")).schema["doc"].dataType.simpleString()

    def finish(texts: pa.Table, held: Batch, start: np.ndarray, length: np.ndarray, source: np.ndarray) -> pa.Table:
        return pa.table({"doc": flat(texts.column("doc")), "text": kept_texts(held, start, length)[1]})

    return parsed(docs, key, text, finish, f"doc {kind}, text string")[0].withColumnsRenamed({"doc": key, "text": text})


def duplicate_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, start, length: the factors of every row, in words; source: the place of the copied words in the whole ordered text,
    base: the place of the row's own first word there."""
    kind = docs.select(column(key).alias("doc")).schema["doc"].dataType.simpleString()

    def finish(texts: pa.Table, held: Batch, start: np.ndarray, length: np.ndarray, source: np.ndarray) -> pa.Table:
        ends = np.cumsum(held.sizes)
        owner = np.searchsorted(ends, start, "right")
        return pa.table({"doc": flat(texts.column("doc")).take(pa.array(owner)), "start": pa.array(start - (ends - held.sizes)[owner]),
                         "length": pa.array(length.astype(np.int64)), "source": pa.array(source),
                         "base": pa.array(flat(texts.column("base")).to_numpy()[owner])})

    return parsed(docs, key, text, finish, f"doc {kind}, start bigint, length bigint, source bigint, base bigint")[
        0].withColumnRenamed("doc", key)
