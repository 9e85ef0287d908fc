"""Katz backoff language model of order 2: Good-Turing discounted counts, exactly normalised backoff weights.

Tables of a fitted model, all written by Spark: ``unigrams`` (word, n), ``bigrams`` (bucket, h[], w[], n[]: word numbers
and counts, partitioned by a hash of the pair) and ``histories`` (h, total, alpha). Evaluation is the recursion

    p(w | h) = d(r) * r / total(h)      if the pair was seen r > 0 times in training
             = alpha(h) * p(w)          otherwise
    p(w)     = d(c) * c / N             if the word was seen c > 0 times
             = what the discounts free  for the one unknown word

The ``NUMBERED`` most frequent words (ties at the border left out) have numbers, all others a 64-bit hash. Pairs of numbered words
go by both numbers, pairs with another word by a 64-bit hash of both; every pair has its own count and every word its own history, so
the numbers decide only the path and the model is normalised over every training word and the unknown one. Numbers and weights of
numbered words are arrays of bounded size and go to every task; pair counts and the weights of other words stay in tables. The most
frequent pairs, at most ``FREQUENT`` of them, are looked up where the text is read; all other pairs of the text meet their counts in
buckets. With ``VOCABULARY`` set, words beyond that many share one class instead, whose probability is split among them by p(w).

Defined results: null and empty texts consist of the end token; without training texts every word is unknown with
probability 1; null keys count as training rows; repeated rows are trained on and scored each; an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm.common import column, discard, freeing, numbered, pieces, shared_folder, split_words, write

VOCABULARY: int | None = None   # None: no class of rare words
NUMBERED = 500_000
FREQUENT = 500_000
PER_BUCKET = 1_500_000
PIECE_BYTES = 6 << 20        # of text handled together
PIECE_ROWS = 65_536         # texts handled together; their places fit two bytes
GT_LIMIT = 5                 # counts above it are not discounted
END, OTHER, START, FIRST = 0, 1, 2, 3   # numbers: end token, words without a number, start of text, first word
SHIFT = 20                   # bits of a word number in a pair code
CODE_BYTES = 2 * SHIFT // 8
ENDING = ""                  # the end token in ``unigrams``; words are never empty


def discounts(of_count: dict[int, int], limit: int = GT_LIMIT) -> np.ndarray:
    """Katz's Good-Turing discount for counts 0..limit + 1 (the last stands for all above)."""
    n = [of_count.get(r, 0) for r in range(limit + 2)]
    out = np.ones(limit + 2)
    if not n[1]:
        return out
    common = (limit + 1) * n[limit + 1] / n[1]
    absolute = n[1] / (n[1] + 2 * n[2])
    for r in range(1, limit + 1):
        d = ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.75 * absolute) / r  # small corpora: gaps among the counts of counts
    return out


def pick(table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return table[np.minimum(counts, len(table) - 1)]


class Carried:
    """An object whose fields go to each executor once, however many functions use it."""

    def carry(self, spark: SparkSession):
        self.__dict__["fields"] = spark.sparkContext.broadcast(dict(vars(self)))
        return self

    def leave(self) -> None:
        self.__dict__["fields"].unpersist()

    def __reduce__(self):
        return _arrived, (type(self), self.__dict__["fields"])


def _arrived(kind: type, fields: Broadcast):
    return kind(**fields.value)


@dataclass
class Words(Carried):
    """What every task knows of single words; arrays are indexed by word number."""
    vocabulary: pa.Array
    counts: np.ndarray
    total: int
    types: int
    discount: np.ndarray
    prob: np.ndarray
    unknown: float
    floor: int           # words counted less often have no number
    whole: bool          # words without a number go by their hash, not by class

    def identify(self, numbers: np.ndarray, owners: np.ndarray, flat: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the pairs that hold a word without a number, and what identifies the history and the word of each."""
        rare = np.flatnonzero(numbers == OTHER)
        coded = flat.take(pa.array(rare - owners[rare])).dictionary_encode()  # every text before it added one end
        known = numbers.copy()
        known[rare] = hashes(coded.dictionary)[coded.indices.to_numpy()]
        at = np.union1d(rare, rare + 1)  # an end follows every word
        history = np.where(at > 0, known[at - 1], END)
        return at, np.where(history == END, START, history), known[at]

    def number(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Numbers of all tokens, the text of each, and the words (null for the end)."""
        flat, owners = split_words(texts)
        ends = np.cumsum(np.bincount(owners, minlength=len(texts)) + 1) - 1
        coded = flat.dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.vocabulary), OTHER - FIRST).to_numpy() + FIRST
        out = np.full(len(flat) + len(texts), END, np.int64)
        mask = np.ones(len(out), bool)
        mask[ends] = False
        if len(flat):
            out[mask] = known[coded.indices.to_numpy()]
        holders = np.zeros(len(out), np.int64)
        holders[mask] = owners
        holders[ends] = np.arange(len(texts))
        return out, holders, flat


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes that are below all word numbers."""
    return hash_array(np.array([*words.to_pylist(), None], object)[:-1], categorize=False).astype(np.int64) | np.int64(-1 << 63)


def pair_keys(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs; words after one history never clash."""
    x = history.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) + word.astype(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def train_words(docs: DataFrame, folder: str) -> tuple[DataFrame, Words]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", PIECE_BYTES):
            counted = pc.value_counts(split_words(b.column("text"))[0])
            words, n = counted.field("values"), counted.field("counts")
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([words.cast(pa.string()), pa.array([ENDING])]),
                 pa.concat_arrays([n.cast(pa.int64()), pa.array([b.num_rows], pa.int64())])], ["word", "n"])

    unigrams = write(docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")),
                     f"{folder}/unigrams")
    total, types = unigrams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # words of each count; bounded by the number of different counts, small ones are cut off at the border
    floor = border(unigrams.where(F.col("word") != ENDING), NUMBERED if VOCABULARY is None else VOCABULARY)
    few = {r[0]: r[1] for r in unigrams.where(f"n <= {GT_LIMIT + 1}").groupBy("n").count().collect()}
    held = unigrams.where((F.col("n") >= floor) & (F.col("word") != ENDING)).orderBy("word").toArrow()
    ends = unigrams.where(F.col("word") == ENDING).agg(F.sum("n")).first()[0] or 0
    counts = np.concatenate([[ends, 0, 0], held["n"].to_numpy()]).astype(np.int64)
    discount = discounts(few)
    if not total:
        return unigrams, Words(held["word"].combine_chunks(), counts, 0, 0, discount, np.array([0.0, 1.0, 0.0]), 1.0, floor,
                               VOCABULARY is None)
    # the mass that the discounts free, from the few discounted counts alone; none: as if one more token was seen
    freed = sum(n * r * (1 - discount[r]) for r, n in few.items()) / total
    scale = 1.0 if freed > 0 else total / (total + 1)
    unknown = freed if freed > 0 else 1 / (total + 1)
    prob = scale * pick(discount, counts) * counts / total
    prob[OTHER] = max(1 - prob.sum(), unknown)
    return unigrams, Words(held["word"].combine_chunks(), counts, int(total), int(types), discount * scale, prob, unknown, floor,
                           VOCABULARY is None)


def word_prob(words: Words, n: Column) -> Column:
    """p(w) of a word counted ``n`` times."""
    discount = F.array(*[F.lit(float(d)) for d in words.discount])
    return F.when(n > 0, F.element_at(discount, F.least(n, F.lit(GT_LIMIT + 1)).cast("int") + 1) * n / max(words.total, 1)
                  ).otherwise(F.lit(float(words.unknown)))


def border(counts: DataFrame, most: int) -> int:
    """The smallest count that at most ``most`` rows reach, none above 65 536 told apart."""
    of = counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().collect()
    held, at = 0, (1 << 16) + 1
    for n, rows in sorted(of, reverse=True):
        held += rows
        if held > most:
            break
        at = n
    return at


def pair_codes(numbers: np.ndarray) -> np.ndarray:
    """history << SHIFT | word for each token; a text begins after an end."""
    history = np.empty_like(numbers)
    history[1:] = numbers[:-1]
    history[:1] = END
    return (np.where(history == END, START, history) << SHIFT) | numbers


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (mixed % np.uint64(buckets)).astype(np.int64)


def by_bucket(codes: np.ndarray, buckets: int) -> tuple[pa.Array, list[np.ndarray]]:
    """The buckets that occur, and the places of their codes in the order of the codes."""
    order = np.argsort(codes)
    where = bucket_of(codes, buckets).astype(np.int32)
    order = order[np.argsort(where[order].astype(np.uint16) if buckets <= 1 << 16 else where[order], kind="stable")]
    ends = np.flatnonzero(np.r_[where[order][1:] != where[order][:-1], True]) + 1 if len(order) else []
    parts = [order[i:j] for i, j in zip([0, *ends], ends)]
    return pa.array([where[k[0]] for k in parts], pa.int32()), parts


def pack(numbers: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of the numbers, first all lowest bytes: what sorted numbers share stands together and is compressed."""
    return numbers.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<i8").ravel()


def train_pairs(docs: DataFrame, words: Words, folder: str, buckets: int) -> DataFrame:
    """Counts of all pairs; buckets from ``buckets`` on hold those with a word without a number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "codes", "n"]
        for b in pieces(batches, "text", PIECE_BYTES):
            numbers, owners, flat = words.number(b.column("text"))
            codes = pair_codes(numbers)
            if words.whole:
                at, history, word = words.identify(numbers, owners, flat)
                codes = np.delete(codes, at)
                keys, first, n = np.unique(pair_keys(history, word), return_index=True, return_counts=True)
                history, word = history[first], word[first]
                where, parts = by_bucket(keys, buckets)
                parts = [k[np.lexsort((word[k], history[k]))] for k in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where.to_numpy() + buckets, pa.int32()),
                     pa.array([pack(history[k], 8) + pack(word[k], 8) for k in parts], pa.binary()),
                     pa.array([n[k] for k in parts], pa.list_(pa.int64()))], names)
            codes, n = np.unique(codes, return_counts=True)
            where, parts = by_bucket(codes, buckets)
            yield pa.RecordBatch.from_arrays(
                [where, pa.array([pack(codes[k], CODE_BYTES) for k in parts], pa.binary()),
                 pa.array([n[k] for k in parts], pa.list_(pa.int64()))], names)

    def merge(group: pa.Table) -> pa.Table:
        data, n = group["codes"].to_pylist(), group["n"].combine_chunks().flatten().to_numpy()
        if group["bucket"][0].as_py() < buckets:
            codes = np.concatenate([unpack(c, CODE_BYTES) for c in data])
            h, w = codes >> SHIFT, codes & ((1 << SHIFT) - 1)
        else:
            h, w = (np.concatenate([unpack(half(c), 8) for c in data]) for half in (lambda c: c[:len(c) // 2], lambda c: c[len(c) // 2:]))
        order = np.lexsort((w, h))
        h, w, n = h[order], w[order], n[order]
        heads = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
        longs = pa.list_(pa.int64())
        return pa.table({"bucket": group["bucket"][:1], "h": pa.array([h[heads]], longs), "w": pa.array([w[heads]], longs),
                         "n": pa.array([np.add.reduceat(n, heads)], longs)})

    parts = docs.select("text").mapInArrow(run, "bucket int, codes binary, n array<bigint>")
    return write(parts.groupBy("bucket").applyInArrow(merge, "bucket int, h array<bigint>, w array<bigint>, n array<bigint>"),
                 f"{folder}/bigrams")


@dataclass
class Pairs(Carried):
    """What every task knows of histories and of the most frequent pairs."""
    discount: np.ndarray
    total: np.ndarray     # by history
    log_alpha: np.ndarray
    codes: np.ndarray
    counts: np.ndarray

    def gain(self, codes: np.ndarray, counts: np.ndarray, log_prob: np.ndarray) -> np.ndarray:
        """log10 p of seen pairs, less what backing off would give."""
        h = codes >> SHIFT
        seen = counts > 0
        out = np.zeros(len(codes))
        out[seen] = (np.log10(pick(self.discount, counts[seen]) * counts[seen] / self.total[h[seen]])
                     - self.log_alpha[h[seen]] - log_prob[codes[seen] & ((1 << SHIFT) - 1)])
        return out


def look_up(sorted_codes: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    if not len(sorted_codes):
        return np.zeros(len(codes), np.int64)
    at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    return np.where(sorted_codes[at] == codes, counts[at], 0)


def other_words(unigrams: DataFrame, words: Words, folder: str) -> DataFrame:
    """Words without a number: word, its hash and its count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(hashes(b.column("word"))), b.column("n")], ["word", "h", "n"])

    return write(unigrams.where((F.col("n") < words.floor) & (F.col("word") != ENDING)).select("word", "n")
                 .mapInArrow(run, "word string, h bigint, n bigint"), f"{folder}/others")


def other_pairs(bigrams: DataFrame, others: DataFrame, words: Words, folder: str, buckets: int) -> DataFrame:
    """Pairs with a word without a number: h, w, n and p(w), one row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, w, n = (b.column(c).flatten() for c in ("h", "w", "n"))
            rare = w.to_numpy() < 0
            p = words.prob[np.where(rare, OTHER, w.to_numpy())]
            yield pa.RecordBatch.from_arrays([h, w, n, pa.array(p, mask=rare)], ["h", "w", "n", "p"])

    flat = bigrams.where(F.col("bucket") >= buckets).select("h", "w", "n").mapInArrow(run, "h bigint, w bigint, n bigint, p double")
    counts = others.select(F.col("h").alias("w"), F.col("n").alias("c"))
    rare = flat.where("p IS NULL").join(counts, "w").select("h", "w", "n", word_prob(words, F.col("c")).alias("p"))
    return write(flat.where("p IS NOT NULL").union(rare), f"{folder}/pairs")


def histories(bigrams: DataFrame, pairs: DataFrame, words: Words, folder: str, buckets: int) -> tuple[Pairs, DataFrame]:
    each = bigrams.select(F.explode("n").alias("n"))
    few = {r[0]: r[1] for r in each.where(f"n <= {GT_LIMIT + 1}").groupBy("n").count().collect()}
    narrow = bigrams.where(F.col("bucket") < buckets)
    discount, floor = discounts(few), border(narrow.select(F.explode("n").alias("n")), FREQUENT)
    size = len(words.counts)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, w, n = (b.column(c).flatten().to_numpy() for c in ("h", "w", "n"))
            some = np.unique(h)
            columns = [np.bincount(h, weights, size)[some] for weights in (n, n * pick(discount, n), words.prob[w], np.ones(len(w)))]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *map(pa.array, columns)], ["h", "c", "kept", "covered", "kinds"])

    table = narrow.select("h", "w", "n").mapInArrow(sums, "h bigint, c double, kept double, covered double, kinds double")
    kept = F.element_at(F.array(*[F.lit(float(d)) for d in discount]), F.least("n", F.lit(GT_LIMIT + 1)).cast("int") + 1) * F.col("n")
    table = table.union(pairs.select("h", F.col("n").cast("double"), kept, "p", F.lit(0.0))).groupBy("h").agg(
        *[F.sum(x).alias(x) for x in ("c", "kept", "covered", "kinds")])
    # freed mass over the mass of unseen words; no freed mass: as if the history was seen once more; no unseen
    # word (all numbers but the start of text): the seen ones share the whole
    table = table.selectExpr(
        "h", f"CASE WHEN kinds >= {size - 1} THEN kept WHEN kept < c * (1 - 1e-12) THEN c ELSE c + 1 END AS total",
        f"CASE WHEN kinds >= {size - 1} THEN 1D ELSE IF(kept < c * (1 - 1e-12), 1 - kept / c, 1 / (c + 1)) "
        "/ greatest(1 - covered, 1e-12) END AS alpha")
    table = write(table, f"{folder}/histories")
    held = table.where("h >= 0").toArrow()  # at most one row per word number
    total, alpha = np.ones(size), np.ones(size)
    h = held["h"].to_numpy()
    total[h], alpha[h] = held["total"].to_numpy(), held["alpha"].to_numpy()
    hot = narrow.select(F.explode(F.arrays_zip("h", "w", "n")).alias("p")).selectExpr(
        f"shiftleft(CAST(p.h AS bigint), {SHIFT}) | p.w AS code", "p.n AS n").where(f"n >= {floor}").toArrow()
    codes, counts = hot["code"].to_numpy(), hot["n"].to_numpy()
    order = np.argsort(codes)
    return Pairs(discount, total, np.log10(alpha), codes[order], counts[order]), table


def other_gains(pairs: DataFrame, table: DataFrame, known: Pairs, buckets: int, folder: str) -> DataFrame:
    """For pairs with a word without a number: key, and log10 p less what backing off would give, by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, w, n, p, total, alpha = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "w", "n", "p", "total", "log_alpha"))
            numbered_ = np.where(h >= 0, h, 0)
            total = np.where(h >= 0, known.total[numbered_], total)
            alpha = np.where(h >= 0, known.log_alpha[numbered_], alpha)
            keys = pair_keys(h, w)
            gain = np.log10(pick(known.discount, n) * n / total) - alpha - np.log10(p)
            where, parts = by_bucket(keys, buckets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(where.to_numpy() + buckets, pa.int32()), pa.array([keys[k] for k in parts], pa.list_(pa.int64())),
                 pa.array([gain[k] for k in parts], pa.list_(pa.float64()))], ["bucket", "keys", "gains"])

    weights = table.where("h < 0").select("h", "total", F.log10("alpha").alias("log_alpha"))
    nothing = F.lit(None).cast("double")
    rows = pairs.where("h >= 0").select("*", nothing.alias("total"), nothing.alias("log_alpha")).union(
        pairs.where("h < 0").join(weights, "h").select("h", "w", "n", "p", "total", "log_alpha"))
    return write(rows.mapInArrow(run, "bucket int, keys array<bigint>, gains array<double>"), f"{folder}/other_gains")


@dataclass
class Model:
    unigrams: DataFrame
    bigrams: DataFrame
    words: Words
    pairs: Pairs
    buckets: int
    others: DataFrame    # words without a number: word, n, log_alpha
    gains: DataFrame     # of pairs with such a word


def fit(docs: DataFrame, folder: str, *, text: str = "text") -> Model:
    """Count words and pairs of all ``docs`` and write the tables of the model to ``folder``."""
    with freeing(docs.sparkSession):
        return _fit(docs.select(column(text).alias("text")), folder)


def _fit(plain: DataFrame, folder: str) -> Model:
    unigrams, words = train_words(plain, folder)
    words.carry(plain.sparkSession)
    buckets = max(1, -(-words.total // PER_BUCKET))
    bigrams = train_pairs(plain, words, folder, buckets)
    others = other_words(unigrams, words, folder)
    wide = other_pairs(bigrams, others, words, folder, buckets)
    pairs, table = histories(bigrams, wide, words, folder, buckets)
    pairs.carry(plain.sparkSession)
    gains = other_gains(wide, table, pairs, buckets, folder)
    discard(plain.sparkSession, f"{folder}/pairs")
    weights = table.where("h < 0").select("h", F.log10("alpha").alias("log_alpha"))
    return Model(unigrams, bigrams, words, pairs, buckets, others.join(weights, "h", "left").select("word", "n", "log_alpha"), gains)


def log_probs(words: Words) -> np.ndarray:
    """log10 p(w) by number; what words without a number have of their own is added by a join."""
    out = np.log10(np.maximum(words.prob, 1e-300))
    out[OTHER] = 0.0 if words.whole else out[OTHER]
    return out


def _texts(words: Words, pairs: Pairs):
    """Per text: tokens, known tokens, base and model score of what needs no table, and the words without number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_prob = log_probs(words)
        base = np.log10((words.counts + 1) / (words.total + words.types + 1))
        for b in pieces(batches, "text", PIECE_BYTES):
            numbers, owners, flat = words.number(b.column("text"))
            codes = pair_codes(numbers)
            score = pairs.log_alpha[codes >> SHIFT] + log_prob[numbers]
            score += pairs.gain(codes, look_up(pairs.codes, pairs.counts, codes), log_prob)
            plain, rows = numbers != OTHER, b.num_rows
            add = lambda x, at=slice(None): np.bincount(owners[at], x, rows)
            rare = np.flatnonzero(numbers == OTHER)
            named = flat.take(pa.array(rare - owners[rare]))  # every text before it added one end
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owners[rare], minlength=rows))])
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc"), b.column("train"),
                 pa.array(np.bincount(owners, minlength=rows)),
                 pa.array(add((plain & (words.counts[numbers] > 0)).astype(float)).astype(np.int64)),
                 pa.array(add(base[numbers[plain]], plain)), pa.array(add(score)),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), named)],
                ["row", "doc", "train", "n_tokens", "n_known", "base", "score", "rare"])
    return run


def successive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut batches where the row numbers leap, as they do between stored files."""
    for b in batches:
        cuts = [0, *(np.flatnonzero(np.diff(b.column("row").to_numpy()) != 1) + 1), b.num_rows]
        yield from (b.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if j > i)


def _pairs(words: Words, pairs: Pairs, buckets: int):
    """The other pairs of the texts by bucket, with the place of their text in the piece that begins at row ``first``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(successive(batches), "text", PIECE_BYTES, PIECE_ROWS):
            numbers, owners, flat = words.number(b.column("text"))
            codes = pair_codes(numbers)
            cold = look_up(pairs.codes, pairs.counts, codes) == 0
            if words.whole:
                at, history, word = words.identify(numbers, owners, flat)
                cold[at] = False
                keys = pair_keys(history, word)
                yield bundle(b, buckets, keys, owners[at], 8, buckets)
            yield bundle(b, buckets, codes[cold], owners[cold], CODE_BYTES)

    def bundle(b: pa.RecordBatch, buckets: int, codes: np.ndarray, owners: np.ndarray, width: int, offset: int = 0) -> pa.RecordBatch:
        where, parts = by_bucket(codes, buckets)
        return pa.RecordBatch.from_arrays(
            [pa.array(where.to_numpy() + offset, pa.int32()), pa.array([b.column("row")[0].as_py()] * len(parts), pa.int64()),
             pa.array([pack(codes[k], width) for k in parts], pa.binary()),
             pa.array([pack(owners[k], 2) for k in parts], pa.binary())], ["bucket", "first", "codes", "places"])

    return run


def _meet(words: Words, pairs: Pairs, buckets: int):
    """In a bucket: what the seen pairs add to the texts of each piece."""
    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        log_prob = log_probs(words)
        known, n = np.array([], np.int64), np.array([], np.int64)
        wide = texts.num_rows and texts["bucket"][0].as_py() >= buckets
        if counts.num_rows and wide:
            known, n = (counts[c].combine_chunks().flatten().to_numpy() for c in ("keys", "gains"))
            order = np.argsort(known)
            known, n = known[order], n[order]
        elif counts.num_rows and texts.num_rows:
            h, w, n = (counts[c].combine_chunks().flatten().to_numpy() for c in ("h", "w", "n"))
            known = (h.astype(np.int64) << SHIFT) | w
        places, gains = [], []
        for data, place in zip(texts["codes"].to_pylist(), texts["places"].to_pylist()):
            codes, place = unpack(data, 8 if wide else CODE_BYTES), unpack(place, 2).astype("<u2")
            gain = look_up(known, n, codes) if wide else pairs.gain(codes, look_up(known, n, codes), log_prob)
            texts_, at = np.unique(place, return_inverse=True)
            places.append(texts_.tobytes())
            gains.append(np.bincount(at, gain, len(texts_)).astype("<f8").tobytes())
        return pa.table({"first": texts["first"], "places": pa.array(places, pa.binary()), "gains": pa.array(gains, pa.binary())})
    return run


def _add(piece: pa.Table) -> pa.Table:
    """Sum what the buckets add to the texts of a piece."""
    places = np.frombuffer(b"".join(piece["places"].to_pylist()), "<u2").astype(np.int64)
    total = np.bincount(places, np.frombuffer(b"".join(piece["gains"].to_pylist()), "<f8"))
    some = np.flatnonzero(total)
    return pa.table({"row": piece["first"][0].as_py() + some, "gain": total[some]})


def score(docs: DataFrame, model: Model, folder: str, *, key: str = "doc_id", text: str = "text", train: Column | None = None,
          row: str | None = None) -> DataFrame:
    """Key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every text.

    ``row`` names a column of numbers that tell the rows apart and stay the same however they are read.
    """
    words, pairs = model.words, model.pairs
    plain = docs.select(column(key).alias("doc"), column(text).alias("text"), (F.lit(False) if train is None else train).alias("train"),
                        *([column(row).alias("row")] if row else []))
    if not row:
        plain, row = numbered(plain, f"{folder}/rows")
        plain = plain.withColumnRenamed(row, "row")
    kind = plain.schema["doc"].dataType.simpleString()
    texts = write(plain.mapInArrow(
        _texts(words, pairs), f"row bigint, doc {kind}, train boolean, n_tokens bigint, n_known bigint, base double, "
        "score double, rare array<string>"), f"{folder}/texts")
    parts = plain.select("row", "text").mapInArrow(
        _pairs(words, pairs, model.buckets), "bucket int, first bigint, codes binary, places binary")
    counts = model.bigrams.where(F.col("bucket") < model.buckets).unionByName(model.gains, allowMissingColumns=True)
    gains = write(parts.groupBy("bucket").cogroup(counts.groupBy("bucket"))
                  .applyInArrow(_meet(words, pairs, model.buckets), "first bigint, places binary, gains binary")
                  .groupBy("first").applyInArrow(_add, "row bigint, gain double"), f"{folder}/gains")
    discard(docs.sparkSession, f"{folder}/rows")
    words.leave()
    pairs.leave()
    seen = F.coalesce("n", F.lit(0))
    size = F.lit(float(words.total + words.types + 1))
    share = 0.0 if words.whole else float(np.log10(words.prob[OTHER]))
    more = F.log10(word_prob(words, seen)) - share + F.coalesce("log_alpha", F.lit(0.0))
    rare = texts.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    rare = rare.join(model.others, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10((seen + 1) / size)).alias("more_base"),
        F.sum(F.col("times") * more).alias("more_score"),
        F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("more_known"))
    zero = F.lit(0.0)
    return (texts.join(gains, "row", "left").join(rare, "row", "left").select(
        F.col("doc").alias(key), (~F.col("train")).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("gain", zero) + F.coalesce("more_score", zero)).alias("score")))


def model_scores(docs: DataFrame, *, key: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2, row: str | None = None) -> DataFrame:
    """Train on the rows whose crc32 of the key does not leave ``held`` modulo ``folds``; score all rows."""
    folder = shared_folder(docs.sparkSession, "katz")
    train = F.crc32(F.coalesce(column(key).cast("string"), F.lit("")).cast("binary")) % folds != held
    model = fit(docs.where(train), folder, text=text)
    return score(docs, model, folder, key=key, text=text, train=train, row=row)
