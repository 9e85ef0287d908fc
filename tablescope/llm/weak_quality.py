"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation over the counts of all
vote patterns estimates how often each labeller is right on good and on bad texts, without any given label. The posterior of a text
then trains a linear scorer on hashed features (words, word shapes, repetition), which judges every whole text.

The estimation uses all texts (their patterns are few: at most 3 to the number of labellers); the scorer is fitted on at most
about ``SAMPLE`` texts, thinned by a hash of the text. Defined results: null and empty texts have one feature of their own; an
empty table gives an empty result; repeated rows are judged each; if all posteriors agree the score is that side. Extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import column, pieces, shared_folder, split_words, write

SAMPLE = 20_000
BUCKETS = 1 << 14
GOOD, BAD, SILENT = 1, 0, 2
ROUNDS = 100
# Frequent function words
FUNCTION_WORDS = frozenset((
    "the of and to in a is that for it was on are as with be by this from at der die und das den von zu ein eine mit sich des auf "
    "für ist im dem nicht als auch la le les de des et un une en du que pour dans est sur au par avec el los las y del se por "
    "con para su al lo").split())
MARKUP = frozenset("#*$%&|<>{}[]\\^~=+_@")
LABELLERS = ["length", "markup", "capitals", "echo", "variety", "sentences", "word_length", "function_words"]


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as one sign each; other signs as they are, runs cut to one."""
    signs = map(sign, word)
    return "".join(s for s, _ in groupby(signs))


def sign(c: str) -> str:
    return "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c


def votes(n: np.ndarray, markup: np.ndarray, capitals: np.ndarray, echo: np.ndarray, variety: np.ndarray, stops: np.ndarray,
          letters: np.ndarray, common: np.ndarray) -> np.ndarray:
    """One column per labeller, from per-text shares."""
    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, BAD, np.where(good, GOOD, SILENT))
    long = n >= 20
    return np.stack([
        vote(n < 3, n >= 50), vote(markup > 0.10, markup < 0.02), vote(long & (capitals > 0.3), capitals < 0.1),
        vote(long & (echo > 0.1), echo < 0.02), vote((n >= 50) & (variety < 0.5), variety > 0.8),
        vote(long & ((stops < 0.01) | (stops > 0.5)), (stops > 0.02) & (stops < 0.35)),
        vote(long & ((letters < 2.5) | (letters > 12)), (letters > 3.5) & (letters < 9)), vote(long & (common < 0.08), common > 0.15)], axis=1)


def read(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Per-token codes and owners, the distinct words, tokens that repeat the one before, and votes of a batch."""
    flat, owners = split_words(batch.column("text"), lower=False)
    coded = flat.dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    rows = batch.num_rows
    marks = np.array([sum(c in MARKUP for c in w) for w in words] or [0], float)
    upper = np.array([w.isupper() and sum(map(str.isalpha, w)) > 1 for w in words] or [0], float)
    ends = np.array([w.rstrip("\"')")[-1:] in tuple(".!?") for w in words] or [0], float)
    sizes = np.array([sum(map(str.isalpha, w)) for w in words] or [0], float)
    common = np.array([w.lower() in FUNCTION_WORDS for w in words] or [0], float)
    echo = np.zeros(len(codes))
    if len(codes) > 1:
        echo[1:] = (codes[1:] == codes[:-1]) & (owners[1:] == owners[:-1])
    n = np.bincount(owners, minlength=rows)
    share = lambda x: np.bincount(owners, x, rows) / np.maximum(n, 1)
    # different words per word, held against what a text of that length shows (Heaps' law, exponent 0.9)
    kinds = np.bincount(np.unique(owners * max(1, len(words)) + codes) // max(1, len(words)), minlength=rows) if len(codes) else np.zeros(rows)
    variety = kinds / np.maximum(n, 1) ** 0.9
    ballot = votes(n, share(marks[codes]), share(upper[codes]), share(echo), variety, share(ends[codes]), share(sizes[codes]), share(common[codes]))
    return codes, words, owners, echo, ballot


def token_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a word and of its shape."""
    bucket = lambda x: xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) % BUCKETS
    shapes: dict[str, int] = {}
    by_shape = [shapes[s] if (s := shape(w)) in shapes else shapes.setdefault(s, bucket("shape " + s)) for w in words]
    return np.array([bucket(w.lower()) for w in words] or [0], np.int64), np.array(by_shape or [0], np.int64)


ECHO, NOTHING = (xxhash.xxh64_intdigest(x) % BUCKETS for x in (b"shape ==", b"shape nothing"))


def ballots(docs: DataFrame) -> DataFrame:
    """doc, pick (0 to 1, by text), and the vote pattern of every text as one number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            pattern = read(b)[4] @ (3 ** np.arange(len(LABELLERS)))
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(pattern.astype(np.int64))], ["doc", "pattern"])
    return docs.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, pattern bigint")


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good per pattern, each labeller's rate of good votes on bad and on good texts, share of good texts."""
    table = (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    good, bad = table == GOOD, table == BAD
    posterior = (good.sum(1) + 1) / (good.sum(1) + 8 * bad.sum(1) + 1.2)  # start: one bad vote outweighs several good ones
    rates, prior = np.zeros((2, len(LABELLERS))), 0.5
    for _ in range(ROUNDS):
        prior = float((counts @ posterior + 9) / (counts.sum() + 10))
        for side, weight in ((1, counts * posterior), (0, counts * (1 - posterior))):
            # prior counts: labellers are right nine times in ten on good texts, on bad ones they often see nothing wrong
            rates[side] = (weight @ good + (9 if side else 2)) / (weight @ (good | bad) + (10 if side else 4))
        odds = np.log(prior / (1 - prior)) + good @ np.log(rates[1] / rates[0]) + bad @ np.log((1 - rates[1]) / (1 - rates[0]))
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done = np.abs(new - posterior).max(initial=0) < 1e-9
        posterior = new
        if done:
            break
    return posterior, rates, prior


def vectors(docs: DataFrame) -> DataFrame:
    """pattern, buckets and shares of the (sampled) texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            codes, words, owners, echo, ballot = read(b)
            by_word, by_shape = token_features(words)
            spots, shares = [], []
            ends = np.cumsum(np.bincount(owners, minlength=b.num_rows))
            for first, last in zip(np.r_[0, ends[:-1]], ends):
                mine = codes[first:last]
                all_ = np.r_[by_word[mine], by_shape[mine], np.full(int(echo[first:last].sum()), ECHO)] if last > first else np.array([NOTHING])
                at, n = np.unique(all_, return_counts=True)
                spots.append(at.astype(np.int32))
                shares.append(n / max(1, last - first))
            pattern = ballot @ (3 ** np.arange(len(LABELLERS)))
            yield pa.RecordBatch.from_arrays([pa.array(pattern.astype(np.int64)), pa.array(spots, pa.list_(pa.int32())),
                                              pa.array(shares, pa.list_(pa.float64()))], ["pattern", "spots", "shares"])
    return docs.select("text").mapInArrow(run, "pattern bigint, spots array<int>, shares array<double>")


def scores(docs: DataFrame, weights: np.ndarray, intercept: float, posterior: dict[int, float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            codes, words, owners, echo, ballot = read(b)
            by_word, by_shape = token_features(words)
            value = weights[by_word] + weights[by_shape]
            n = np.bincount(owners, minlength=b.num_rows)
            margin = np.bincount(owners, value[codes] + echo * weights[ECHO], b.num_rows) / np.maximum(n, 1)
            margin = np.where(n > 0, margin, weights[NOTHING]) + intercept
            pattern = ballot @ (3 ** np.arange(len(LABELLERS)))
            belief = [posterior[p] for p in pattern.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(belief, pa.float64()), pa.array(1 / (1 + np.exp(-np.clip(margin, -50, 50))))],
                                             ["doc", "posterior", "score"])
    return docs.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, posterior double, score double")


def weak_quality(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, posterior (of the weak labels), score (of the trained scorer) and kept for every text."""
    spark = docs.sparkSession
    root = shared_folder(spark, "weak")
    plain = docs.select(column(key).alias("doc"), column(text).alias("text"))
    counted = ballots(plain).groupBy("pattern").count().collect()  # at most 3 ** len(LABELLERS) rows
    patterns, counts = (np.array([r[i] for r in counted], np.int64) for i in (0, 1))
    believed, _, prior = estimate(patterns, counts.astype(float))
    posterior = dict(zip(patterns.tolist(), believed.tolist()))
    rate = min(1.0, SAMPLE / max(1, int(counts.sum())))
    picked = plain.where(F.xxhash64("doc", F.octet_length("text")).cast("double") / 2.0 ** 64 + 0.5 < rate)
    sample = write(vectors(picked), f"{root}/sample")
    weights, intercept = np.zeros(BUCKETS), float(np.log(prior / (1 - prior))) if len(patterns) else 0.0
    if len(patterns) and believed.min() < 0.5 <= believed.max():
        sparse = F.udf(lambda at, x: Vectors.sparse(BUCKETS, at, x), VectorUDT())
        table = spark.createDataFrame([(int(p), float(b)) for p, b in posterior.items()], "pattern bigint, belief double")
        rows = sample.join(F.broadcast(table), "pattern").select(sparse("spots", "shares").alias("features"), "belief")
        both = rows.withColumn("label", F.lit(1.0)).withColumn("weight", F.col("belief")).union(
            rows.withColumn("label", F.lit(0.0)).withColumn("weight", 1 - F.col("belief"))).where("weight > 0.001")
        model = LogisticRegression(weightCol="weight", regParam=1e-6, standardization=False, maxIter=100).fit(both)
        weights, intercept = model.coefficients.toArray(), float(model.intercept)
    return scores(plain, weights, intercept, posterior).select(
        F.col("doc").alias(key), "posterior", "score", (F.col("score") >= 0.5).alias("kept"))
