"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints that differ in at most 4 of 64 bits agree in at least 4 of their 8 bytes. The index therefore lists every
distinct fingerprint under each choice of 4 byte positions and the bytes there; fingerprints meeting in a list share at
least 4 positional bytes. The shared bytes of a pair are tallied, pairs reaching the guaranteed minimum are
verified bit by bit. A list that exceeds ``LONG`` is not paired off: its fingerprints instead meet at the midpoints.
Two fingerprints are within 4 bits exactly if some value is within 2 bits of both, so each lists the 2081 values of that ball,
and all under one value are tied to the smallest of them. That work is linear in the length of the list and loses no link.
Connected components follow by alternating star contraction.

Defined results: texts without words (null, empty) have fingerprint 0 and are linked like any other; texts of one to three words
have their whole sequence as the only shingle; null ids are ignored when the smallest id is taken (a component of null
ids has a null id); repeated rows stay rows of their own; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import column, discard, pieces, shared_folder, write

SHINGLE = 4
SEED = 42
MAX_BITS = 4
MIN_BYTES = 4     # of 8: each of the at most 4 differing bits spoils one byte
LONG = 128        # members of a list that are still paired off
CHOICES = list(combinations(range(8), MIN_BYTES))


def fingerprint(text: str | None) -> int:
    """SimHash of the word shingles of one text, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words)]
        shingles = iter(words)
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8160):  # bounded blocks; sums of 255 rows fit a byte
        bits = np.unpackbits(hashes[i:i + 8160].view(np.uint8).reshape(-1, 8), axis=1)
        for j in range(0, len(bits), 255):
            ones += np.add.reduce(bits[j:j + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, fp (signed) for every row."""
    plain = docs.select(column(key).alias("doc"), column(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(fps)], ["doc", "fp"])

    return plain.mapInArrow(run, f"doc {plain.schema['doc'].dataType.simpleString()}, fp bigint")


def postings(nodes: DataFrame) -> DataFrame:
    """key (the choice of positions and the bytes there), fp: one row for each of the 70 choices."""
    byte = [f"(shiftrightunsigned(fp, {8 * i}) & 255L)" for i in range(8)]
    keys = ["(" + " | ".join(f"shiftleft({byte[p]}, {8 * j})" for j, p in enumerate(c)) + f" | shiftleft({n}L, 32))"
            for n, c in enumerate(CHOICES)]
    return nodes.select("fp", F.expr(f"explode(array({', '.join(keys)}))").alias("key"))


def linked(a: str, b: str) -> str:
    """Count filter on shared positional bytes, then the exact test."""
    shared = " + ".join(f"int((shiftrightunsigned({a} ^ {b}, {8 * i}) & 255L) = 0)" for i in range(8))
    return f"{a} <> {b} AND ({shared}) >= {MIN_BYTES} AND bit_count({a} ^ {b}) <= {MAX_BITS}"


def links(nodes: DataFrame, root: str) -> DataFrame:
    """u, v: edges whose components are those of all pairs of fingerprints within 4 bits."""
    # the table of fingerprints is a few small files, its postings are 70 times as many rows: they are spread first
    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = postings(nodes.repartition(spread, "fp"))
    lists = write(index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
                  .where("n > 1"), f"{root}/lists")
    twos = lists.where("n = 2").where(linked("u", "v")).select("u", "v")
    # sizes of stored files say little of their rows, and all these tables grow: every join is a shuffle
    members = write(index.join(lists.where("n > 2").select("key", "n").hint("shuffle_hash"), "key"), f"{root}/members")
    short = members.where(f"n <= {LONG}")
    pairs = (short.select("key", F.col("fp").alias("u")).join(short.select("key", F.col("fp").alias("v")).hint("merge"), "key")
             .where("u < v").where(linked("u", "v")).select("u", "v"))
    flips = [0] + [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i, j in combinations(range(64), 2)]
    signed = ", ".join(f"{f - (1 << 64) if f >= 1 << 63 else f}L" if f != 1 << 63 else "shiftleft(1L, 63)" for f in flips)
    hot = members.where(f"n > {LONG}").select("fp").distinct().repartition(spread, "fp")
    ball = hot.select("fp", F.explode(F.expr(f"array({signed})")).alias("flip")).select(
        "fp", F.expr("fp ^ flip").alias("mid"))
    least = ball.groupBy("mid").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1")
    stars = ball.join(least.hint("merge"), "mid").where("u < fp").select("u", F.col("fp").alias("v"))
    return write(twos.union(pairs).union(stars).distinct(), f"{root}/links")


def components(edges: DataFrame, root: str) -> DataFrame:
    """node, top: for every node of an edge but the smallest of its component, that smallest node."""
    edges, seen, turn = edges.selectExpr("greatest(u, v) AS u", "least(u, v) AS v"), None, 0
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = write(large, f"{root}/large{turn}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        edges = write(small.distinct(), f"{root}/small{turn}")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("top"))
        discard(edges.sparkSession, f"{root}/large{turn}", *([f"{root}/small{turn - 1}"] if turn else []))
        seen, turn = state, turn + 1


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, fingerprint (16 hex digits) and component_id, the smallest key of the component, for every row."""
    spark = docs.sparkSession
    root = shared_folder(spark, "simhash")
    rows = write(fingerprints(docs, key, text), f"{root}/rows")
    nodes = write(rows.groupBy("fp").agg(F.min("doc").alias("doc")), f"{root}/nodes")
    tops = components(links(nodes, root), root)
    discard(spark, *(f"{root}/{name}" for name in ("lists", "members")))
    placed = nodes.join(tops.hint("merge"), nodes["fp"] == tops["node"], "left").select(
        "fp", "doc", F.coalesce("top", "fp").alias("top"))
    first = placed.groupBy("top").agg(F.min("doc").alias("component_id"))
    label = write(placed.join(first.hint("merge"), "top").select("fp", "component_id"), f"{root}/labels")
    discard(spark, f"{root}/links", f"{root}/nodes")
    return rows.join(label.hint("shuffle_hash"), "fp").select(
        F.col("doc").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
