"""Inputs the corpus tests share."""

import random

WORDS = "alpha beta gamma delta river stone cloud forest meadow lantern copper window garden harbor silver".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, size int, score string, _row int, shard string, n int"


def prose(seed: int, n: int, words=WORDS) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows, copies, clashing extra columns."""
    long_text = prose(99, 20_000)
    rows = [
        (1, None, "en", "a", 7, "x", 0, "s", 1), (2, "", None, None, None, None, None, None, None),
        (3, " \t\n ", "en", "a", 7, "x", 0, "s", 1), (4, "one", "en", "b", 7, "x", 0, "s", 1),
        (None, prose(5, 40), "en", "b", 7, "x", 0, "s", 1), (6, long_text, "de", None, 7, "x", 0, "s", 1),
        (7, prose(7, 60), "en", "a", 7, "x", 0, "s", 1), (7, prose(7, 60), "en", "a", 7, "x", 0, "s", 1),
        (8, prose(7, 60), "en", "a", 7, "x", 0, "s", 1), (9, "\n".join([prose(9, 12)] * 3), "en", "c", 7, "x", 0, "s", 1)]
    return rows


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
