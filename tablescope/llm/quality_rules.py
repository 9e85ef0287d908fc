"""Quality rules: distribution divergence, in DataFrame and SQL functions only.

A document's histograms of character classes and of common words are compared with those of its language, taken over
all documents of that language, by the Jensen-Shannon distance (base 2, 0 to 1). A document is rejected when it fails the
base rules or when a distance exceeds its limit; a distance counts only for documents and languages long enough for it.

Defined results: a null or wordless text has no words, fails the base rules and has null distances; a null language is a language of
its own; repeated rows are judged one by one; an empty table gives an empty result. Extra columns are
ignored. Five-word windows are compared by a 64-bit hash of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.common import column, discard, numbered, shared_folder, write

SPACE = " \\t-\\r"
# what each class removes from what the classes before it left; the rest is "other"
CLASSES = [("lower", "[\\p{Ll}\\p{Lo}\\p{Lm}\\p{M}]+"), ("space", f"[{SPACE}]+"), ("upper", "[\\p{Lu}\\p{Lt}]+"),
           ("digit", "\\p{Nd}+"), ("stop", "[.,;:!?'\"()\\-]+"), ("cell", "[|]+"), ("symbol", "[#*$%&<>]+")]
COMMON = 32            # common words of a language
WINDOW = 5
CHAR_LIMIT, CHAR_GUARD = 0.30, 200    # distance of character classes, characters needed
WORD_LIMIT, WORD_GUARD = 0.42, 60     # distance of common words, words needed
LANGUAGE_GUARD = 2000                 # words a language needs to be a reference


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def common_words(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """ref_lang, word, share, total: its most frequent words, lower-cased, and their shares in all documents."""
    words = docs.select(column(lang).alias("ref_lang"), F.explode(words_of(F.lower(column(text)))).alias("word"))
    counts = words.groupBy("ref_lang", "word").count()
    totals = counts.groupBy("ref_lang").agg(F.sum("count").alias("total"))
    rank = F.row_number().over(Window.partitionBy("ref_lang").orderBy(F.desc("count"), "word"))
    top = counts.withColumn("rank", rank).where(f"rank <= {COMMON}").withColumnRenamed("ref_lang", "_lang")
    top = top.join(totals, F.col("_lang").eqNullSafe(F.col("ref_lang")))
    return top.select("ref_lang", "word", (F.col("count") / F.col("total")).alias("share"), "total")


def repeated_words() -> Column:
    """Words in windows (``codes``) that occur at least twice in the text, the first occurrence included."""
    pairs = "array_sort(transform(codes, (c, i) -> struct(c AS c, i AS i)))"
    hit = ("filter(transform(p, (x, j) -> CASE WHEN (j > 0 AND p[j - 1].c = x.c) OR (j < size(p) - 1 AND p[j + 1].c = x.c) "
           "THEN x.i END), i -> i IS NOT NULL)")
    # positions in order; each adds what the windows before it did not cover
    covered = (f"aggregate(array_sort(flatten(transform(array({pairs}), p -> {hit}))), struct(0L AS t, 0L AS e), "
               f"(a, i) -> struct(a.t + i + {WINDOW}L - greatest(a.e, CAST(i AS bigint)) AS t, i + {WINDOW}L AS e), a -> a.t)")
    return F.expr(f"CASE WHEN size(array_distinct(codes)) < size(codes) THEN {covered} ELSE 0L END")


def term(p: Column, q: Column) -> Column:
    """What one class adds to the Jensen-Shannon divergence (base 2)."""
    part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return 0.5 * (part(p) + part(q))


def root_of(divergence: Column) -> Column:
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def document_stats(docs: DataFrame, *, key: str, text: str, lang: str) -> DataFrame:
    """Base numbers and character classes (c0, c1, ...) of every document."""
    steps = docs.select(column(key).alias("doc"), column(lang).alias("lang"), F.coalesce(column(text), F.lit("")).alias("body"))
    steps = steps.withColumn("words", words_of(F.col("body"))).withColumn("n_words", F.size("words").cast("long"))
    steps = steps.withColumn("codes", F.expr(
        f"CASE WHEN n_words >= {WINDOW} THEN transform(array(transform(words, w -> xxhash64(w))), h -> "
        f"transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({', '.join(f'h[i + {k}]' for k in range(WINDOW))})))[0] "
        "ELSE array() END"))
    steps = steps.withColumn("lines", F.expr(
        "filter(split(body, '\\n'), l -> trim(BOTH ' \\t\\n\\u000b\\f\\r' FROM l) <> '')"))
    steps = steps.withColumn("left0", F.col("body"))
    sizes = []
    for n, (_, pattern) in enumerate(CLASSES):
        steps = steps.withColumn(f"left{n + 1}", F.regexp_replace(f"left{n}", pattern, ""))
        sizes.append(F.length(f"left{n}") - F.length(f"left{n + 1}"))
    sizes.append(F.length(f"left{len(CLASSES)}"))
    return steps.select(
        "doc", "lang", "n_words", F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("body", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words().alias("n_repeat_words"), F.length("body").cast("long").alias("n_chars"),
        *[size.cast("long").alias(f"c{n}") for n, size in enumerate(sizes)])


def class_references(stats: DataFrame) -> DataFrame:
    """Per language the summed character classes over all its documents."""
    places = range(len(CLASSES) + 1)
    return stats.groupBy(F.col("lang").alias("ref_lang")).agg(
        F.sum("n_words").alias("ref_words"), F.sum("n_chars").alias("ref_chars"), *[F.sum(f"c{n}").alias(f"r{n}") for n in places])


def word_distances(docs: DataFrame, common: DataFrame, *, key: str, text: str, lang: str) -> DataFrame:
    """doc, word_distance for documents with enough words; words outside the common ones form one class."""
    words = docs.select(column(key).alias("doc"), column(lang).alias("lang"), words_of(F.lower(column(text))).alias("words"))
    words = words.select("doc", "lang", F.size("words").alias("n"), F.explode("words").alias("word")).where(f"n >= {WORD_GUARD}")
    ref = common.select("ref_lang", F.col("word").alias("_word"), "share", "total")
    held = words.join(ref, (F.col("word") == F.col("_word")) & F.col("lang").eqNullSafe(F.col("ref_lang")))
    counts = held.groupBy("doc", "lang", "n", "share", "_word").agg(F.count("*").alias("times"))
    p, q = F.col("times") / F.col("n"), F.col("share")
    sums = counts.groupBy("doc", "lang", "n").agg(F.sum(term(p, q)).alias("found"), F.sum(p).alias("p"), F.sum(q).alias("q"))
    whole = common.groupBy(F.col("ref_lang")).agg(F.sum("share").alias("covered"))
    joined = sums.join(whole, F.col("lang").eqNullSafe(F.col("ref_lang")))
    missing = 0.5 * (F.col("covered") - F.col("q"))
    return joined.select("doc", root_of(F.col("found") + missing + term(1 - F.col("p"), 1 - F.col("covered"))).alias("word_distance"))


def quality_rules(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", row: str | None = None) -> DataFrame:
    """Key, base numbers, base_failed, kept, and the two distances, one row per document; ``row`` tells the rows of a stored table apart."""
    root = shared_folder(docs.sparkSession, "rules")
    used = dict.fromkeys([key, text, lang])
    rows, row = (docs, row) if row else numbered(docs.select(*[column(c) for c in used]), f"{root}/rows")
    common = write(common_words(rows, lang, text).coalesce(1), f"{root}/common")
    stats = write(document_stats(rows.withColumn(row, F.struct(column(row).alias("row"), column(key).alias("key"))),
                                 key=row, text=text, lang=lang), f"{root}/stats")
    usual = write(word_distances(rows, common, key=row, text=text, lang=lang), f"{root}/words")
    discard(docs.sparkSession, f"{root}/rows")
    classes = write(class_references(stats).coalesce(1), f"{root}/classes")
    judged = (stats.join(classes, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
              .join(usual.withColumnRenamed("doc", "_doc"), F.col("doc.row") == F.col("_doc"), "left"))
    divergence = sum((term(F.col(f"c{n}") / F.greatest("n_chars", F.lit(1)), F.col(f"r{n}") / F.greatest("ref_chars", F.lit(1)))
                      for n in range(len(CLASSES) + 1)), F.lit(0.0))
    # a text without any of the common words has no row in ``usual``: its histogram is the class of all others
    covered = common.groupBy(F.col("ref_lang").alias("_lang")).agg(F.sum("share").alias("covered"))
    judged = judged.join(covered, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    none = root_of(0.5 * F.col("covered") + term(F.lit(1.0), 1 - F.col("covered")))
    fits = F.col("ref_words") >= LANGUAGE_GUARD
    judged = (judged
              .withColumn("char_distance", F.when(fits & (F.col("n_chars") >= CHAR_GUARD), root_of(divergence)))
              .withColumn("word_distance", F.when(fits & (F.col("n_words") >= WORD_GUARD), F.coalesce("word_distance", none)))
              .withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")))
    fine = f"coalesce(char_distance <= {CHAR_LIMIT}, true) AND coalesce(word_distance <= {WORD_LIMIT}, true)"
    return judged.select(F.col("doc.key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", F.expr(f"NOT base_failed AND {fine}").alias("kept"), "char_distance", "word_distance")
