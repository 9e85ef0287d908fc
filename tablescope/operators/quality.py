"""Quality scores, missingness, health and insight reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.columns import (
    NUMERIC, OTHER, TEXT, as_double, col, datetime_columns, distinct_table, empty_report, family,
    inline_rows, long_agg, nan_to_null, numeric_columns, pct, text_columns,
)
from tablescope.functions.gram import pair_correlations
from tablescope.functions.quantiles import agg_with_quantiles
from tablescope.operators.aggregate import duplicate_count, null_counts
from tablescope.operators.clean import outlier_bounds, type_issues
from tablescope.operators.ordered import sampling_gap
from tablescope.operators.profile import top_labels
from tablescope.operators.stats import (
    correlation_matrix, correlation_pairs, shape_facts, skew_adjusted,
)

# Weights, thresholds, badges and word lists of the scores.
HEALTH_WEIGHTS = {"completeness": 0.30, "consistency": 0.25, "uniqueness": 0.20, "accuracy": 0.15, "timeliness": 0.10}
ASSUMED_ACCURACY = ASSUMED_TIMELINESS = 90.0
BADGES = ((95, "Perfect Dataset"), (90, "Data Master"), (80, "Clean Data Apprentice"),
          (70, "Data Novice"), (60, "Needs Attention"), (0, "Critical Issues"))
NON_NEGATIVE_WORDS = ("price", "cost", "amount", "fee", "age")
PENALTY_CAPS = {"missing": 40.0, "outlier": 30.0, "duplicate": 20.0, "type": 15.0, "redundancy": 15.0}
MIN_VALUES = 30
MAR_CORRELATION, MNAR_PCT = 0.3, 60
CURRENCY = r"[$€£¥]"
REPEATED_SEPARATORS = r"[,\s]{2,}"


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- missingness ---------------------------------------------------------------------------


def completeness(df: DataFrame) -> DataFrame:
    return null_counts(df).select("column", (100 - F.col("null_pct")).alias("completeness_pct"))


def null_patterns(df: DataFrame) -> DataFrame:
    """How many rows share each pattern of missing cells (one 0/1 digit per column)."""
    data = nan_to_null(df)
    digits = F.concat(*[col(c).isNull().cast("int").cast("string") for c in df.columns])
    return data.groupBy(digits.alias("pattern")).agg(F.count("*").alias("rows"))


def null_map(df: DataFrame, n: int = 500, key: Sequence[str] = ()) -> DataFrame:
    """0/1 matrix of missing cells for a deterministic sample of ``n`` rows."""
    from tablescope.sources.io import sample_rows
    picked = sample_rows(nan_to_null(df), n, key)
    return picked.select(*[col(c).isNull().cast("int").alias(c) for c in df.columns])


def missingness_patterns(df: DataFrame) -> DataFrame:
    """Per column with missing cells: strongest tie of its absence to a numeric column, and the
    mechanism this suggests."""
    nums, k = numeric_columns(df), len(df.columns)
    flags = [col(c).isNull().cast("double").alias(f"flag{i}") for i, c in enumerate(df.columns)]
    wide = nan_to_null(df).select(*flags, *[as_double(c).alias(f"num{i}") for i, c in enumerate(nums)])
    names, others = F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.lit(c) for c in nums])
    ties = pair_correlations(wide, wide.columns).where((F.col("i") < k) & (F.col("j") >= k) & (F.col("n") > 10)).select(
        F.get(names, F.col("i")).alias("column"), F.get(others, F.col("j") - k).alias("other"),
        F.col("j").alias("place"), F.abs("corr").alias("r")).where("column <> other")
    best = ties.where(F.col("r") > 0).groupBy("column").agg(
        F.max("r").alias("r"), F.min_by("other", F.struct(-F.col("r"), "place")).alias("other"))
    out = null_counts(df).where("nulls > 0").join(F.broadcast(best), "column", "left")
    r, p = F.coalesce("r", F.lit(0.0)), F.col("null_pct")
    return out.select(
        "column", F.round(p, 2).alias("missing_pct"),
        F.when(p > MNAR_PCT, "MNAR").when(r > MAR_CORRELATION, "MAR").otherwise("MCAR").alias("pattern"),
        F.when(p > MNAR_PCT, "high").when(r > MAR_CORRELATION, "medium").otherwise("low").alias("severity"),
        F.round(r, 3).alias("max_correlation"), F.col("other").alias("correlated_with"))


def missingness_correlation(df: DataFrame) -> DataFrame:
    """Correlation of the absence indicators of all columns, long form; NULL where nothing is missing."""
    data = nan_to_null(df)
    flags = data.select(*[col(c).isNull().cast("double").alias(c) for c in df.columns])
    return correlation_matrix(flags).where("corr is not null")


def impute_advice(df: DataFrame) -> DataFrame:
    """Candidate and recommended fill strategies for every column with missing cells."""
    fam = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, family(f.dataType))])[F.col("column")]
    return null_counts(df).where("nulls > 0").select(
        "column",
        F.when(fam == NUMERIC, "median,mean,knn").when(fam == TEXT, "mode,new category")
        .otherwise("unknown").alias("candidates"),
        F.when(fam == NUMERIC, "median").otherwise("mode").alias("recommended"))


# --- validity and structure ----------------------------------------------------------------


def range_validation(df: DataFrame) -> DataFrame:
    """Suggested valid range (1st to 99th percentile) of numeric columns with enough values."""
    cols = numeric_columns(df)
    data = nan_to_null(df.select(*[col(c) for c in cols]))
    facts = agg_with_quantiles(data, cols, {"n": lambda c: F.count(col(c))}, [0.01, 0.99])
    return facts.where(F.col("n") >= MIN_VALUES).select(
        "column", F.get("q", F.lit(0)).alias("p01"), F.get("q", F.lit(1)).alias("p99"))


def quality_issues(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mostly missing and nearly constant columns, and duplicate rows."""
    plain = [f.name for f in df.schema.fields if family(f.dataType) != OTHER]
    data = nan_to_null(df)
    facts = long_agg(data, plain, {"rows": lambda c: F.count(F.lit(1)), "nulls": lambda c: F.count_if(col(c).isNull())})
    facts = facts.join(F.broadcast(distinct_table(data, plain)), "column")
    rows = F.col("rows").cast("double")
    miss, uniq = F.try_divide(F.col("nulls"), rows), F.try_divide(F.col("uniques"), rows)
    found = facts.select("column", F.inline(F.array(
        F.struct((miss > threshold).alias("hit"), F.lit("high missing ratio").alias("issue"),
                 miss.alias("ratio"), F.col("nulls").alias("n")),
        F.struct(((uniq < 0.01) & (F.col("uniques") > 1)).alias("hit"), F.lit("near constant").alias("issue"),
                 uniq.alias("ratio"), F.col("uniques").alias("n"))))).where("hit").drop("hit")
    dups = duplicate_count(df).where("duplicates > 0").select(
        F.lit("(all columns)").alias("column"), F.lit("duplicates").alias("issue"),
        (F.col("duplicates") / F.col("rows")).alias("ratio"), F.col("duplicates").alias("n"))
    return found.unionByName(dups)


def quality_report(df: DataFrame, outlier_rates: DataFrame | None = None) -> DataFrame:
    """Score 0-100 with its penalties as ``(metric, value)``.

    ``outlier_rates`` is ``(column, outlier_pct)``; by default the IQR fences, optionally the
    result of the voting detectors.
    """
    nums = numeric_columns(df)
    nulls = null_counts(df).agg(F.struct(
        F.avg("null_pct").alias("mean"), F.max("null_pct").alias("max"),
        F.count_if(F.col("nulls") > 0).alias("columns"), F.max("rows").alias("rows")).alias("s")).scalar()
    dup = duplicate_count(df)
    zero = F.lit(0.0)
    if outlier_rates is None and nums:
        enough = null_counts(df).where(F.col("rows") - F.col("nulls") >= MIN_VALUES).select("column")
        outlier_rates = outlier_bounds(df).join(F.broadcast(enough), "column", "left_semi")
    out_rate = zero if outlier_rates is None else F.coalesce(
        outlier_rates.where("outlier_pct > 0").agg(F.avg("outlier_pct")).scalar(), zero)
    types = type_issues(df).agg(F.count("*")).scalar() if text_columns(df) else F.lit(0)
    tied = correlation_pairs(df).where(F.abs("corr") >= 0.9).select(F.explode(F.array("a", "b")).alias("c"))
    redundant = tied.agg(F.count_distinct("c")).scalar() if len(nums) > 1 else F.lit(0)

    def capped(kind: str, value: Column) -> Column:
        return F.least(F.lit(PENALTY_CAPS[kind]), value)

    row = dup.select(
        capped("missing", nulls["mean"] * 0.8).alias("missing_penalty"),
        capped("outlier", out_rate).alias("outlier_penalty"),
        capped("duplicate", pct(F.col("duplicates"), F.col("rows"))).alias("duplicate_penalty"),
        capped("type", types.cast("double") * 5).alias("type_penalty"),
        capped("redundancy", redundant.cast("double") * 2).alias("redundancy_penalty"),
        nulls["columns"].cast("double").alias("columns_with_missing"), nulls["max"].alias("max_missing_pct"),
        nulls["mean"].alias("mean_missing_pct"), F.col("duplicates").cast("double").alias("duplicate_rows"))
    lost = sum((F.col(f"{k}_penalty") for k in PENALTY_CAPS), zero)
    row = row.withColumn("quality_score", F.floor(F.greatest(zero, F.least(F.lit(100.0), 100 - lost))).cast("double"))
    return inline_rows(row, [{"metric": F.lit(c), "value": col(c)} for c in row.columns])


# --- health --------------------------------------------------------------------------------


def health_score(df: DataFrame) -> DataFrame:
    """Weighted score of completeness, consistency and uniqueness, with its badge; zeros when empty."""
    cells = null_counts(df).agg(F.struct(F.sum("nulls").alias("nulls"), F.sum("rows").alias("cells")).alias("s")).scalar()
    known = len([f for f in df.schema.fields if family(f.dataType) != OTHER])
    part = duplicate_count(df).select(
        "rows", (100 - pct(cells["nulls"], cells["cells"])).alias("completeness"),
        F.lit(100.0 * known / max(1, len(df.columns))).alias("consistency"),
        pct(F.col("distinct_rows"), F.col("rows")).alias("uniqueness"),
        F.lit(ASSUMED_ACCURACY).alias("accuracy"), F.lit(ASSUMED_TIMELINESS).alias("timeliness"))
    part = part.select(*[F.when(F.col("rows") > 0, F.col(m)).otherwise(0.0).alias(m) for m in HEALTH_WEIGHTS])
    total = sum((F.col(m) * w for m, w in HEALTH_WEIGHTS.items()), F.lit(0.0))
    scored = part.withColumn("final_score", F.bround(total, 0).cast("bigint"))
    badge = F.lit(BADGES[-1][1])
    for bound, text in reversed(BADGES[:-1]):
        badge = F.when(F.col("final_score") >= bound, text).otherwise(badge)
    return scored.withColumn("badge", badge)


def health_recommendations(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Ordered recommendations ``(rank, rule, subject, n)`` drawn from the health parts."""
    h = health_score(df)
    data, nums = nan_to_null(df), numeric_columns(df)
    nulls = null_counts(df)
    high = nulls.where(F.col("nulls") > 0.3 * F.col("rows"))
    n_high = high.agg(F.count("*")).scalar()
    names = high.agg(F.concat_ws(", ", F.array_sort(F.collect_list("column")))).scalar()
    parts = [
        h.where(F.col("completeness") < 90).select(
            F.lit(1).alias("rank"),
            F.when(n_high > 0, "fill mostly missing columns").otherwise("impute missing values").alias("rule"),
            F.when(n_high > 0, names).otherwise("").alias("subject"), n_high.alias("n")),
        h.where(F.col("consistency") < 90).select(
            F.lit(2).alias("rank"), F.lit("fix inconsistent types").alias("rule"), F.lit("").alias("subject"),
            F.lit(0).cast("bigint").alias("n")),
        duplicate_count(df).where(pct(F.col("distinct_rows"), F.col("rows")) < 90).select(
            F.lit(3).alias("rank"), F.lit("remove duplicate rows").alias("rule"), F.lit("").alias("subject"),
            F.col("duplicates").alias("n")),
    ]
    signed = [c for c in nums if any(w in c.lower() for w in NON_NEGATIVE_WORDS)]
    if signed:
        neg = long_agg(data, signed, {"n": lambda c: F.count_if(as_double(c) < 0)}).where("n > 0")
        parts.append(neg.select(F.lit(4).alias("rank"), F.lit("review negative values").alias("rule"),
                                F.col("column").alias("subject"), "n"))
    if len(nums) > 1:
        tied = correlation_pairs(df).where(F.abs("corr") > 0.9)
        place = F.array_position(F.array(*[F.lit(c) for c in nums]), F.col("a"))
        place_b = F.array_position(F.array(*[F.lit(c) for c in nums]), F.col("b"))
        listed = F.array_sort(F.collect_list(F.struct(place.alias("i"), place_b.alias("j"), "a", "b")))
        text = F.concat_ws(", ", F.transform(listed, lambda p: F.concat_ws(" & ", p["a"], p["b"])))
        parts.append(tied.agg(text.alias("subject"), F.count("*").alias("n")).where("n > 0").select(
            F.lit(5).alias("rank"), F.lit("drop redundant columns").alias("rule"), "subject", "n"))
    parts.append(h.select(F.lit(9).alias("rank"), F.lit("clean").alias("rule"), F.lit("").alias("subject"),
                          F.lit(0).cast("bigint").alias("n")))
    found = union(parts).withColumn("_all", F.count("*").over(Window.partitionBy(F.lit(1))))  # report rows
    ordered = found.where("rank < 9 or _all = 1").drop("_all").orderBy("rank", "subject")
    return ordered if limit is None else ordered.limit(limit)


def health_insights(df: DataFrame) -> DataFrame:
    """Rule findings ``(rule, column, value)``: missingness, formats, duplicates, dates, cardinality, skew."""
    data, nums, texts = nan_to_null(df), numeric_columns(df), text_columns(df)
    plain = [f.name for f in df.schema.fields if family(f.dataType) != OTHER]

    def hits(pattern: str):
        return lambda c: F.count_if(col(c).rlike(pattern)) if c in texts else F.sum(F.lit(0)).cast("bigint")

    facts = long_agg(data, df.columns, {
        "rows": lambda c: F.count(F.lit(1)), "nulls": lambda c: F.count_if(col(c).isNull()),
        "currency": hits(CURRENCY), "separators": hits(REPEATED_SEPARATORS)})
    facts = facts.join(F.broadcast(distinct_table(data, plain)), "column", "left")
    facts = facts.join(F.broadcast(skew_adjusted(data)), "column", "left") if nums else facts.withColumn(
        "skew", F.lit(None).cast("double"))
    rules = [
        (F.col("nulls") > 0.3 * F.col("rows"), "critical missing values", pct(F.col("nulls"), F.col("rows"))),
        (F.col("currency") > 0, "currency symbols", F.col("currency").cast("double")),
        (F.col("separators") > 0, "repeated commas or blanks", F.col("separators").cast("double")),
        ((F.col("uniques") > 10) & (F.col("uniques") > 0.95 * F.col("rows")), "high cardinality",
         F.col("uniques").cast("double")),
        (F.abs("skew") > 2, "skewed distribution", F.col("skew")),
        (F.col("uniques") == 1, "zero variance", F.lit(1.0)),
    ]
    parts = [inline_rows(facts, [
        {"hit": F.coalesce(t, F.lit(False)), "rule": F.lit(r), "value": v} for t, r, v in rules], ["column"])
        .where("hit").drop("hit")]
    parts.append(duplicate_count(df).where("duplicates > 0").select(
        F.lit("(all columns)").alias("column"), F.lit("duplicates").alias("rule"),
        F.col("duplicates").cast("double").alias("value")))
    if datetime_columns(df):
        parts.append(sampling_gap(df).where("irregular").select(
            "column", F.lit("irregular sampling").alias("rule"), F.col("median_gap_days").alias("value")))
    return union(parts).select("rule", "column", "value")


def auto_insights(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Findings (on request only the first) ``(rank, kind, column, n, value, total)`` of seven rules, with the number of all."""
    data, nums, texts = nan_to_null(df), numeric_columns(df), text_columns(df)
    order = F.create_map(*[F.lit(x) for i, c in enumerate(df.columns) for x in (c, i)])
    facts = shape_facts(data, nums).withColumn("skew", F.abs("skewness")) if nums else empty_report(
        df, "column string, skew double, mean double, std double")
    miss = null_counts(data).withColumn("p", pct(F.col("nulls"), F.col("rows"))).where("p > 20")

    def best(source: DataFrame, rank: int, kind: str, name: str, size: Column) -> DataFrame:
        """All hits as one finding that names the strongest."""
        return source.agg(
            F.count("*").alias("n"), F.max_by(name, F.struct(size, name)).alias("column"),
            F.max(size).alias("value")).where("n > 0").select(
            F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), "column", "n", "value", F.lit(-1).alias("_o"))

    def each(source: DataFrame, rank: int, kind: str, n: Column, value: Column) -> DataFrame:
        return source.select(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), "column",
                             n.alias("n"), value.alias("value"), order[F.col("column")].alias("_o"))

    one = F.lit(1).cast("bigint")
    cv = F.col("std") / (F.abs("mean") + 1e-10)
    parts = [best(miss, 1, "missing", "column", F.col("p")),
             best(facts.where("skew > 1.5"), 3, "skewed", "column", F.col("skew")),
             each(facts.where(cv < 0.01), 4, "near constant", one, cv)]
    if len(nums) > 1:
        high = correlation_pairs(df).where(F.abs("corr") > 0.9).withColumn("pair", F.concat_ws(" & ", "a", "b"))
        parts.append(best(high, 2, "correlated", "pair", F.abs("corr")))
    if texts:
        uniq = long_agg(data, texts, {"rows": lambda c: F.count(F.lit(1)), "present": lambda c: F.count(col(c))})
        uniq = uniq.join(F.broadcast(distinct_table(data, texts)), "column")
        parts.append(each(uniq.where(F.col("uniques") > 0.9 * F.col("rows")), 5, "high cardinality",
                          F.col("uniques"), pct(F.col("uniques"), F.col("rows"))))
        top = top_labels(data, texts, 1).select("column", F.col("count").alias("top"))
        share = F.col("top") / F.col("present")
        few = uniq.where("uniques <= 10").join(F.broadcast(top), "column").where(share > 0.8)
        parts.append(each(few, 7, "imbalanced", F.col("top"), share * 100))
    dup = duplicate_count(df).where("duplicates > 0").select(
        F.lit(6).alias("rank"), F.lit("duplicates").alias("kind"), F.lit("(all columns)").alias("column"),
        F.col("duplicates").alias("n"), pct(F.col("duplicates"), F.col("rows")).alias("value"), F.lit(-1).alias("_o"))
    found = union([*parts, dup]).withColumn("total", F.count("*").over(Window.partitionBy(F.lit(1))))  # report rows
    ordered = found.orderBy("rank", "_o")
    return (ordered if limit is None else ordered.limit(limit)).select("rank", "kind", "column", "n", "value", "total")
