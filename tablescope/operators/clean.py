"""Type repair, imputation, outlier treatment, suggestions and replayable recipes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.checkpoints import stored
from tablescope.functions.columns import (
    TEXT, as_double, col, distinct_table, empty_report, family, inline_rows, long_agg, nan_to_null,
    numeric_columns, pct, require_columns, scalar_stats, text_columns, to_long,
)
from tablescope.functions.parsing import (
    DATE_FORMATS, FALSE_WORDS, TRUE_WORDS, is_date, is_number, parse_boolean, parse_datetime,
    parse_number, strip,
)
from tablescope.functions.quantiles import agg_with_quantiles, quantile_map
from tablescope.operators import project, transform
from tablescope.operators.aggregate import duplicate_count, null_counts

# Thresholds, words and messages of the reports.
MISSING_HIGH_PCT, MISSING_MEDIUM_PCT = 20, 5
DUPLICATES_HIGH = 100
OUTLIERS_HIGH_PCT = 10
SUGGEST_MISSING_SHARE = 0.3
ID_LIKE_SHARE = 0.95
NON_NEGATIVE_WORDS = ("price", "cost", "amount", "fee", "age", "year")
DATE_TEXT_PATTERNS = (r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}/\d{1,2}/\d{4}", r"\d{1,2}-\d{1,2}-\d{4}")
UNKNOWN = "Unknown"
IQR_FACTOR = 1.5


# --- type repair ---------------------------------------------------------------------------


def _as_text(name: str) -> Column:
    return col(name).cast("string")


def to_numeric(df: DataFrame, name: str) -> DataFrame:
    if name in numeric_columns(df):
        return df
    return df.withColumn(name, parse_number(_as_text(name)))


def to_datetime(df: DataFrame, name: str, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    if family(df.schema[name].dataType) != TEXT:
        return df.withColumn(name, col(name).try_cast("timestamp_ntz"))
    return df.withColumn(name, parse_datetime(col(name), formats))


def convert_type(df: DataFrame, name: str, target: str) -> DataFrame:
    """int64 (bad or missing becomes 0), float64, datetime, bool or text."""
    is_num = name in numeric_columns(df)
    number = as_double(name) if is_num else parse_number(_as_text(name))
    if target == "int64":
        return df.withColumn(name, F.coalesce(F.when(~F.isnan(number), number).try_cast("bigint"), F.lit(0)))
    if target == "float64":
        return df.withColumn(name, number)
    if target == "datetime":
        return to_datetime(df, name)
    if target == "bool":
        return df.withColumn(name, parse_boolean(_as_text(name)))
    if target == "text":
        return df.withColumn(name, _as_text(name))
    raise ValueError(f"unknown target type {target!r}")


def parse_rates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per text column how many non-null values read as boolean, number, whole number or date."""
    cols = list(cols) if cols is not None else text_columns(df)
    if not cols:
        return empty_report(df, "column string, n long, booleans long, numbers long, wholes long, dates long")
    words = [w for w in (*TRUE_WORDS, *FALSE_WORDS) if len(w) > 1 or w in "10"]

    def whole(c: str) -> Column:
        v = parse_number(col(c))
        return F.count_if(v == F.floor(v))

    return long_agg(df, cols, {
        "n": lambda c: F.count(col(c)),
        "booleans": lambda c: F.count_if(F.lower(col(c)).isin(*words)),
        "numbers": lambda c: F.count_if(is_number(col(c))),
        "wholes": whole,
        "dates": lambda c: F.count_if(is_date(col(c))),
    })


def suggest_type(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Best type per text column by the share of values that parse."""
    r = parse_rates(df, cols)
    share = lambda c: F.try_divide(F.col(c), F.col("n"))
    number = F.when(F.try_divide(F.col("wholes"), F.col("numbers")) > 0.9, "int64").otherwise("float64")
    kind = (F.when(share("booleans") > 0.9, "bool").when(share("numbers") > 0.9, number)
            .when(share("dates") > 0.7, "datetime").otherwise("text"))
    return r.select("column", kind.alias("suggested_type"))


def fix_types(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Text columns in which every value is a number, else every value a date, change type."""
    rates = {r["column"]: r for r in parse_rates(df, cols).collect()}  # one row per text column
    out = df
    for c, r in rates.items():
        if r["n"] and r["numbers"] == r["n"]:
            out = out.withColumn(c, parse_number(col(c)))
        elif r["n"] and r["dates"] == r["n"]:
            out = out.withColumn(c, parse_datetime(col(c)))
    return out


def type_issues(df: DataFrame, min_values: int = 10) -> DataFrame:
    """Text columns whose values mostly look like numbers or dates."""
    r = parse_rates(df).where(F.col("n") >= min_values)
    rows = r.select("column", F.inline(F.array(
        F.struct(F.lit("values look numeric").alias("issue"), pct(F.col("numbers"), F.col("n")).alias("success_pct"),
                 F.lit(90.0).alias("_need"), F.lit("to_numeric").alias("suggested_action")),
        F.struct(F.lit("values look like dates").alias("issue"), pct(F.col("dates"), F.col("n")).alias("success_pct"),
                 F.lit(80.0).alias("_need"), F.lit("to_datetime").alias("suggested_action")))))
    return rows.where(F.col("success_pct") >= F.col("_need")).drop("_need")


# --- imputation ----------------------------------------------------------------------------


def mode_values(df: DataFrame, cols: Sequence[str], dtype: str) -> DataFrame:
    """``(column, value)``: most frequent value, the smallest one on ties."""
    counts = to_long(df, cols, dtype).where("value is not null").groupBy("column", "value").agg(
        F.count("*").alias("n"))
    return counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))


def _mode_map(df: DataFrame, cols: Sequence[str], dtype: str) -> Column:
    modes = mode_values(df, cols, dtype)
    return modes.agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("m")).scalar()


def _fill(name: str, value: Column) -> Column:
    return F.coalesce(col(name), value)


def impute(df: DataFrame, strategy: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Fill or drop missing values: mean, median, mode, zero or drop; other text becomes Unknown."""
    data = nan_to_null(df)
    cols = list(cols) if cols is not None else numeric_columns(df) + text_columns(df)
    require_columns(df, cols)
    if strategy == "drop":
        return data.dropna(subset=cols)
    nums = [c for c in cols if c in numeric_columns(df)]
    texts = [c for c in cols if c in text_columns(df)]
    made: dict[str, Column] = {}
    stats: dict[str, Column] = {}  # attached once, then read by every filled column
    if nums and strategy == "mean":
        stats["_nums"] = scalar_stats(data, **{f"m{i}": F.avg(as_double(c)) for i, c in enumerate(nums)})
        made |= {c: F.coalesce(as_double(c), F.col(f"_nums.m{i}")) for i, c in enumerate(nums)}
    elif nums and strategy == "median":
        stats["_nums"] = quantile_map(data.select(*[col(c) for c in nums]), nums, [0.5])
        made |= {c: F.coalesce(as_double(c), F.get(F.col("_nums")[c], F.lit(0))) for c in nums}
    elif nums and strategy == "zero":
        made |= {c: _fill(c, F.lit(0).cast(df.schema[c].dataType)) for c in nums}
    elif nums and strategy == "mode":
        stats["_nums"] = _mode_map(data, nums, "double")
        made |= {c: _fill(c, F.col("_nums")[c].cast(df.schema[c].dataType)) for c in nums}
    elif nums:
        raise ValueError(f"unknown strategy {strategy!r}")
    if texts and strategy == "mode":
        stats["_texts"] = _mode_map(data, texts, "string")
        made |= {c: _fill(c, F.col("_texts")[c]) for c in texts}
    else:
        made |= {c: _fill(c, F.lit(UNKNOWN)) for c in texts}
    return data.withColumns(stats).withColumns(made).drop(*stats)


def impute_constant(df: DataFrame, cols: Sequence[str] | None = None, value: Any = UNKNOWN) -> DataFrame:
    return df.fillna(value, subset=list(cols) if cols is not None else text_columns(df))


# --- outliers ------------------------------------------------------------------------------


def with_fences(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Attach ``_fences``, a map from column to its quartiles and its lower and upper fence."""
    quart = agg_with_quantiles(df.select(*[col(c) for c in cols]), cols, {}, [0.25, 0.75])
    fences = quart.select(
        "column", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3")
    ).withColumn("iqr", F.col("q3") - F.col("q1")).withColumn(
        "lower", F.col("q1") - IQR_FACTOR * F.col("iqr")).withColumn(
        "upper", F.col("q3") + IQR_FACTOR * F.col("iqr"))
    table = fences.agg(F.map_from_entries(
        F.collect_list(F.struct("column", F.struct("q1", "q3", "lower", "upper")))).alias("m")).scalar()
    return df.withColumn("_fences", table)


def outlier_bounds(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Quartiles, fences and the number and share of values outside, per numeric column."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    data = nan_to_null(df.select(*[col(c) for c in cols]))
    fenced = with_fences(data, cols)

    def outside(c: str) -> Column:
        f = F.col("_fences")[c]
        return F.count_if((as_double(c) < f["lower"]) | (as_double(c) > f["upper"]))

    counted = long_agg(fenced, cols, {
        "n_outliers": outside, "rows": lambda c: F.count(F.lit(1)), "f": lambda c: F.any_value(F.col("_fences")[c])})
    return counted.select(
        "column", "f.q1", "f.q3", "f.lower", "f.upper", "n_outliers",
        pct(F.col("n_outliers"), F.col("rows")).alias("outlier_pct"))


def outlier_clip(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Values outside the fences move onto the fence; NULL stays NULL."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    f = lambda c: F.col("_fences")[c]
    return with_fences(nan_to_null(df), cols).withColumns({
        c: F.when(col(c).isNotNull(), F.greatest(f(c)["lower"], F.least(f(c)["upper"], as_double(c))))
        for c in cols}).drop("_fences")


outlier_cap = outlier_clip


def outlier_remove(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Keep rows inside the fences. With several columns each one sees what the previous left."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    out = nan_to_null(df)
    for c in cols:
        f = F.col("_fences")[c]
        out = with_fences(out, [c]).where((as_double(c) >= f["lower"]) & (as_double(c) <= f["upper"])).drop("_fences")
    return out


def outlier_zscore(df: DataFrame, name: str, threshold: float = 3.0, out: str = "is_outlier") -> DataFrame:
    """Flag values more than ``threshold`` population standard deviations from the mean."""
    s = scalar_stats(nan_to_null(df.select(col(name))), mean=F.avg(as_double(name)), std=F.stddev_pop(as_double(name)))
    z = F.abs(as_double(name) - s["mean"]) / F.nullif(s["std"], F.lit(0.0))
    return df.withColumn(out, F.coalesce(z > threshold, F.lit(False)))


def treat_outliers(df: DataFrame, cols: Sequence[str], method: str) -> DataFrame:
    if method == "none":
        return df
    return {"clip": outlier_clip, "cap": outlier_cap, "remove": outlier_remove}[method](df, cols)


# --- issue reports -------------------------------------------------------------------------


def analyze_issues(df: DataFrame) -> DataFrame:
    """Missing values, duplicates, text that is numbers or dates, and IQR outliers."""
    n, p = F.col("n"), F.col("pct")
    missing = null_counts(df).where(F.col("nulls") > 0).select(
        "column", F.col("nulls").alias("n"), F.col("null_pct").alias("pct")).select(
        "column", F.lit("missing values").alias("issue"),
        F.lit("fill with mean, median or mode, or drop rows").alias("recommendation"),
        F.when(p > MISSING_HIGH_PCT, "High").when(p > MISSING_MEDIUM_PCT, "Medium").otherwise("Low").alias("severity"),
        n)
    dups = duplicate_count(df).where(F.col("duplicates") > 0).select(
        F.lit("All").alias("column"), F.lit("duplicate rows").alias("issue"),
        F.lit("remove duplicate rows").alias("recommendation"),
        F.when(F.col("duplicates") > DUPLICATES_HIGH, "High").otherwise("Medium").alias("severity"),
        F.col("duplicates").alias("n"))
    parts = [missing, dups]
    if text_columns(df):
        r = parse_rates(df).where(F.col("n") > 0)
        for kind, what, how in (("numbers", "numbers stored as text", "convert to numeric"),
                                ("dates", "dates stored as text", "convert to datetime")):
            parts.append(r.where(F.col(kind) == F.col("n")).select(
                "column", F.lit(what).alias("issue"), F.lit(how).alias("recommendation"),
                F.lit("Medium").alias("severity"), n))
    if numeric_columns(df):
        parts.append(outlier_bounds(df).where(F.col("n_outliers") > 0).select(
            "column", F.lit("outliers").alias("issue"),
            F.lit("clip to bounds or remove outliers").alias("recommendation"),
            F.when(F.col("outlier_pct") < OUTLIERS_HIGH_PCT, "Medium").otherwise("High").alias("severity"),
            F.col("n_outliers").alias("n")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cleaning_suggestions(df: DataFrame) -> DataFrame:
    """Rule-based suggestions ``(column, issue, recommendation, severity, n)`` from one pass."""
    data = nan_to_null(df)
    texts, nums = text_columns(df), numeric_columns(df)
    plain = [f.name for f in df.schema.fields if family(f.dataType) != "other"]

    def only(names: Sequence[str], make) -> Any:
        return lambda c: make(c) if c in names else F.sum(F.lit(0)).cast("bigint")

    digits = lambda c: F.regexp_replace(col(c), r"[^\d\.-]", "")
    dated = lambda c: F.greatest(*[col(c).rlike(p) for p in DATE_TEXT_PATTERNS])
    facts = long_agg(data, plain, {
        "rows": lambda c: F.count(F.lit(1)),
        "nulls": lambda c: F.count_if(col(c).isNull()),
        "numberish": only(texts, lambda c: F.count_if(digits(c).rlike(r"^-?(\d+\.?\d*|\.\d+)$"))),
        "negatives": only([c for c in nums if any(w in c.lower() for w in NON_NEGATIVE_WORDS)],
                          lambda c: F.count_if(as_double(c) < 0)),
        "dated": only(texts, lambda c: F.count_if(dated(c))),
    }).join(F.broadcast(distinct_table(data, plain)), "column")
    if texts:
        labels = distinct_table(data, texts, lambda c: F.lower(strip(col(c))), "labels")
        facts = facts.join(F.broadcast(labels), "column", "left")
    else:
        facts = facts.withColumn("labels", F.lit(0).cast("bigint"))
    is_text = F.col("column").isin(*texts) if texts else F.lit(False)
    share = F.try_divide(F.col("uniques"), F.col("rows"))
    rules = [
        (F.col("nulls") > F.col("rows") * SUGGEST_MISSING_SHARE, "missing values", "drop column or impute",
         "Critical", F.col("nulls")),
        (is_text & (F.col("numberish") > 0) & (share <= ID_LIKE_SHARE), "numeric characters stored as text",
         "convert to numeric", "Medium", F.col("numberish")),
        (is_text & (F.col("labels") < F.col("uniques")), "labels differ by case or white space",
         "normalize labels", "Low", F.col("uniques") - F.col("labels")),
        (F.col("negatives") > 0, "negative values", "review for entry errors", "Critical", F.col("negatives")),
        (F.col("uniques") == 1, "one value only", "remove column", "Low", F.col("rows")),
        (is_text & (F.col("dated") > 0), "dates stored as text", "convert to datetime", "Medium", F.col("dated")),
    ]
    rows = inline_rows(facts, [
        {"hit": F.coalesce(test, F.lit(False)), "issue": F.lit(issue), "recommendation": F.lit(todo),
         "severity": F.lit(sev), "n": n} for test, issue, todo, sev, n in rules], keep=["column"])
    out = rows.where("hit").drop("hit")
    twice = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if twice:
        named = inline_rows(df.agg(F.count("*").alias("rows")), [
            {"column": F.lit(c), "issue": F.lit("duplicate column name"), "recommendation": F.lit("rename or remove"),
             "severity": F.lit("Critical"), "n": F.lit(df.columns.count(c)).cast("bigint")} for c in twice])
        out = out.unionByName(named)
    return out


# --- recipes -------------------------------------------------------------------------------

OPS = {
    "to_numeric": lambda df, p: to_numeric(df, p["column"]),
    "to_datetime": lambda df, p: to_datetime(df, p["column"]),
    "convert_type": lambda df, p: convert_type(df, p["column"], p["type"]),
    "drop_na": lambda df, p: project.drop_missing(df, [p["column"]] if "column" in p else None),
    "impute": lambda df, p: impute(df, p["strategy"], p.get("columns")),
    "fill": lambda df, p: impute_constant(df, [p["column"]], p.get("value", UNKNOWN)),
    "drop_duplicates": lambda df, p: df.dropDuplicates(),
    "drop_columns": lambda df, p: project.drop_columns(df, p["columns"]),
    "rename": lambda df, p: project.rename_column(df, p["column"], p["new"]),
    "normalize_labels": lambda df, p: transform.normalize_labels(df, p["column"]),
    "text_strip": lambda df, p: transform.text_strip(df, p["column"]),
    "text_lower": lambda df, p: transform.text_lower(df, p["column"]),
    "text_upper": lambda df, p: transform.text_upper(df, p["column"]),
    "regex_replace": lambda df, p: transform.regex_replace(df, p["column"], p["pattern"], p["replacement"]),
    "outliers": lambda df, p: treat_outliers(df, p["columns"], p["method"]),
    "log": lambda df, p: transform.transform_log(df, p["column"]),
    "sqrt": lambda df, p: transform.transform_sqrt(df, p["column"]),
    "standardize": lambda df, p: transform.transform_standardize(df, p["column"]),
    "normalize": lambda df, p: transform.transform_normalize(df, p["column"]),
    "bin": lambda df, p: transform.bin_equal_width(df, p["column"], int(p.get("bins", 5))),
}

Step = tuple[str, Mapping[str, Any]]


def apply_recipe(df: DataFrame, recipe: Sequence[Step]) -> DataFrame:
    """Replay logged cleaning steps on a table; one lazy plan, no write between the steps."""
    out = df
    for op, params in recipe:
        if op not in OPS:
            raise ValueError(f"unknown cleaning step {op!r}")
        out = OPS[op](out, params)
    return out


def apply_fixes(df: DataFrame, fixes: Sequence[Mapping[str, str]]) -> DataFrame:
    """A list of ``{column, action}`` with action to_numeric, to_datetime or drop_na."""
    allowed = {"to_numeric", "to_datetime", "drop_na"}
    return apply_recipe(df, [(f["action"], {"column": f["column"]}) for f in fixes if f["action"] in allowed])


def apply_suggestions(df: DataFrame, suggestions: Sequence[Mapping[str, str]]) -> DataFrame:
    """Carry out suggestions; critical missingness drops the column."""
    steps: list[Step] = []
    for s in suggestions:
        todo, c = s["recommendation"], s["column"]
        if c not in df.columns:
            continue
        if todo == "convert to numeric":
            steps.append(("to_numeric", {"column": c}))
        elif todo == "normalize labels":
            steps.append(("normalize_labels", {"column": c}))
        elif todo.startswith("drop column"):
            steps.append(("drop_columns", {"columns": [c]}))
        elif todo == "convert to datetime":
            steps.append(("to_datetime", {"column": c}))
    return apply_recipe(df, steps)


def quick_fix(df: DataFrame, name: str, issue: str) -> DataFrame:
    """Pick a repair from the wording of an issue."""
    text = issue.lower()
    if "missing" in text or "null" in text:
        return impute(df, "median", [name])
    if "duplicate" in text:
        return df.dropDuplicates()
    if "type" in text or "numeric" in text:
        return to_numeric(df, name)
    return df


def auto_clean(df: DataFrame, remove_duplicates: bool = False, missing: str | None = None,
               repair_types: bool = False, outliers: str = "none", text: str = "none") -> DataFrame:
    """Deduplicate, impute, repair types, treat outliers and normalise text, in this order."""
    nums, texts = numeric_columns(df), text_columns(df)
    # every later step reads the table again, so the distinct rows are sought once
    out = stored(df.dropDuplicates())[0] if remove_duplicates else df
    if missing in ("knn", "mice"):
        from tablescope.operators.neighbours import impute_knn
        from tablescope.operators.models import impute_mice
        out = impute_constant(out, texts)
        out = impute_knn(out, nums) if missing == "knn" else impute_mice(out, nums)
    elif missing:
        out = impute(out, missing, nums + texts)
    if repair_types:
        out = fix_types(out)
    out = treat_outliers(out, nums, outliers)
    if text != "none":
        still = [c for c in texts if c in text_columns(out)]
        out = out.withColumns({c: transform.TEXT_METHODS[text](col(c)) for c in still})
    return out
