"""Profiles, quality scores, health and insight reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import profile as prof
from tablescope.operators import quality
from tablescope.operators.stats import redundant_columns
from tablescope.plans.cleaning import _bounds
from tablescope.plans.registry import LINEITEM, ORDERS, query, union_all

GAPS = ["lineitem_gaps"]
NUM = LINEITEM[:8]
TYPES = dict(zip(LINEITEM, ["bigint", "bigint", "bigint", "int", "double", "double", "double", "double",
                            "string", "string", "timestamp_ntz"]))
FAMILIES = {c: {"string": "categorical", "timestamp_ntz": "datetime"}.get(d, "numeric") for c, d in TYPES.items()}


def _profile_row(c: str, table: str) -> str:
    head = (f"SELECT '{c}' AS \"column\", '{TYPES[c]}' AS dtype, '{FAMILIES[c]}' AS family, count(*) AS rows, "
            f"count(*) - count({c}) AS missing, 100.0 * (count(*) - count({c})) / count(*) AS missing_pct, "
            f"count(DISTINCT {c}) AS \"unique\", 100.0 * count(DISTINCT {c}) / count(*) AS unique_pct, ")
    if FAMILIES[c] == "numeric":
        body = (f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, avg({c}) AS mean, stddev_samp({c}) AS std, " + ", ".join(
            f"quantile_cont({c}::DOUBLE, {q / 100}) AS q{q}" for q in (25, 50, 75)))
    else:
        body = ", ".join(f"NULL::DOUBLE AS {m}" for m in ("min", "max", "mean", "std", "q25", "q50", "q75"))
    if FAMILIES[c] == "categorical":
        best = f"FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1"
        body += f", (SELECT {c} {best}) AS top_value, (SELECT count(*) {best}) AS top_count"
    else:
        body += ", NULL::VARCHAR AS top_value, NULL::BIGINT AS top_count"
    if FAMILIES[c] == "datetime":
        body += (f", min({c}) AS first, max({c}) AS last, "
                 f"floor(epoch(max({c}) - min({c})) / 86400)::BIGINT AS range_days")
    else:
        body += ", NULL::TIMESTAMP AS first, NULL::TIMESTAMP AS last, NULL::BIGINT AS range_days"
    return f"{head}{body} FROM {table}"


_DOUBLES = ["missing_pct", "unique_pct", "min", "max", "mean", "std", "q25", "q50", "q75"]


@query("column_profile", " UNION ALL ".join(_profile_row(c, "lineitem") for c in LINEITEM), doubles=_DOUBLES, digits=7)
def _(t):
    return prof.column_profile(t.lineitem)


@query("column_profile_gaps", " UNION ALL ".join(_profile_row(c, "lineitem_gaps") for c in LINEITEM), derived=GAPS,
       doubles=_DOUBLES)
def _(t):
    return prof.column_profile(t.lineitem_gaps)


@query("dataset_profile", """
SELECT 'rows' AS metric, count(*) AS value FROM orders_dups UNION ALL SELECT 'columns', 6
UNION ALL SELECT 'missing_cells', count(*) * 6 - """ + " - ".join(f"count({c})" for c in ORDERS) + """ FROM orders_dups
UNION ALL SELECT 'duplicate_rows', (SELECT count(*) FROM orders_dups) - count(*) FROM (SELECT DISTINCT * FROM orders_dups)
""", derived=["orders_dups"])
def _(t):
    return prof.dataset_profile(t.orders_dups, with_size=False)


@query("dataset_metadata", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{TYPES[c]}' AS dtype, '{FAMILIES[c]}' AS family, count(*) AS rows, "
    f"count(*) - count({c}) AS nulls, round(100.0 * (count(*) - count({c})) / count(*), 2) + 0.0 AS null_pct, " + (
        f"avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, "
        + ", ".join(f"quantile_cont({c}::DOUBLE, {q / 100}) AS q{q}" for q in (25, 50, 75)) + f", max({c})::DOUBLE AS max"
        if c in NUM else ", ".join(f"NULL::DOUBLE AS {m}" for m in ("mean", "std", "min", "q25", "q50", "q75", "max")))
    + " FROM lineitem_gaps" for c in LINEITEM), derived=GAPS,
    doubles=["mean", "std", "min", "q25", "q50", "q75", "max"])
def _(t):
    return prof.dataset_metadata(t.lineitem_gaps)


_METRICS = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
_LABELS = union_all("""
SELECT * FROM (SELECT 'labels' AS section, '{c}' AS item, {c} AS metric, count(*)::VARCHAR AS value FROM part_text
GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 10)""", ["p_name", "p_brand", "p_type", "p_size_txt"])


_NUMBERS = union_all(f"""
SELECT 'numbers' AS section, '{{c}}' AS item, unnest({_METRICS}) AS metric, unnest([round(v::DOUBLE, 4)::VARCHAR FOR v IN [
  count({{c}}), avg({{c}}), stddev_samp({{c}}), min({{c}}), quantile_cont({{c}}::DOUBLE, 0.25), quantile_cont({{c}}::DOUBLE, 0.5),
  quantile_cont({{c}}::DOUBLE, 0.75), max({{c}})]]) AS value FROM part_text""", ["p_partkey", "p_size", "p_retailprice"])


@query("profile_report", """
SELECT 'overview' AS section, 'rows' AS item, 'value' AS metric, count(*)::VARCHAR AS value FROM part_text
UNION ALL SELECT 'overview', 'columns', 'value', '7' UNION ALL SELECT 'overview', 'missing_cells', 'value', '0'
UNION ALL SELECT 'overview', 'duplicate_rows', 'value',
  ((SELECT count(*) FROM part_text) - count(*))::VARCHAR FROM (SELECT DISTINCT * FROM part_text)
UNION ALL SELECT 'data types', 'bigint', 'columns', '1' UNION ALL SELECT 'data types', 'int', 'columns', '1'
UNION ALL SELECT 'data types', 'double', 'columns', '1' UNION ALL SELECT 'data types', 'string', 'columns', '4'
UNION ALL """ + _LABELS + " UNION ALL " + _NUMBERS, derived=["part_text"])
def _(t):
    return prof.profile_report(t.part_text)


@query("column_inventory", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{TYPES[c]}' AS dtype, count({c}) AS non_null, count(DISTINCT {c}) AS unique_count "
    "FROM lineitem_gaps" for c in LINEITEM), derived=GAPS)
def _(t):
    return prof.column_inventory(t.lineitem_gaps)


@query("dtype_counts", "SELECT data_type_name AS dtype, count(*) AS columns FROM (VALUES "
       + ", ".join(f"('{d}')" for d in TYPES.values()) + ") v(data_type_name) GROUP BY 1")
def _(t):
    return prof.dtype_counts(t.lineitem)


# --- missingness ---------------------------------------------------------------------------


@query("completeness", union_all(
    "SELECT '{c}' AS \"column\", 100.0 * count({c}) / count(*) AS completeness_pct FROM lineitem_gaps", LINEITEM),
    derived=GAPS, doubles=["completeness_pct"])
def _(t):
    return quality.completeness(t.lineitem_gaps)


@query("null_map", "SELECT " + " || ".join(f"(({c} IS NULL)::INT)::VARCHAR" for c in LINEITEM)
       + " AS pattern, count(*) AS rows FROM lineitem_gaps GROUP BY 1", derived=GAPS)
def _(t):
    return quality.null_patterns(t.lineitem_gaps)


@query("null_map_sample")
def _(t):
    return quality.null_map(t.lineitem_gaps, 500, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


def _null_corr(c: str, o: str) -> str:
    flag = f"({c} IS NULL)::INT::DOUBLE"
    return (f"SELECT '{c}' AS \"column\", '{o}' AS other, {NUM.index(o)} AS place, "
            f"abs(covar_pop({flag}, {o}) / nullif(stddev_pop({flag}) FILTER ({o} IS NOT NULL) * stddev_pop({o}), 0)) AS r "
            "FROM lineitem_gaps")


_MISS = ["l_discount", "l_tax", "l_returnflag"]


@query("missingness_patterns", "WITH r AS (" + " UNION ALL ".join(
    _null_corr(c, o) for c in _MISS for o in NUM if c != o) + """),
b AS (SELECT "column", max(r) AS r, arg_min(other, place) AS other FROM r
      WHERE r = (SELECT max(r) FROM r x WHERE x."column" = r."column") GROUP BY "column"),
n AS (""" + union_all("SELECT '{c}' AS \"column\", 100.0 * (count(*) - count({c})) / count(*) AS p FROM lineitem_gaps", _MISS)
       + """)
SELECT n."column", round(p, 2) + 0.0 AS missing_pct, CASE WHEN p > 60 THEN 'MNAR' WHEN r > 0.3 THEN 'MAR' ELSE 'MCAR' END AS pattern,
  CASE WHEN p > 60 THEN 'high' WHEN r > 0.3 THEN 'medium' ELSE 'low' END AS severity,
  round(r, 3) + 0.0 AS max_correlation, other AS correlated_with
FROM n JOIN b USING ("column") """, derived=GAPS)
def _(t):
    return quality.missingness_patterns(t.lineitem_gaps)


@query("missingness_correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr(({a} IS NULL)::INT, ({b} IS NULL)::INT) AS corr FROM lineitem_gaps"
    for a in _MISS for b in _MISS), derived=GAPS, doubles=["corr"])
def _(t):
    return quality.missingness_correlation(t.lineitem_gaps)


@query("impute_advice", """
SELECT "column", candidates, recommended FROM (
  SELECT 'l_discount' AS "column", 'median,mean,knn' AS candidates, 'median' AS recommended, count(*) - count(l_discount) AS n FROM lineitem_gaps
  UNION ALL SELECT 'l_tax', 'median,mean,knn', 'median', count(*) - count(l_tax) FROM lineitem_gaps
  UNION ALL SELECT 'l_returnflag', 'mode,new category', 'mode', count(*) - count(l_returnflag) FROM lineitem_gaps
) WHERE n > 0""", derived=GAPS)
def _(t):
    return quality.impute_advice(t.lineitem_gaps)


# --- quality -------------------------------------------------------------------------------


@query("range_validation", union_all(
    "SELECT '{c}' AS \"column\", quantile_cont({c}::DOUBLE, 0.01) AS p01, quantile_cont({c}::DOUBLE, 0.99) AS p99 "
    "FROM lineitem_gaps HAVING count({c}) >= 30", NUM), derived=GAPS, doubles=["p01", "p99"])
def _(t):
    return quality.range_validation(t.lineitem_gaps)


@query("quality_issues", "SELECT \"column\", issue, ratio, n FROM (" + union_all("""
SELECT '{c}' AS "column", 'high missing ratio' AS issue, (count(*) - count({c})) / count(*) AS ratio,
  count(*) - count({c}) AS n, (count(*) - count({c})) / count(*) > 0.12 AS hit FROM lineitem_gaps
UNION ALL SELECT '{c}', 'near constant', count(DISTINCT {c}) / count(*), count(DISTINCT {c}),
  count(DISTINCT {c}) / count(*) < 0.01 AND count(DISTINCT {c}) > 1 FROM lineitem_gaps""", LINEITEM) + """
UNION ALL SELECT '(all columns)', 'duplicates', ((SELECT count(*) FROM lineitem_gaps) - count(*)) / (SELECT count(*) FROM lineitem_gaps),
  (SELECT count(*) FROM lineitem_gaps) - count(*), (SELECT count(*) FROM lineitem_gaps) > count(*)
  FROM (SELECT DISTINCT * FROM lineitem_gaps)) WHERE hit""", derived=GAPS, doubles=["ratio"])
def _(t):
    return quality.quality_issues(t.lineitem_gaps, 0.12)


_PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1:]]


@query("quality_report", f"""
WITH nl AS ({union_all('SELECT 100.0 * (count(*) - count({c})) / count(*) AS p FROM lineitem_gaps', LINEITEM)}),
o AS (SELECT coalesce(avg(outlier_pct), 0) AS r FROM ({_bounds('lineitem_gaps', NUM)}) WHERE outlier_pct > 0),
d AS (SELECT (SELECT count(*) FROM lineitem_gaps) AS n, count(*) AS u FROM (SELECT DISTINCT * FROM lineitem_gaps)),
c AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM lineitem_gaps" for a, b in _PAIRS)}),
red AS (SELECT count(DISTINCT x) AS k FROM (SELECT a AS x FROM c WHERE r >= 0.9 UNION ALL SELECT b FROM c WHERE r >= 0.9)),
p AS (SELECT least(40, 0.8 * (SELECT avg(p) FROM nl)) AS miss, least(30, (SELECT r FROM o)) AS outl,
  least(20, 100.0 * (n - u) / n) AS dup, 0.0 AS typ, least(15, 2.0 * (SELECT k FROM red)) AS red, n - u AS dups FROM d)
SELECT 'missing_penalty' AS metric, round(miss, 6)::DOUBLE + 0.0 AS value FROM p
UNION ALL SELECT 'outlier_penalty', round(outl, 6)::DOUBLE FROM p UNION ALL SELECT 'duplicate_penalty', round(dup, 6)::DOUBLE FROM p
UNION ALL SELECT 'type_penalty', typ::DOUBLE FROM p UNION ALL SELECT 'redundancy_penalty', red::DOUBLE FROM p
UNION ALL SELECT 'columns_with_missing', count(*) FILTER (p > 0)::DOUBLE FROM nl
UNION ALL SELECT 'max_missing_pct', round(max(p), 6)::DOUBLE FROM nl UNION ALL SELECT 'mean_missing_pct', round(avg(p), 6)::DOUBLE FROM nl
UNION ALL SELECT 'duplicate_rows', dups::DOUBLE FROM p
UNION ALL SELECT 'quality_score', floor(greatest(0, least(100, 100 - miss - outl - dup - typ - red)))::DOUBLE FROM p""", derived=GAPS)
def _(t):
    return quality.quality_report(t.lineitem_gaps)


@query("redundant_columns", """
SELECT * FROM (SELECT 'l_extendedprice' AS a, 'l_twice' AS b, abs(corr(l_extendedprice, l_twice)) AS abs_corr FROM lineitem_wide)
WHERE abs_corr >= 0.9""", derived=["lineitem_wide"], doubles=["abs_corr"])
def _(t):
    return redundant_columns(t.lineitem_wide)


# --- health --------------------------------------------------------------------------------


@query("health_score", """
WITH s AS (SELECT count(*) AS n, """ + " + ".join(f"count({c})" for c in ORDERS) + """ AS cells,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dups)) AS u FROM orders_dups),
p AS (SELECT 100.0 * cells / (n * 6) AS completeness, 100.0::DOUBLE AS consistency, 100.0 * u / n AS uniqueness,
  90.0::DOUBLE AS accuracy, 90.0::DOUBLE AS timeliness FROM s),
f AS (SELECT *, round_even(0.3 * completeness + 0.25 * consistency + 0.2 * uniqueness + 0.15 * accuracy + 0.1 * timeliness, 0)::BIGINT
  AS final_score FROM p)
SELECT *, CASE WHEN final_score >= 95 THEN 'Perfect Dataset' WHEN final_score >= 90 THEN 'Data Master'
  WHEN final_score >= 80 THEN 'Clean Data Apprentice' WHEN final_score >= 70 THEN 'Data Novice'
  WHEN final_score >= 60 THEN 'Needs Attention' ELSE 'Critical Issues' END AS badge FROM f""", derived=["orders_dups"],
       doubles=["completeness", "uniqueness"])
def _(t):
    return quality.health_score(t.orders_dups)


@query("health_recommendations", """
SELECT * FROM (
  SELECT 3 AS rank, 'remove duplicate rows' AS rule, '' AS subject, (SELECT count(*) FROM orders_dups) - count(*) AS n
  FROM (SELECT DISTINCT * FROM orders_dups)
  UNION ALL SELECT 4, 'review negative values', 'o_totalprice', count(*) FILTER (o_totalprice - 100000 < 0) FROM orders_dups
  UNION ALL SELECT 5, 'drop redundant columns', 'o_totalprice & half_price', 1 FROM orders_dups
  HAVING abs(corr(o_totalprice - 100000, o_totalprice / 2)) > 0.9) WHERE n > 0""", derived=["orders_dups"])
def _(t):
    return quality.health_recommendations(t.orders_dups.withColumns({
        "half_price": F.col("o_totalprice") / 2, "o_totalprice": F.col("o_totalprice") - 100000}))


@query("health_insights", """
SELECT rule, "column", value FROM (
  SELECT 'critical missing values' AS rule, 'l_tax' AS "column", 100.0 * (count(*) - count(l_tax)) / count(*) AS value,
         count(*) - count(l_tax) > 0.3 * count(*) AS hit FROM lineitem_gaps
  UNION ALL SELECT 'duplicates', '(all columns)', ((SELECT count(*) FROM lineitem_gaps) - count(*))::DOUBLE,
         (SELECT count(*) FROM lineitem_gaps) > count(*) FROM (SELECT DISTINCT * FROM lineitem_gaps)
""" + "".join(f"""
  UNION ALL SELECT 'high cardinality', '{c}', count(DISTINCT {c})::DOUBLE,
         count(DISTINCT {c}) > 10 AND count(DISTINCT {c}) > 0.95 * count(*) FROM lineitem_gaps""" for c in LINEITEM) + "".join(f"""
  UNION ALL SELECT 'skewed distribution', '{c}', skewness({c}), abs(skewness({c})) > 2 FROM lineitem_gaps""" for c in NUM) + """
  UNION ALL SELECT 'skewed distribution', 'cubed', skewness(l_quantity ** 6), abs(skewness(l_quantity ** 6)) > 2 FROM lineitem_gaps
  UNION ALL SELECT 'currency symbols', 'note', count(*)::DOUBLE, count(*) > 0 FROM lineitem_gaps
  UNION ALL SELECT 'repeated commas or blanks', 'note', count(*)::DOUBLE, count(*) > 0 FROM lineitem_gaps
  UNION ALL SELECT 'zero variance', 'note', 1.0, true
) WHERE hit""", derived=GAPS, doubles=["value"])
def _(t):
    return quality.health_insights(t.lineitem_gaps.withColumns({
        "cubed": F.pow("l_quantity", F.lit(6.0)), "note": F.lit("paid  in $")}))


_CV = "stddev_samp({c}) / (abs(avg({c})) + 1e-10)"


@query("auto_insights", """
WITH f AS (
  SELECT 1 AS rank, 'missing' AS kind, 'l_tax' AS "column", 1::BIGINT AS n, 100.0 * (count(*) - count(l_tax)) / count(*) AS value
  FROM lineitem_wide2 HAVING 100.0 * (count(*) - count(l_tax)) / count(*) > 20
  UNION ALL SELECT 2, 'correlated', 'l_extendedprice & l_twice', 1, abs(corr(l_extendedprice, l_twice)) FROM lineitem_wide2
  UNION ALL SELECT 4, 'near constant', 'l_const', 1, 0.0
  UNION ALL SELECT 7, 'imbalanced', 'flag', count(*) FILTER (l_linenumber < 7), 100.0 * count(*) FILTER (l_linenumber < 7) / count(*)
  FROM lineitem_wide2)
SELECT rank, kind, "column", n, value, (SELECT count(*) FROM f) AS total FROM f""".replace("lineitem_wide2", """(
  SELECT *, l_extendedprice * 2 + 1 AS l_twice FROM lineitem_gaps)"""), derived=GAPS, doubles=["value"])
def _(t):
    return quality.auto_insights(t.lineitem_gaps.select(
        *LINEITEM[:-1], (F.col("l_extendedprice") * 2 + 1).alias("l_twice"), F.lit(4.0).alias("l_const"),
        F.when(F.col("l_linenumber") < 7, "common").otherwise("last").alias("flag")))
