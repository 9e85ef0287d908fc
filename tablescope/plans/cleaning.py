"""Imputation, outliers, suggestions and recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import clean, outliers
from tablescope.operators.quality import quality_report
from tablescope.plans.registry import LINEITEM, query, union_all

GAPS = ["lineitem_gaps"]
_OTHER = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_linestatus, l_shipdate"


def _filled(fn: str) -> str:
    return (f"SELECT {_OTHER}, coalesce(l_discount, (SELECT {fn.format(c='l_discount')} FROM lineitem_gaps)) AS l_discount, "
            f"coalesce(l_tax, (SELECT {fn.format(c='l_tax')} FROM lineitem_gaps)) AS l_tax, "
            "coalesce(l_returnflag, 'Unknown') AS l_returnflag FROM lineitem_gaps")


_THREE = ["l_discount", "l_tax", "l_returnflag"]


@query("impute_mean", _filled("avg({c})"), derived=GAPS, doubles=["l_discount", "l_tax"])
def _(t):
    return clean.impute(t.lineitem_gaps, "mean", _THREE)


@query("impute_median", _filled("quantile_cont({c}, 0.5)"), derived=GAPS, doubles=["l_discount", "l_tax"])
def _(t):
    return clean.impute(t.lineitem_gaps, "median", _THREE)


@query("impute_zero", _filled("0.0::DOUBLE + 0 * count({c})"), derived=GAPS, doubles=["l_discount", "l_tax"])
def _(t):
    return clean.impute(t.lineitem_gaps, "zero", _THREE)


def _mode(c: str) -> str:
    return (f"coalesce({c}, (SELECT {c} FROM lineitem_gaps WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}")


@query("impute_mode", f"SELECT {_OTHER}, " + ", ".join(_mode(c) for c in _THREE) + " FROM lineitem_gaps", derived=GAPS)
def _(t):
    return clean.impute(t.lineitem_gaps, "mode", _THREE)


@query("impute_constant", "SELECT * REPLACE (coalesce(l_returnflag, 'Unknown') AS l_returnflag) FROM lineitem_gaps",
       derived=GAPS)
def _(t):
    return clean.impute_constant(t.lineitem_gaps)


@query("impute_drop", "SELECT * FROM lineitem_gaps WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL "
       "AND l_returnflag IS NOT NULL", derived=GAPS)
def _(t):
    return clean.impute(t.lineitem_gaps, "drop")


# --- outliers ------------------------------------------------------------------------------


_FENCE = """f AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer_outliers))"""


def _bounds(table: str, cols: list[str]) -> str:
    return union_all(f"""
SELECT '{{c}}' AS "column", q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper,
  count(*) FILTER ({{c}} < q1 - 1.5 * (q3 - q1) OR {{c}} > q3 + 1.5 * (q3 - q1)) AS n_outliers,
  100.0 * count(*) FILTER ({{c}} < q1 - 1.5 * (q3 - q1) OR {{c}} > q3 + 1.5 * (q3 - q1)) / count(*) AS outlier_pct
FROM {table}, (SELECT quantile_cont({{c}}::DOUBLE, 0.25) AS q1, quantile_cont({{c}}::DOUBLE, 0.75) AS q3 FROM {table})
GROUP BY q1, q3""", cols)


@query("outlier_bounds", _bounds("customer_outliers", ["c_custkey", "c_nationkey", "c_acctbal"]),
       derived=["customer_outliers"], doubles=["q1", "q3", "lower", "upper", "outlier_pct"])
def _(t):
    return clean.outlier_bounds(t.customer_outliers)


_CLIP = f"WITH {_FENCE} SELECT c.* REPLACE (greatest(lo, least(hi, c_acctbal)) AS c_acctbal) FROM customer_outliers c, f"


@query("outlier_clip", _CLIP, derived=["customer_outliers"], doubles=["c_acctbal"])
def _(t):
    return clean.outlier_clip(t.customer_outliers, ["c_acctbal"])


@query("outlier_cap", _CLIP, derived=["customer_outliers"], doubles=["c_acctbal"])
def _(t):
    return clean.outlier_cap(t.customer_outliers, ["c_acctbal"])


@query("outlier_remove", f"WITH {_FENCE} SELECT c.* FROM customer_outliers c, f WHERE c_acctbal BETWEEN lo AND hi",
       derived=["customer_outliers"])
def _(t):
    return clean.outlier_remove(t.customer_outliers, ["c_acctbal"])


@query("outlier_zscore", """
SELECT c_custkey, abs(c_acctbal - m) / s > 3 AS is_outlier FROM customer_outliers,
  (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer_outliers)""", derived=["customer_outliers"])
def _(t):
    return clean.outlier_zscore(t.customer_outliers, "c_acctbal").select("c_custkey", "is_outlier")


# --- issues, suggestions, recipes ----------------------------------------------------------


_NUM = LINEITEM[:8]


@query("analyze_issues", "SELECT * FROM (" + union_all(
    "SELECT '{c}' AS \"column\", 'missing values' AS issue, 'fill with mean, median or mode, or drop rows' AS recommendation, "
    "CASE WHEN count(*) - count({c}) > 0.2 * count(*) THEN 'High' WHEN count(*) - count({c}) > 0.05 * count(*) "
    "THEN 'Medium' ELSE 'Low' END AS severity, count(*) - count({c}) AS n FROM lineitem_gaps", LINEITEM)
    + ") WHERE n > 0 UNION ALL SELECT \"column\", 'outliers', 'clip to bounds or remove outliers', "
    "CASE WHEN outlier_pct < 10 THEN 'Medium' ELSE 'High' END, n_outliers FROM (" + _bounds("lineitem_gaps", _NUM)
    + ") WHERE n_outliers > 0", derived=GAPS)
def _(t):
    return clean.analyze_issues(t.lineitem_gaps)


def _text_rules(c: str) -> str:
    lab = f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"
    digits = f"regexp_replace({c}, '[^\\d\\.-]', '', 'g')"
    return f"""
SELECT '{c}' AS "column", 'numeric characters stored as text' AS issue, 'convert to numeric' AS recommendation,
  'Medium' AS severity, count(*) FILTER (regexp_matches({digits}, '^-?(\\d+\\.?\\d*|\\.\\d+)$')) AS n
FROM part_text HAVING count(DISTINCT {c}) <= 0.95 * count(*)
UNION ALL SELECT '{c}', 'labels differ by case or white space', 'normalize labels', 'Low',
  count(DISTINCT {c}) - count(DISTINCT {lab}) FROM part_text
UNION ALL SELECT '{c}', 'one value only', 'remove column', 'Low',
  CASE WHEN count(DISTINCT {c}) = 1 THEN count(*) ELSE 0 END FROM part_text"""


@query("cleaning_suggestions", "SELECT * FROM (" + " UNION ALL ".join(
    _text_rules(c) for c in ("p_name", "p_brand", "p_type", "p_size_txt")) + """
UNION ALL SELECT 'made_date', 'dates stored as text', 'convert to datetime', 'Medium', count(*) FROM part_text
UNION ALL SELECT 'made_date', 'one value only', 'remove column', 'Low', count(*) FROM part_text
UNION ALL SELECT 'unit_cost', 'negative values', 'review for entry errors', 'Critical',
  count(*) FILTER (p_retailprice - 1200 < 0) FROM part_text
) WHERE n > 0""", derived=["part_text"])
def _(t):
    return clean.cleaning_suggestions(t.part_text.withColumns({
        "made_date": F.lit("2021-3-4"), "unit_cost": F.col("p_retailprice") - 1200}))


@query("apply_suggestions", """
SELECT p_partkey, lower(trim(p_name)) AS p_name, p_type, p_size, p_retailprice, CAST(p_size_txt AS DOUBLE) AS p_size_txt
FROM part_text""", derived=["part_text"])
def _(t):
    return clean.apply_suggestions(t.part_text, [
        {"column": "p_size_txt", "recommendation": "convert to numeric"},
        {"column": "p_name", "recommendation": "normalize labels"},
        {"column": "p_brand", "recommendation": "drop column or impute"},
        {"column": "gone", "recommendation": "convert to datetime"}])


@query("apply_fixes", "SELECT * REPLACE (CAST(p_size_txt AS DOUBLE) AS p_size_txt) FROM part_text", derived=["part_text"])
def _(t):
    return clean.apply_fixes(t.part_text, [
        {"column": "p_size_txt", "action": "to_numeric"}, {"column": "p_name", "action": "drop_na"}])


@query("quick_fix", "SELECT * REPLACE (coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM lineitem_gaps)) "
       "AS l_discount, coalesce(l_returnflag, 'Unknown') AS l_returnflag) FROM lineitem_gaps", derived=GAPS,
       doubles=["l_discount"])
def _(t):
    once = clean.quick_fix(t.lineitem_gaps, "l_discount", "Missing values")
    return clean.quick_fix(once, "l_returnflag", "Missing values")


@query("auto_clean", f"""
WITH d AS (SELECT DISTINCT * FROM orders_dups),
f AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM d)
SELECT o_orderkey, o_custkey, lower(o_orderstatus) AS o_orderstatus,
  greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), o_totalprice)) AS o_totalprice,
  o_orderdate, lower(o_orderpriority) AS o_orderpriority FROM d, f""", derived=["orders_dups"], doubles=["o_totalprice"])
def _(t):
    out = clean.auto_clean(t.orders_dups, remove_duplicates=True, missing="median", repair_types=True,
                           outliers="clip", text="lower")
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("o_orderkey", "o_custkey")})




# --- learned outlier detectors -------------------------------------------------------------


@query("outlier_isolation_forest")
def _(t):
    return outliers.outlier_isolation_forest(t.customer_outliers, "c_acctbal", ["c_custkey"]).select(
        "c_custkey", "c_acctbal", "is_outlier")


@query("outlier_lof", """
WITH p AS (SELECT c_custkey AS i, c_acctbal AS v FROM customer_outliers),
d AS (SELECT a.i, b.i AS j, abs(a.v - b.v) AS d, row_number() OVER (PARTITION BY a.i ORDER BY abs(a.v - b.v), b.v, b.i) AS r
      FROM p a JOIN p b ON a.i <> b.i),
nn AS (SELECT * FROM d WHERE r <= (SELECT least(20, greatest(5, count(*) // 20)) FROM p)),
kd AS (SELECT i, max(d) AS kd FROM nn GROUP BY i),
lrd AS (SELECT nn.i, 1 / (avg(greatest(kd.kd, nn.d)) + 1e-10) AS lrd FROM nn JOIN kd ON nn.j = kd.i GROUP BY nn.i),
lof AS (SELECT nn.i, avg(b.lrd) / a.lrd AS lof FROM nn JOIN lrd b ON nn.j = b.i JOIN lrd a ON nn.i = a.i GROUP BY nn.i, a.lrd)
SELECT c_custkey, c_acctbal, lof > (SELECT quantile_cont(lof, 0.95) FROM lof) AS is_outlier
FROM customer_outliers JOIN lof ON c_custkey = i""", derived=["customer_outliers"], doubles=["c_acctbal"])
def _(t):
    return outliers.outlier_lof(t.customer_outliers, "c_acctbal").select("c_custkey", "c_acctbal", "is_outlier")


@query("outlier_ensemble")
def _(t):
    return outliers.outlier_ensemble(t.customer_outliers, ["c_custkey"])


@query("quality_report_ensemble")
def _(t):
    rates = outliers.outlier_ensemble(t.customer_outliers, ["c_custkey"])
    return quality_report(t.customer_outliers, rates)
