"""Moments, correlations, hypothesis tests, dependence and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import stats
from tablescope.plans.registry import LINEITEM, query, union_all

NUM = LINEITEM[:8]
GAPS = ["lineitem_gaps"]
_BIASED = "skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0))"


@query("statistical_summary", union_all(
    "SELECT '{c}' AS \"column\", avg({c}) AS mean, quantile_cont({c}::DOUBLE, 0.5) AS median, stddev_samp({c}) AS std, "
    + _BIASED + " AS skewness, kurtosis_pop({c}) AS kurtosis, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, "
    "quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM lineitem_gaps", NUM),
    derived=GAPS, doubles=["mean", "median", "std", "skewness", "kurtosis", "min", "max", "q1", "q3"], digits=5)
def _(t):
    return stats.statistical_summary(t.lineitem_gaps)


@query("skew_adjusted", union_all("SELECT '{c}' AS \"column\", skewness({c}) AS skew FROM lineitem_gaps", NUM),
       derived=GAPS, doubles=["skew"])
def _(t):
    return stats.skew_adjusted(t.lineitem_gaps)


_WIDE = NUM + ["l_twice", "l_const"]


def _corr(a: str, b: str, table: str) -> str:
    return (f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END AS corr "
            f"FROM {table}")


@query("correlation_matrix", " UNION ALL ".join(_corr(a, b, "lineitem_wide") for a in _WIDE for b in _WIDE),
       derived=["lineitem_wide"], doubles=["corr"])
def _(t):
    return stats.correlation_matrix(t.lineitem_wide)


@query("correlation_matrix_gaps", " UNION ALL ".join(_corr(a, b, "lineitem_gaps") for a in NUM for b in NUM),
       derived=GAPS, doubles=["corr"])
def _(t):
    return stats.correlation_matrix(t.lineitem_gaps)


@query("top_correlations", "SELECT a, b, corr, CASE WHEN abs(corr) > 0.7 THEN 'strong' WHEN abs(corr) > 0.4 THEN 'moderate' "
       "ELSE 'weak' END AS strength, CASE WHEN corr > 0 THEN 'positive' ELSE 'negative' END AS direction FROM ("
       + " UNION ALL ".join(_corr(a, b, "lineitem") for i, a in enumerate(NUM) for b in NUM[i + 1:])
       + ") ORDER BY abs(corr) DESC LIMIT 5", doubles=["corr"])
def _(t):
    return stats.top_correlations(t.lineitem)


_EV = ["event_id", "user_id", "value"]


@query("normality_test", "WITH s AS (" + union_all(
    "SELECT '{c}' AS \"column\", count({c})::DOUBLE AS n, " + _BIASED + " AS g1, kurtosis_pop({c}) AS g2 FROM events", _EV) + """),
z AS (SELECT "column", n, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
  3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
  (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b FROM s),
w AS (SELECT *, -1 + sqrt(2 * (beta - 1)) AS w2, 6 + 8 / b * (2 / b + sqrt(1 + 4 / (b * b))) AS a FROM z),
k AS (SELECT "column", asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1,
  (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM w)
SELECT "column", 'D''Agostino-Pearson' AS test, z1 * z1 + z2 * z2 AS statistic, exp(-(z1 * z1 + z2 * z2) / 2) AS p_value,
  exp(-(z1 * z1 + z2 * z2) / 2) > 0.05 AS is_normal FROM k""", doubles=["statistic", "p_value"], digits=4)
def _(t):
    return stats.normality_test(t.events, method="dagostino")


@query("normality_test_shapiro")
def _(t):
    return stats.normality_test(t.supplier, method="shapiro")


@query("normality_test_ks")
def _(t):
    return stats.normality_test(t.lineitem, method="ks")


@query("normality_test_large")
def _(t):
    return stats.normality_test(t.lineitem, method="dagostino")


# two-sided tail of the t distribution: Simpson's rule on its density
_T_TAIL = """(SELECT 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * least(abs(statistic), 40) / 12000
  * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
        * (1 + (least(abs(statistic), 40) * i / 4000) ** 2 / df) ** (-(df + 1) / 2)) FROM range(4001) x(i))"""


@query("ttest_ind", f"""
WITH m AS (SELECT count(l_tax) AS n0, avg(l_tax) AS m0, var_samp(l_tax) AS v0, count(l_discount) AS n1, avg(l_discount) AS m1,
  var_samp(l_discount) AS v1 FROM lineitem_gaps),
t AS (SELECT (m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1 / n0 + 1 / n1)) AS statistic,
  (n0 + n1 - 2)::DOUBLE AS df FROM m), p AS (SELECT *, {_T_TAIL} AS p_value FROM t)
SELECT 'l_tax' AS column_a, 'l_discount' AS column_b, statistic, df, p_value, p_value < 0.05 AS significant FROM p""",
       derived=GAPS, doubles=["statistic", "df", "p_value"])
def _(t):
    return stats.ttest_ind(t.lineitem_gaps, "l_tax", "l_discount")


def _anova(groups: str, labels: str) -> str:
    """Of three groups: F with two numerator degrees of freedom has a tail in closed form."""
    return f"""
WITH g AS ({groups}), t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS gm, sum((n - 1) * v) AS within FROM g),
f AS (SELECT *, (SELECT sum(g.n * (g.m - t.gm) ** 2) FROM g, t) / (k - 1) / (within / (n - k)) AS statistic FROM t),
p AS (SELECT *, CASE WHEN k = 3 THEN (1 + 2 * statistic / (n - k)) ** (-(n - k) / 2) END AS p_value FROM f)
SELECT {labels}, k AS groups, statistic, (k - 1)::DOUBLE AS df_between, (n - k)::DOUBLE AS df_within, p_value,
  p_value < 0.05 AS significant FROM p"""


@query("anova_groups", _anova(
    "SELECT count(l_extendedprice) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem_gaps "
    "WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag",
    "'l_extendedprice' AS target_column, 'l_returnflag' AS group_column"), derived=GAPS, doubles=["statistic", "p_value"])
def _(t):
    return stats.anova_groups(t.lineitem_gaps, "l_extendedprice", "l_returnflag")


@query("anova_columns", _anova(
    union_all("SELECT count({c}) AS n, avg({c}) AS m, var_samp({c}) AS v FROM lineitem_gaps",
              ["l_quantity", "l_discount", "l_tax"]), "'l_quantity,l_discount,l_tax' AS columns"),
    derived=GAPS, doubles=["statistic", "p_value"], digits=2)
def _(t):
    return stats.anova_columns(t.lineitem_gaps, ["l_quantity", "l_discount", "l_tax"])


def _chi(table: str, a: str, b: str, yates: bool) -> str:
    d = "abs(coalesce(o, 0) - ra * cb / n)"
    term = f"({d} - least(0.5, {d})) ** 2" if yates else f"{d} ** 2"
    return f"""
WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {table} GROUP BY ALL),
r AS (SELECT a, sum(o) AS ra FROM c GROUP BY a), s AS (SELECT b, sum(o) AS cb FROM c GROUP BY b),
e AS (SELECT r.a, s.b, ra, cb, o, (SELECT sum(o) FROM c)::DOUBLE AS n FROM r CROSS JOIN s LEFT JOIN c ON c.a = r.a AND c.b = s.b)
SELECT '{a}' AS column_a, '{b}' AS column_b, sum({term} / (ra * cb / n)) AS statistic,
  ((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1))::DOUBLE AS df FROM e"""


@query("chi_square", _chi("orders", "o_orderstatus", "o_orderpriority", False), doubles=["statistic"])
def _(t):
    return stats.chi_square(t.orders).select("column_a", "column_b", "statistic", "df")


@query("chi_square_yates", _chi("labels", "quality", "toxic", True), doubles=["statistic"])
def _(t):
    return stats.chi_square(t.labels, "quality", "toxic").select("column_a", "column_b", "statistic", "df")


def _swept(names: list[str]) -> str:
    """The sums of products of ``names`` swept on every one of them: minus their inverse."""
    sums = union_all("SELECT {c}", [
        f"{i} AS i, {j} AS j, sum({a}::DOUBLE * {b}) AS v FROM x" for i, a in enumerate(names) for j, b in enumerate(names)])
    steps = [f"s{k + 1} AS (SELECT m.i, m.j, CASE WHEN m.i = {k} AND m.j = {k} THEN -1 / d.v WHEN m.i = {k} OR m.j = {k} THEN m.v / d.v "
             f"ELSE m.v - r.v * c.v / d.v END AS v FROM s{k} m JOIN s{k} r ON r.i = m.i AND r.j = {k} "
             f"JOIN s{k} c ON c.i = {k} AND c.j = m.j JOIN s{k} d ON d.i = {k} AND d.j = {k})" for k in range(len(names))]
    return f"s0 AS ({sums}), " + ", ".join(steps)


@query("vif", "WITH x AS (SELECT * FROM lineitem_gaps WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in NUM) + "), " + _swept(NUM)
       + f", v AS (SELECT ({NUM})[s0.i + 1] AS \"column\", -s0.v * s{len(NUM)}.v AS vif FROM s0 JOIN s{len(NUM)} USING (i, j) "
       "WHERE s0.i = s0.j) SELECT \"column\", round(vif, 3) + 0.0 AS vif, "
       "CASE WHEN vif > 10 THEN 'High' WHEN vif > 5 THEN 'Medium' ELSE 'Low' END AS risk FROM v", derived=GAPS)
def _(t):
    return stats.vif(t.lineitem_gaps)


_MI = {c: c in NUM for c in LINEITEM[:10]}
_EDGES = "[" + ", ".join(f"{i / 10}" for i in range(1, 10)) + "]"
_MI_PAIRS = [(a, b) for i, a in enumerate(_MI) for b in list(_MI)[i + 1:]]


@query("mutual_info", "WITH x AS (SELECT * FROM lineitem_gaps WHERE "
       + " AND ".join(f"{c} IS NOT NULL" for c in _MI) + "), e AS (SELECT "
       + ", ".join(f"quantile_cont({c}, {_EDGES}) AS e_{c}" for c, n in _MI.items() if n) + " FROM x), d AS (SELECT "
       + ", ".join(f"len(list_filter(list_distinct(e_{c}), lambda q: q < {c}))::VARCHAR AS {c}" if n else c for c, n in _MI.items())
       + " FROM x, e), p AS ("
       + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y, count(*)::DOUBLE AS o FROM d GROUP BY ALL"
                            for a, b in _MI_PAIRS) + """),
m AS (SELECT a, b, o, sum(o) OVER (PARTITION BY a, b) AS n, sum(o) OVER (PARTITION BY a, b, x) AS ox,
  sum(o) OVER (PARTITION BY a, b, y) AS oy FROM p)
SELECT a, b, sum(o / n * ln(o * n / (ox * oy))) AS mutual_info FROM m GROUP BY a, b""", derived=GAPS, doubles=["mutual_info"])
def _(t):
    return stats.mutual_info(t.lineitem_gaps)


# --- drift ---------------------------------------------------------------------------------


def _halves(t):
    first = t.events.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    second = t.events.where(F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).withColumn("value", F.col("value") * 1.5)
    return first, second


@query("baseline_stats", union_all(
    "SELECT '{c}' AS \"column\", avg({c}) AS mean, stddev_samp({c}) AS std FROM lineitem_gaps", NUM),
    derived=GAPS, doubles=["mean", "std"], digits=5)
def _(t):
    return stats.baseline_stats(t.lineitem_gaps)


@query("drift_join", """
SELECT 'value' AS "column", c AS current_mean, b AS baseline_mean, abs(c - b) AS mean_shift FROM (
  SELECT avg(value * 1.5) FILTER (ts >= '2024-01-16') AS c, avg(value) FILTER (ts < '2024-01-16') AS b FROM events)""",
       doubles=["current_mean", "baseline_mean", "mean_shift"])
def _(t):
    first, second = _halves(t)
    return stats.mean_shift(second, stats.baseline_stats(first, ["value"]))


@query("drift_ks")
def _(t):
    first, second = _halves(t)
    return stats.drift_ks(second, stats.baseline_stats(first, ["value", "user_id"]))
