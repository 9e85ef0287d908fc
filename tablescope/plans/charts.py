"""Chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import chartdata as ch
from tablescope.plans.registry import LINEITEM, query, union_all

GAPS = ["lineitem_gaps"]
NUM = LINEITEM[:8]
LKEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# --- series and points ---------------------------------------------------------------------

_PER = "SELECT {x}, {f}({y}) AS {y} FROM {t} WHERE {x} IS NOT NULL GROUP BY {x}"


@query("bar_data", "SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS l_extendedprice FROM lineitem_gaps "
       "WHERE l_returnflag IS NOT NULL GROUP BY ALL", derived=GAPS, doubles=["l_extendedprice"], digits=4)
def _(t):
    return ch.bar_data(t.lineitem_gaps, "l_returnflag", "l_extendedprice", color="l_linestatus", agg="mean", sort="desc")


@query("line_data", _PER.format(x="o_orderdate", f="sum", y="o_totalprice", t="orders"), doubles=["o_totalprice"], digits=2)
def _(t):
    return ch.line_data(t.orders, "o_orderdate", "o_totalprice", agg="sum")


@query("area_data", _PER.format(x="l_shipdate", f="sum", y="l_quantity", t="lineitem"), doubles=["l_quantity"])
def _(t):
    return ch.area_data(t.lineitem, "l_shipdate", "l_quantity", agg="sum")


@query("radar_data", _PER.format(x="p_type", f="max", y="p_retailprice", t="part"), doubles=["p_retailprice"])
def _(t):
    return ch.radar_data(t.part, "p_type", "p_retailprice", agg="max")


@query("funnel_data", _PER.format(x="event_type", f="count", y="event_id", t="events"))
def _(t):
    return ch.funnel_data(t.events, "event_type", "event_id", agg="count", sort="desc")


@query("median_line_data", "SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS p_retailprice FROM part GROUP BY p_brand",
       doubles=["p_retailprice"])
def _(t):
    return ch.line_data(t.part, "p_brand", "p_retailprice", agg="median")


query("scatter_points")(lambda t: ch.scatter_points(t.lineitem, "l_quantity", "l_extendedprice", color="l_returnflag", key=LKEY))
query("bubble_points")(lambda t: ch.bubble_points(t.lineitem, "l_quantity", "l_extendedprice", size="l_discount", key=LKEY))
query("scatter3d_points")(lambda t: ch.scatter3d_points(t.lineitem, "l_quantity", "l_extendedprice", z="l_tax", key=LKEY))
query("parallel_coords_data")(lambda t: ch.parallel_coords_data(
    t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag", key=LKEY))

# --- distributions -------------------------------------------------------------------------


def _bins(c: str, n: int, extra: str = "") -> str:
    keep, group = (f"{extra}, ", f"{extra}, ") if extra else ("", "")
    return f"""
SELECT '{c}' AS "column", {keep}bin, lo + bin * ((hi - lo) / {n}) AS bin_start, lo + (bin + 1) * ((hi - lo) / {n}) AS bin_end,
  count(*) AS "count" FROM (SELECT {keep}lo, hi, least(floor(({c} - lo) * {n} / (hi - lo)), {n - 1})::INTEGER AS bin
  FROM lineitem_gaps, (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM lineitem_gaps) WHERE {c} IS NOT NULL) GROUP BY {group}lo, hi, bin"""


@query("histogram_data", union_all(_bins("{c}", 30), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
       derived=GAPS, doubles=["bin_start", "bin_end"])
def _(t):
    return ch.histogram_data(t.lineitem_gaps, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("histogram_by_color", _bins("l_extendedprice", 10, "l_returnflag"), derived=GAPS, doubles=["bin_start", "bin_end"])
def _(t):
    return ch.histogram_data(t.lineitem_gaps, ["l_extendedprice"], 10, "l_returnflag")


@query("box_data", """
WITH d AS (SELECT l_returnflag, l_extendedprice AS y FROM lineitem_gaps WHERE l_returnflag IS NOT NULL),
q AS (SELECT l_returnflag, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.75) AS q3 FROM d GROUP BY 1),
j AS (SELECT *, y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM d JOIN q USING (l_returnflag))
SELECT l_returnflag, q1, median, q3, min(y) FILTER (ok) AS whisker_low, max(y) FILTER (ok) AS whisker_high,
  count(*) FILTER (NOT ok) AS outliers, count(*) AS n FROM j GROUP BY l_returnflag, q1, median, q3""", derived=GAPS,
       doubles=["q1", "median", "q3", "whisker_low", "whisker_high"])
def _(t):
    return ch.box_data(t.lineitem_gaps, "l_extendedprice", "l_returnflag")


def _density(table: str, key: str, value: str, bins: int, where: str = "true") -> str:
    return f"""
SELECT k AS {key}, bin, lo + (bin + 0.5) * w AS center, count(*) AS "count", count(*) / (n * w) AS density FROM (
  SELECT k, lo, (hi - lo) / {bins} AS w, n, least(floor((v - lo) * {bins} / (hi - lo)), {bins - 1})::INTEGER AS bin
  FROM (SELECT {key} AS k, {value} AS v FROM {table} WHERE {key} IS NOT NULL AND {where})
  JOIN (SELECT {key} AS k, min({value}) AS lo, max({value}) AS hi, count(*) AS n FROM {table} GROUP BY 1) USING (k))
GROUP BY k, bin, lo, w, n"""


@query("violin_data", _density("lineitem_gaps", "l_returnflag", "l_extendedprice", 30), derived=GAPS,
       doubles=["center", "density"], digits=8)
def _(t):
    return ch.violin_data(t.lineitem_gaps, "l_extendedprice", "l_returnflag")


@query("ridge_data", _density("part", "p_brand", "p_retailprice", 40, "p_brand IN (SELECT p_brand FROM part GROUP BY p_brand "
       "HAVING count(*) >= 10 ORDER BY count(*) DESC, p_brand LIMIT 8)"), doubles=["center", "density"], digits=8)
def _(t):
    return ch.ridge_data(t.part, "p_retailprice", "p_brand")


@query("density2d_data", """
SELECT x_bin, y_bin, count(*) AS "count" FROM (
  SELECT least(floor((l_quantity - x0) * 30 / (x1 - x0)), 29)::INTEGER AS x_bin,
         least(floor((l_extendedprice - y0) * 30 / (y1 - y0)), 29)::INTEGER AS y_bin
  FROM lineitem, (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1
                  FROM lineitem)) GROUP BY x_bin, y_bin""")
def _(t):
    return ch.density2d_data(t.lineitem, "l_quantity", "l_extendedprice")


# --- parts of a whole ----------------------------------------------------------------------


@query("pie_data", "SELECT source AS value, count(*) AS \"count\" FROM documents GROUP BY source ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return ch.pie_data(t.documents, "source")


@query("treemap_data", "SELECT p_brand AS label, sum(p_retailprice) AS value, sum(p_retailprice * p_retailprice) / sum(p_retailprice) "
       "AS color FROM part GROUP BY p_brand", doubles=["value", "color"], digits=4)
def _(t):
    return ch.treemap_data(t.part, "p_brand", "p_retailprice")


@query("sunburst_data", "SELECT p_type, p_brand, sum(p_size)::DOUBLE AS value FROM part "
       "GROUP BY GROUPING SETS ((p_type), (p_type, p_brand))")
def _(t):
    return ch.sunburst_data(t.part, ["p_type", "p_brand"], "p_size")


@query("category_bar", union_all("""
SELECT * FROM (SELECT '{c}' AS "column", row_number() OVER (ORDER BY count(*) DESC, coalesce({c}, 'None'))::INTEGER AS rank,
  coalesce({c}, 'None') AS value, count(*) AS "count" FROM lineitem_gaps GROUP BY {c}) WHERE rank <= 10""",
    ["l_returnflag", "l_linestatus"]), derived=GAPS)
def _(t):
    return ch.category_bar(t.lineitem_gaps, with_null=True)


@query("missing_bar", "SELECT * FROM (" + union_all(
    "SELECT '{c}' AS \"column\", 100.0 * (count(*) - count({c})) / count(*) AS missing_pct FROM lineitem_gaps", LINEITEM)
    + ") WHERE missing_pct > 0", derived=GAPS, doubles=["missing_pct"])
def _(t):
    return ch.missing_bar(t.lineitem_gaps)


# --- relations -----------------------------------------------------------------------------


def _corr(pairs, table: str, columns: str = "a, b, corr") -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM {table}" for a, b in pairs)


@query("heatmap_data", _corr([(a, b) for a in NUM for b in NUM], "lineitem"), doubles=["corr"])
def _(t):
    return ch.heatmap_data(t.lineitem)


@query("correlation_network", "SELECT a, b, abs(corr) AS weight FROM (" + _corr(
    [(a, b) for i, a in enumerate(NUM + ["l_twice"]) for b in (NUM + ["l_twice"])[i + 1:]], "lineitem_wide")
    + ") WHERE abs(corr) >= 0.5", derived=["lineitem_wide"], doubles=["weight"])
def _(t):
    return ch.correlation_network(t.lineitem_wide.drop("l_const"), 0.5)


@query("sankey_data", """
WITH l AS (SELECT o_orderpriority AS source, o_orderstatus AS target, sum(o_totalprice) AS value FROM orders GROUP BY ALL),
n AS (SELECT node, (row_number() OVER (ORDER BY node) - 1)::INTEGER AS i FROM (SELECT source AS node FROM l UNION SELECT target FROM l))
SELECT source, target, value, a.i AS source_index, b.i AS target_index FROM l JOIN n a ON source = a.node JOIN n b ON target = b.node""",
       doubles=["value"], digits=2)
def _(t):
    return ch.sankey_data(t.orders, "o_orderpriority", "o_orderstatus", "o_totalprice")


@query("timeline_data", """
SELECT user_id, min(ts) AS first, max(ts) AS last, floor(epoch(max(ts) - min(ts)))::BIGINT AS seconds FROM events GROUP BY user_id""")
def _(t):
    spans = t.events.groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return ch.timeline_data(spans, "first", "last", "user_id")


@query("facet", "SELECT o_orderpriority, sum(o_totalprice) AS o_totalprice, o_orderstatus FROM orders "
       "WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY ALL", doubles=["o_totalprice"], digits=2)
def _(t):
    return ch.facet(ch.bar_data, t.orders, "o_orderstatus", x="o_orderpriority", y="o_totalprice", agg="sum")


@query("recommend_chart", "SELECT value, count(*) AS \"count\" FROM (SELECT o_orderstatus AS value FROM orders) GROUP BY value")
def _(t):
    kind, (name, *_) = ch.recommend_chart(t.orders.select("o_orderstatus", "o_orderpriority"))
    assert kind == "bar"
    return ch.pie_data(t.orders, name)


@query("dashboard")
def _(t):
    return ch.dashboard(t.lineitem_gaps, key=LKEY)
