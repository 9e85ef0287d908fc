"""Query shapes users may write over registered tables, and the ready-made templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.functions.quantiles import grouped_quantiles
from tablescope.operators import ordered, sqlapi
from tablescope.plans.registry import Tables, query

VIEWS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
         "pages", "benchmark", "labels", "conversations")


def _run(t: Tables, text: str):
    return sqlapi.sql_query(t.spark, text, {v: getattr(t, v) for v in VIEWS if v in text})


def shape(key: str, text: str, duck: str | None = None, doubles=(), ints=(), digits: int = 6):
    """Register a SQL text; ``duck`` is given where the dialects differ, ``ints`` are INTEGER in Spark."""
    twin = duck or text
    if ints:
        twin = f"SELECT * REPLACE ({', '.join(f'{i}::INTEGER AS {i}' for i in ints)}) FROM ({twin})"
    query(key, twin, doubles=doubles, digits=digits)(lambda t: _run(t, text))


# --- templates -----------------------------------------------------------------------------


@query("sql_query", "SELECT c_mktsegment, count(*) AS orders, sum(o_totalprice) AS total FROM customer JOIN orders "
       "ON c_custkey = o_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment", doubles=["total"], digits=2)
def _(t):
    return sqlapi.sql_query(
        t.spark, "SELECT c_mktsegment, count(*) AS orders, sum(o_totalprice) AS total FROM df JOIN other "
        "ON c_custkey = o_custkey WHERE o_totalprice > :least GROUP BY c_mktsegment",
        {"df": t.customer, "other": t.orders}, {"least": 1000})


query("sql_select_all", "SELECT * FROM supplier")(lambda t: sqlapi.sql_select_all(t.supplier))
query("sql_count", "SELECT count(*) AS total_rows FROM lineitem")(lambda t: sqlapi.sql_count(t.lineitem))
query("sql_group_by", "SELECT event_type, count(*) AS \"count\" FROM events GROUP BY event_type")(
    lambda t: sqlapi.sql_group_by(t.events, "event_type"))
query("sql_filter", "SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'")(
    lambda t: sqlapi.sql_filter(t.orders, "o_orderpriority", "1-URGENT"))
query("sql_top_n", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")(
    lambda t: sqlapi.sql_top_n(t.orders, "o_totalprice", 10, "o_orderkey"))
query("sql_distinct", "SELECT DISTINCT source FROM documents")(lambda t: sqlapi.sql_distinct(t.documents, "source"))


@query("sql_result_scatter", "SELECT sum(l_quantity) AS x, avg(l_extendedprice) AS y FROM lineitem GROUP BY l_suppkey",
       doubles=["x", "y"], digits=4)
def _(t):
    return sqlapi.sql_result_scatter(_run(
        t, "SELECT cast(l_suppkey AS string) AS supplier, sum(l_quantity) AS q, avg(l_extendedprice) AS p "
        "FROM lineitem GROUP BY l_suppkey"))


# --- joins ---------------------------------------------------------------------------------

shape("sql_inner_join", """
SELECT n_name, count(*) AS orders, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""", doubles=["total"], digits=2)
shape("sql_left_join", """
SELECT c_custkey, count(o_orderkey) AS orders, coalesce(sum(o_totalprice), 0) AS total
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""", doubles=["total"], digits=2)
shape("sql_full_join", """
SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nationkey, c.customers, s.suppliers
FROM (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY c_nationkey) c
FULL OUTER JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey) s
ON c.c_nationkey = s.s_nationkey""")
shape("sql_semi_join", "SELECT * FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
      "SELECT * FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
shape("sql_anti_join", "SELECT * FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'",
      "SELECT * FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'")


@query("sql_range_join", """
WITH m AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1)
SELECT month, count(*) AS shipped, sum(l_quantity) AS quantity FROM lineitem JOIN m ON l_shipdate BETWEEN lo AND hi
GROUP BY month""", doubles=["quantity"])
def _(t):
    months = t.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(
        F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    seconds = lambda c: F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c))
    day = 86400.0
    # many line items share a ship date: they are added up per date before the join
    per_date = t.lineitem.groupBy("l_shipdate").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    joined = ordered.range_join(per_date, months, seconds("l_shipdate"), seconds("lo"), seconds("hi"), 30 * day)
    return joined.groupBy("month").agg(F.sum("n").alias("shipped"), F.sum("q").alias("quantity"))


@query("sql_asof_join", """
WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'),
c AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
SELECT p.event_id, p.user_id, p.ts, c.ts AS asof_ts, c.value AS asof_value FROM p
ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts""", doubles=["asof_value"])
def _(t):
    bought = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = t.events.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return ordered.asof_join(bought, clicks, ["user_id"], "ts", "ts", ["value"])


# --- set operations, groupings -------------------------------------------------------------

shape("sql_union", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
shape("sql_union_all", "SELECT c_nationkey AS nationkey, c_acctbal AS balance FROM customer UNION ALL "
      "SELECT s_nationkey, s_acctbal FROM supplier")
shape("sql_intersect", "SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT "
      "SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
shape("sql_except", "SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
shape("sql_having", "SELECT l_suppkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_suppkey "
      "HAVING sum(l_quantity) > 15000")
shape("sql_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers "
      "FROM lineitem GROUP BY l_returnflag")
shape("distinct_multi", "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderdate) AS days, "
      "count(DISTINCT o_orderpriority) AS priorities FROM orders")
shape("sql_filter_agg", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS large, "
      "sum(value) FILTER (WHERE value <= 50) AS small_sum FROM events GROUP BY event_type", doubles=["small_sum"], digits=4)
shape("sql_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem "
      "GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
shape("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders "
      "GROUP BY CUBE (o_orderstatus, o_orderpriority)", doubles=["top"])
shape("sql_rollup", "SELECT p_type, p_brand, count(*) AS n, min(p_retailprice) AS cheapest FROM part "
      "GROUP BY ROLLUP (p_type, p_brand)", doubles=["cheapest"])


@query("sql_quantile", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag",
       doubles=["p90"])
def _(t):
    # percentile(...) in SQL text keeps a whole group in one task; this gives the same for groups of any size
    found = grouped_quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", [0.9])
    return found.select("l_returnflag", F.get("q", F.lit(0)).alias("p90"))


# --- windows -------------------------------------------------------------------------------

shape("sql_row_number", """
SELECT o_custkey, o_orderkey, n FROM (SELECT o_custkey, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3""", ints=["n"])
shape("sql_rank", "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r FROM orders",
      ints=["r"])
shape("sql_dense_rank", "SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) AS r "
      "FROM lineitem", ints=["r"])
shape("sql_ntile", "SELECT user_id, event_id, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS quarter FROM events",
      ints=["quarter"])
shape("sql_percent_rank", "SELECT user_id, event_id, percent_rank() OVER (PARTITION BY user_id ORDER BY value) AS pr, "
      "cume_dist() OVER (PARTITION BY user_id ORDER BY value) AS cd FROM events", doubles=["pr", "cd"])
shape("sql_lag_lead", "SELECT event_id, lag(event_type) OVER w AS before, lead(event_type, 1, 'end') OVER w AS after FROM events "
      "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
shape("sql_first_last_value", """
SELECT event_id, first_value(event_type) OVER w AS first, last_value(event_type) OVER w AS last, nth_value(event_type, 2) OVER w AS second
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
shape("sql_running_sum", "SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey "
      "ROWS UNBOUNDED PRECEDING) AS so_far FROM orders", doubles=["so_far"], digits=2)
shape("sql_moving_avg", "SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING "
      "AND CURRENT ROW) AS mean5 FROM events", doubles=["mean5"], digits=5)
shape("sql_range_frame", """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS last_day
FROM events""")

# --- subqueries and expressions ------------------------------------------------------------

shape("sql_cte", """
WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey),
     top AS (SELECT o_custkey FROM spend WHERE total > (SELECT avg(total) FROM spend))
SELECT c_mktsegment, count(*) AS big_spenders FROM customer JOIN top ON c_custkey = o_custkey GROUP BY c_mktsegment""")
shape("sql_in_subquery", "SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
shape("sql_exists", "SELECT * FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey "
      "AND o.o_totalprice > 250000)")
shape("sql_correlated_subquery", """
SELECT o_orderkey, o_totalprice FROM orders o
WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""")
shape("sql_case", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' "
      "ELSE 'high' END AS band FROM lineitem")
shape("sql_string_funcs", "SELECT p_partkey, substring(p_name, 1, 5) AS head, upper(p_type) AS kind, "
      "concat(p_brand, '/', p_type) AS label, length(p_name) AS size, replace(p_name, ' ', '_') AS slug FROM part", ints=["size"])
shape("sql_date_trunc", """
SELECT o_orderkey, cast(date_trunc('month', o_orderdate) AS timestamp_ntz) AS month, cast(extract(YEAR FROM o_orderdate) AS bigint) AS y,
  cast(datediff(o_orderdate, timestamp_ntz'1992-01-01') AS bigint) AS days FROM orders""", """
SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS month, extract(YEAR FROM o_orderdate)::BIGINT AS y,
  datediff('day', TIMESTAMP '1992-01-01', o_orderdate)::BIGINT AS days FROM orders""")
shape("sql_math_funcs", "SELECT l_orderkey, l_linenumber, ln(l_extendedprice) AS lg, power(l_discount, 2) AS sq, "
      "l_orderkey % 7 AS md, abs(l_tax - l_discount) AS gap, sqrt(l_quantity) AS root FROM lineitem",
      doubles=["lg", "sq", "gap", "root"])
shape("sql_json_extract", "SELECT event_id, cast(get_json_object(props, '$.k') AS bigint) AS k FROM events",
      "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
shape("sql_array_funcs", """
SELECT vec_id, size(embedding) AS n, cast(embedding[0] AS double) AS first,
  aggregate(embedding, cast(0 AS double), (a, x) -> a + x) AS total FROM embeddings""", """
SELECT vec_id, len(embedding)::INTEGER AS n, embedding[1]::DOUBLE AS first, list_sum(embedding::DOUBLE[]) AS total FROM embeddings""",
      doubles=["first", "total"], digits=5)
shape("sql_map_funcs", """
SELECT c_custkey, try_element_at(m, 'segment') AS segment, cardinality(m) AS entries
FROM (SELECT c_custkey, map('segment', c_mktsegment, 'name', c_name) AS m FROM customer)""", """
SELECT c_custkey, m['segment'] AS segment, cardinality(m)::INTEGER AS entries
FROM (SELECT c_custkey, MAP {'segment': c_mktsegment, 'name': c_name} AS m FROM customer)""")
shape("sql_pivot", """
SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders)
PIVOT (count(o_totalprice) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))""", """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o,
  count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
shape("sql_unpivot", """
SELECT l_orderkey, l_linenumber, measure, amount FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem)
UNPIVOT (amount FOR measure IN (l_quantity, l_tax))""", """
SELECT l_orderkey, l_linenumber, 'l_quantity' AS measure, l_quantity AS amount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""", doubles=["amount"])
shape("sql_order_limit_offset", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
