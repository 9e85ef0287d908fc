"""Sources, dataset store, projections, filters, aggregates, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.functions.columns import long_agg
from tablescope.operators import aggregate as agg
from tablescope.operators import clean, fuzzy, ordered, project
from tablescope.operators import profile as prof
from tablescope.plans.registry import LINEITEM, query, union_all
from tablescope.sources import io, store

# --- sources, sinks, dataset store ---------------------------------------------------------


@query("read_csv", "SELECT * FROM customer")
def _(t):
    path = store.scratch_dir(t.spark)
    io.export_csv(t.customer, path)
    return io.read_csv(t.spark, path, t.customer.schema)


@query("read_json", "SELECT * FROM orders")
def _(t):
    path = store.scratch_dir(t.spark)
    io.export_json(t.orders, path)
    return io.read_json(t.spark, path, t.orders.schema)


@query("read_parquet", "SELECT * FROM part")
def _(t):
    return io.read_parquet(t.spark, f"{t.folder}/part.parquet")


@query("write_dataset", "SELECT 'customers' AS name, count(*) AS rows, 5::INTEGER AS n_columns FROM customer")
def _(t):
    root = store.scratch_dir(t.spark)
    store.write_dataset(t.customer, root, "customers")
    return store.list_datasets(t.spark, root).select("name", "rows", "n_columns")


@query("dataset_info", "SELECT position, name, dtype, non_null FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS name, '{d}' AS dtype, count({c}) AS non_null FROM lineitem_gaps"
    for i, (c, d) in enumerate(zip(LINEITEM, [
        "bigint", "bigint", "bigint", "int", "double", "double", "double", "double", "string", "string",
        "timestamp_ntz"]))) + ")", derived=["lineitem_gaps"])
def _(t):
    return prof.dataset_info(t.lineitem_gaps)


@query("save_version", "SELECT 'raw' AS note, count(*) AS rows, 5::INTEGER AS n_columns FROM customer")
def _(t):
    root = store.scratch_dir(t.spark)
    store.save_version(t.customer, root, "customers", "raw")
    return store.version_history(t.spark, root, "customers").select("note", "rows", "n_columns")


@query("version_history", "SELECT 'raw' AS note, count(*) AS rows, 6::INTEGER AS n_columns FROM orders_dups "
       "UNION ALL SELECT 'deduplicated', count(*), 6 FROM orders", derived=["orders_dups"])
def _(t):
    root = store.scratch_dir(t.spark)
    store.save_version(t.orders_dups, root, "orders", "raw")
    store.save_version(agg.drop_duplicates(t.orders_dups), root, "orders", "deduplicated")
    return store.version_history(t.spark, root, "orders").select("note", "rows", "n_columns")


@query("restore_version", "SELECT * FROM orders_dups", derived=["orders_dups"])
def _(t):
    root = store.scratch_dir(t.spark)
    first = store.save_version(t.orders_dups, root, "orders", "raw")
    store.save_version(agg.drop_duplicates(t.orders_dups), root, "orders", "deduplicated")
    return store.restore_version(t.spark, root, "orders", first)


@query("undo", "SELECT * FROM customer")
def _(t):
    root = store.scratch_dir(t.spark)
    store.save_version(t.customer, root, "customers", "before dropping a column")
    store.write_dataset(project.drop_columns(t.customer, ["c_name"]), root, "customers")
    return store.undo(t.spark, root, "customers")


@query("dataset_diff", """
SELECT item, metric, before, after, round(after - before, 6) + 0.0 AS delta FROM (
  SELECT 'table' AS item, 'rows' AS metric, (SELECT count(*) FROM lineitem_gaps)::DOUBLE AS before,
         (SELECT count(*) FROM lineitem_gaps WHERE l_tax IS NOT NULL)::DOUBLE AS after
  UNION ALL SELECT 'table', 'columns', 11.0, 11.0
  UNION ALL SELECT 'table', 'missing_cells',
    (SELECT count(*) * 3 - count(l_discount) - count(l_tax) - count(l_returnflag) FROM lineitem_gaps)::DOUBLE,
    (SELECT count(*) - count(l_returnflag) FROM lineitem_gaps WHERE l_tax IS NOT NULL)::DOUBLE
  UNION ALL SELECT 'table', 'duplicate_rows',
    (SELECT count(*) FROM lineitem_gaps)::DOUBLE - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem_gaps)),
    (SELECT count(*) FROM lineitem_gaps WHERE l_tax IS NOT NULL)::DOUBLE
      - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem_gaps WHERE l_tax IS NOT NULL))
  UNION ALL SELECT 'l_discount', 'missing_pct',
    (SELECT round(100.0 * (count(*) - count(l_discount)) / count(*), 2) FROM lineitem_gaps), 0.0
  UNION ALL SELECT 'l_tax', 'missing_pct',
    (SELECT round(100.0 * (count(*) - count(l_tax)) / count(*), 2) FROM lineitem_gaps), 0.0
  UNION ALL SELECT 'l_returnflag', 'missing_pct',
    (SELECT round(100.0 * (count(*) - count(l_returnflag)) / count(*), 2) FROM lineitem_gaps),
    (SELECT round(100.0 * (count(*) - count(l_returnflag)) / count(*), 2) FROM lineitem_gaps WHERE l_tax IS NOT NULL)
  UNION ALL SELECT 'l_linestatus', 'removed column', 1.0, 0.0
  UNION ALL SELECT 'l_status', 'added column', 0.0, 1.0
  UNION ALL SELECT 'l_linenumber', 'changed type', 1.0, 1.0)
""", derived=["lineitem_gaps"])
def _(t):
    after = project.drop_missing(t.lineitem_gaps, ["l_tax"]).withColumnRenamed("l_linestatus", "l_status")
    after = clean.convert_type(clean.impute(after, "mean", ["l_discount"]), "l_linenumber", "int64")
    return store.dataset_diff(t.lineitem_gaps, after)


@query("dataset_fingerprint")
def _(t):
    return store.dataset_fingerprint(t.lineitem)


@query("export_csv", "SELECT * FROM orders")
def _(t):
    path = store.scratch_dir(t.spark)
    io.export_csv(t.orders, path)
    return io.read_csv(t.spark, path, t.orders.schema)


@query("export_json", "SELECT * FROM lineitem_gaps", derived=["lineitem_gaps"])
def _(t):
    path = store.scratch_dir(t.spark)
    io.export_json(t.lineitem_gaps, path)
    return io.read_json(t.spark, path, t.lineitem_gaps.schema)


@query("export_pivot_csv", """
SELECT o_orderpriority,
       coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0) AS "o_totalprice_F",
       coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0) AS "o_totalprice_O",
       coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0) AS "o_totalprice_P"
FROM orders GROUP BY o_orderpriority""", doubles=['"o_totalprice_F"', '"o_totalprice_O"', '"o_totalprice_P"'], digits=2)
def _(t):
    path = store.scratch_dir(t.spark)
    table = io.export_pivot_csv(t.orders, path, ["o_orderpriority"], ["o_orderstatus"], ["o_totalprice"])
    return io.read_csv(t.spark, path, table.schema)


@query("export_query_result", "SELECT c_mktsegment, count(*) AS customers FROM customer GROUP BY c_mktsegment")
def _(t):
    from tablescope.operators.sqlapi import sql_query
    path = store.scratch_dir(t.spark)
    result = sql_query(t.spark, "SELECT c_mktsegment, count(*) AS customers FROM df GROUP BY c_mktsegment",
                       {"df": t.customer})
    io.export_query_result(result, path)
    return io.read_csv(t.spark, path, result.schema)


@query("apply_recipe", """
SELECT p_partkey, regexp_replace(lower(trim(p_name)), '\\s+', ' ', 'g') AS label, p_brand, p_type,
       p_retailprice, CAST(p_size_txt AS double) AS p_size_txt FROM part_text""", derived=["part_text"])
def _(t):
    return clean.apply_recipe(t.part_text, [
        ("normalize_labels", {"column": "p_name"}), ("to_numeric", {"column": "p_size_txt"}),
        ("rename", {"column": "p_name", "new": "label"}), ("drop_columns", {"columns": ["p_size"]})])


@query("compact_types", " UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", CASE WHEN min({c}) >= -128 AND max({c}) < 128 THEN 'tinyint' "
     f"WHEN min({c}) >= -32768 AND max({c}) < 32768 THEN 'smallint' "
     f"WHEN min({c}) >= -2147483648 AND max({c}) < 2147483648 THEN 'int' ELSE 'bigint' END AS compact_type FROM lineitem"
     for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    + [f"SELECT '{c}', CASE WHEN count(*) FILTER (CAST(CAST({c} AS float) AS double) <> {c}) = 0 THEN 'float' "
       f"ELSE 'double' END FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    + [f"SELECT '{c}', CASE WHEN count(DISTINCT {c}) < 0.5 * count(*) THEN 'dictionary text' ELSE 'text' END "
       f"FROM lineitem" for c in ("l_returnflag", "l_linestatus")]))
def _(t):
    return io.compact_plan(t.lineitem)


@query("compact_types_cast", " UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", CASE WHEN min({c}) >= -128 AND max({c}) < 128 THEN 'tinyint' "
     f"WHEN min({c}) >= -32768 AND max({c}) < 32768 THEN 'smallint' "
     f"WHEN min({c}) >= -2147483648 AND max({c}) < 2147483648 THEN 'int' ELSE 'bigint' END AS dtype, "
     f"count({c}) AS held, sum({c})::DOUBLE AS total FROM lineitem_gaps"
     for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    + [f"SELECT '{c}', CASE WHEN count(*) FILTER (CAST(CAST({c} AS float) AS double) <> {c}) = 0 THEN 'float' "
       f"ELSE 'double' END, count({c}), sum({c}) FROM lineitem_gaps" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    + [f"SELECT '{c}', 'string', count({c}), sum(length({c}))::DOUBLE FROM lineitem_gaps" for c in ("l_returnflag", "l_linestatus")]),
    derived=["lineitem_gaps"], doubles=["total"], digits=2)
def _(t):
    cast = io.compact_types(t.lineitem_gaps.select(LINEITEM[:10]))
    kinds = dict(cast.dtypes)
    return long_agg(cast, cast.columns, {
        "dtype": lambda c: F.max(F.lit(kinds[c])), "held": F.count,
        "total": lambda c: F.sum((F.length(c) if kinds[c] == "string" else F.col(c)).cast("double"))})


@query("preview_head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def _(t):
    return io.preview_head(t.orders, 10, ["o_orderkey"])


@query("preview_tail", "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 10")
def _(t):
    return io.preview_tail(t.orders, 10, ["o_orderkey"])


@query("sample_rows")
def _(t):
    return io.sample_rows(t.lineitem, 500)


# --- projection and filters ----------------------------------------------------------------


@query("rename_column", "SELECT * RENAME (c_name AS customer_name) FROM customer")
def _(t):
    return project.rename_column(t.customer, "c_name", " customer_name ")


@query("drop_columns", "SELECT * EXCLUDE (l_tax, l_discount) FROM lineitem")
def _(t):
    return project.drop_columns(t.lineitem, ["l_tax", "l_discount", "not_there"])


@query("reorder_columns", "SELECT c_mktsegment, c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def _(t):
    return project.reorder_columns(t.customer, ["c_mktsegment", "c_custkey"])


@query("add_constant", "SELECT *, 'batch-1' AS source FROM customer")
def _(t):
    return project.add_constant(t.customer, "source", "batch-1")


@query("select_features", "SELECT l_quantity, l_discount, l_tax FROM lineitem")
def _(t):
    return project.select_features(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


@query("select_by_family", "SELECT o_orderstatus, o_orderpriority FROM orders")
def _(t):
    return project.select_by_family(t.orders, "categorical")


_NUMBERS = "regexp_matches({c}, '^\\s*[+-]?((\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?|inf|infinity)\\s*$', 'i')"
_FEW = "coalesce(count(DISTINCT {c}) / count(*) < 0.05, false)"


@query("column_types", " UNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", 'numeric' AS family, true AS looks_numeric, "
     f"{_FEW.replace('{c}', c)} AS looks_categorical, false AS looks_datetime FROM part_text"
     for c in ("p_partkey", "p_size", "p_retailprice")]
    + [f"SELECT '{c}', 'categorical', count(*) FILTER (NOT {_NUMBERS.replace('{c}', c)}) = 0, true, false "
       "FROM part_text" for c in ("p_name", "p_brand", "p_type", "p_size_txt")]), derived=["part_text"])
def _(t):
    return project.column_types(t.part_text, "content")


@query("filter_range", "SELECT * FROM orders WHERE o_totalprice BETWEEN 50000 AND 150000")
def _(t):
    return project.filter_range(t.orders, "o_totalprice", 50000.0, 150000.0)


@query("filter_in", "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(t):
    return project.filter_in(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("filter_date_range", "SELECT * FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1996-01-01'")
def _(t):
    return project.filter_date_range(t.orders, "1995-01-01", "1995-12-31")


@query("filter_categories", "SELECT * FROM lineitem_gaps WHERE coalesce(l_returnflag, 'None') IN ('A', 'None') "
       "AND l_linestatus = 'F'", derived=["lineitem_gaps"])
def _(t):
    return project.filter_categories(t.lineitem_gaps, {"l_returnflag": ["A", "None"], "l_linestatus": ["F"]})


@query("filter_numeric_ranges", "SELECT * FROM lineitem_gaps WHERE l_quantity BETWEEN 10 AND 40 "
       "AND l_discount BETWEEN 0.02 AND 0.06 AND l_tax IS NOT NULL", derived=["lineitem_gaps"])
def _(t):
    return project.filter_numeric_ranges(t.lineitem_gaps, {"l_quantity": (10, 40), "l_discount": (0.02, 0.06)})


@query("apply_filters", "SELECT * FROM lineitem WHERE l_shipdate >= '1994-01-01' AND l_shipdate < '1997-01-01' "
       "AND l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 5 AND 30")
def _(t):
    return project.apply_filters(
        t.lineitem, dates=("1994-01-01", "1996-12-31"), categories={"l_returnflag": ["A", "R"]},
        ranges={"l_quantity": (5, 30)})


@query("drop_missing", "SELECT * FROM lineitem_gaps WHERE l_tax IS NOT NULL AND l_discount IS NOT NULL",
       derived=["lineitem_gaps"])
def _(t):
    return project.drop_missing(t.lineitem_gaps, ["l_tax", "l_discount"])


# --- joins ---------------------------------------------------------------------------------


@query("lookup_join", "SELECT c.*, n.n_name AS nation FROM customer c LEFT JOIN nation n ON c_nationkey = n_nationkey")
def _(t):
    return agg.lookup_join(t.customer, t.nation, "c_nationkey", "n_nationkey", "n_name", "nation")


@query("fill_from_stats", """
SELECT l_orderkey, l_linenumber, coalesce(l_discount, (SELECT avg(l_discount) FROM lineitem_gaps)) AS l_discount,
       coalesce(l_tax, (SELECT avg(l_tax) FROM lineitem_gaps)) AS l_tax FROM lineitem_gaps""",
       derived=["lineitem_gaps"], doubles=["l_discount", "l_tax"])
def _(t):
    return clean.impute(t.lineitem_gaps, "mean", ["l_discount", "l_tax"]).select(
        "l_orderkey", "l_linenumber", "l_discount", "l_tax")


# --- aggregates ----------------------------------------------------------------------------


_AGG = {"mean": "avg(l_extendedprice)", "sum": "sum(l_extendedprice)", "count": "count(l_extendedprice)",
        "median": "quantile_cont(l_extendedprice, 0.5)", "min": "min(l_extendedprice)",
        "max": "max(l_extendedprice)", "std": "stddev_samp(l_extendedprice)", "var": "var_samp(l_extendedprice)",
        "nunique": "count(DISTINCT l_extendedprice)", "first": "arg_min(l_extendedprice, l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber)",
        "last": "arg_max(l_extendedprice, l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber)"}


def _grouped(t, funcs):
    """One column per aggregate, all in one pass."""
    data = t.lineitem_gaps.withColumn("at", F.expr("l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber"))
    return agg.group_agg(data, "l_returnflag", "l_extendedprice", funcs, order_by="at")


def _grouped_sql(funcs):
    cols = ", ".join(f"{_AGG[f]} AS \"{f}\"" for f in funcs)
    return f"SELECT l_returnflag, {cols} FROM lineitem_gaps WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag"


_BASIC = ["mean", "sum", "count", "median", "min", "max", "std"]
_LEGACY = ["var", "nunique", "first", "last"]


@query("group_agg", _grouped_sql(_BASIC), derived=["lineitem_gaps"],
       doubles=[f'"{c}"' for c in _BASIC if c != "count"], digits=4)
def _(t):
    return _grouped(t, _BASIC)


@query("group_agg_legacy", _grouped_sql(_LEGACY), derived=["lineitem_gaps"],
       doubles=['"var"', '"first"', '"last"'], digits=2)
def _(t):
    return _grouped(t, _LEGACY)


@query("pivot_table", "SELECT l_linestatus, " + ", ".join(
    f"coalesce(sum(l_quantity) FILTER (l_returnflag = '{f}' AND l_linenumber = {n}), 0) AS \"l_quantity_{f}_{n}\""
    for f in "ANR" for n in range(2, 8)) + " FROM lineitem_gaps WHERE l_returnflag IS NOT NULL GROUP BY l_linestatus",
    derived=["lineitem_gaps"])
def _(t):
    return agg.pivot_table(t.lineitem_gaps, ["l_linestatus"], ["l_returnflag", "l_linenumber"], ["l_quantity"])


@query("pivot_table_no_columns", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity, "
       "sum(l_tax) AS l_tax FROM lineitem_gaps WHERE l_returnflag IS NOT NULL GROUP BY ALL",
       derived=["lineitem_gaps"], doubles=["l_quantity", "l_tax"], digits=4)
def _(t):
    return agg.pivot_table(t.lineitem_gaps, ["l_returnflag", "l_linestatus"], [], ["l_quantity", "l_tax"])


@query("value_counts", """
SELECT value, n AS "count", round(100.0 * n / (SELECT count(*) FROM documents), 2) + 0.0 AS pct,
       (SELECT count(DISTINCT source) FROM documents) AS cardinality
FROM (SELECT source AS value, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, value LIMIT 10)""")
def _(t):
    return agg.value_counts(t.documents, "source", 10)


@query("category_frequencies", """
WITH long AS (""" + union_all("SELECT '{c}' AS \"column\", {c} AS value FROM part_text",
                              ["p_name", "p_brand", "p_type", "p_size_txt"]) + """),
c AS (SELECT "column", coalesce(value, 'None') AS value, count(*) AS n,
      count(*) / (SELECT count(*) FROM part_text) AS share FROM long GROUP BY ALL),
ranked AS (
  SELECT "column", 'top' AS kind, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank,
         value, n, share FROM c
  UNION ALL
  SELECT "column", 'rare', row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value), value, n, share
  FROM c WHERE share < 0.01)
SELECT "column", kind, rank::INTEGER AS rank, value, n AS "count", round(share, 6) + 0.0 AS share FROM ranked WHERE rank <= 10""",
       derived=["part_text"])
def _(t):
    return agg.category_frequencies(t.part_text)


@query("distinct_counts", union_all(
    "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count, "
    "round(100.0 * count(DISTINCT {c}) / count(*), 6) + 0.0 AS unique_pct FROM lineitem_gaps", LINEITEM),
    derived=["lineitem_gaps"])
def _(t):
    return agg.distinct_counts(t.lineitem_gaps)


@query("distinct_counts_with_null", union_all(
    "SELECT '{c}' AS \"column\", count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS unique_count, "
    "round(100.0 * (count(DISTINCT {c}) + max(({c} IS NULL)::INT)) / count(*), 6) + 0.0 AS unique_pct "
    "FROM lineitem_gaps", LINEITEM), derived=["lineitem_gaps"])
def _(t):
    return agg.distinct_counts(t.lineitem_gaps, dropna=False)


_NULLS = union_all("SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count(*) AS rows FROM lineitem_gaps",
                   LINEITEM)


@query("null_counts", f"""
WITH n AS ({_NULLS}), al AS (SELECT * FROM n UNION ALL
SELECT '(all cells)', sum(nulls)::BIGINT, sum(rows)::BIGINT FROM n)
SELECT "column", nulls, rows, round(100.0 * nulls / rows, 6) + 0.0 AS null_pct FROM al""", derived=["lineitem_gaps"])
def _(t):
    return agg.null_counts(t.lineitem_gaps, total=True)


@query("duplicate_count", """
SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dups)) AS distinct_rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dups)) AS duplicates FROM orders_dups""",
       derived=["orders_dups"])
def _(t):
    return agg.duplicate_count(t.orders_dups)


_LI_NUM = LINEITEM[:8]


@query("describe_numeric", union_all(
    "SELECT '{c}' AS \"column\", count({c}) AS \"count\", avg({c}) AS mean, stddev_samp({c}) AS std, "
    "min({c})::DOUBLE AS min, quantile_cont({c}::DOUBLE, 0.25) AS q25, quantile_cont({c}::DOUBLE, 0.5) AS q50, "
    "quantile_cont({c}::DOUBLE, 0.75) AS q75, max({c})::DOUBLE AS max FROM lineitem_gaps", _LI_NUM),
    derived=["lineitem_gaps"], doubles=["mean", "std", "min", "q25", "q50", "q75", "max"])
def _(t):
    return agg.describe_numeric(t.lineitem_gaps)


@query("percentile_breakdown", union_all(
    "SELECT '{c}' AS \"column\", " + ", ".join(
        f"quantile_cont({{c}}::DOUBLE, {p / 100}) AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM lineitem_gaps",
    _LI_NUM), derived=["lineitem_gaps"], doubles=["p10", "p25", "p50", "p75", "p90"])
def _(t):
    return agg.percentile_breakdown(t.lineitem_gaps)


# --- ordered operators ---------------------------------------------------------------------


_GAPS = """
WITH s AS (SELECT o_orderdate AS d, lag(o_orderdate) OVER (ORDER BY o_orderdate) AS p FROM orders),
g AS (SELECT floor(epoch(d - p) / 86400)::BIGINT AS gap FROM s WHERE p IS NOT NULL)"""


@query("datetime_profile", _GAPS + """
SELECT 'o_orderdate' AS "column", min(o_orderdate) AS min, max(o_orderdate) AS max,
       floor(epoch(max(o_orderdate) - min(o_orderdate)) / 86400)::BIGINT AS range_days,
       count(*) - count(o_orderdate) AS null_count, round((SELECT avg(gap) FROM g), 6) + 0.0 AS avg_gap_days,
       (SELECT max(gap) FROM g) AS max_gap_days FROM orders""")
def _(t):
    return ordered.datetime_profile(t.orders)


@query("sampling_gap", _GAPS + """
SELECT 'o_orderdate' AS "column", quantile_cont(gap, 0.5)::DOUBLE AS median_gap_days,
       quantile_cont(gap, 0.5) > 7 AS irregular FROM g""")
def _(t):
    return ordered.sampling_gap(t.orders)


@query("ecdf", """
SELECT value, n AS "count", round(sum(n) OVER (ORDER BY value) / (SELECT count(*) FROM events), 6) + 0.0 AS share
FROM (SELECT value, count(*) AS n FROM events GROUP BY value)""", doubles=["value"])
def _(t):
    return ordered.ecdf(t.events, "value")


@query("rank_top_n", """
SELECT "column", rank::INTEGER AS rank, value, n AS "count" FROM (
  SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM (
    SELECT 'p_name' AS "column", p_name AS value, count(*) AS n FROM part GROUP BY p_name
    UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY p_brand))
WHERE rank <= 5""")
def _(t):
    return prof.top_labels(t.part, ["p_name", "p_brand"], 5)


@query("waterfall", """
SELECT x, delta, sum(delta) OVER (ORDER BY x) AS total
FROM (SELECT o_orderdate AS x, sum(o_totalprice) AS delta FROM orders GROUP BY 1)""",
       doubles=["delta", "total"], digits=2)
def _(t):
    return ordered.waterfall(t.orders, "o_orderdate", "o_totalprice")


# --- sorting and top rows ------------------------------------------------------------------


@query("sort_by", "SELECT * FROM lineitem_gaps ORDER BY l_discount DESC NULLS LAST", derived=["lineitem_gaps"])
def _(t):
    return agg.sort_by(t.lineitem_gaps, "l_discount", ascending=False)


@query("top_n", "SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10")
def _(t):
    return agg.top_n(t.lineitem, "l_extendedprice", 10, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("head_limit", "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100")
def _(t):
    return agg.head_limit(t.lineitem, 100, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("result_sort_filter", "SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS balance FROM customer "
       "GROUP BY c_mktsegment HAVING avg(c_acctbal) > 0 ORDER BY balance DESC", doubles=["balance"])
def _(t):
    result = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("balance"))
    return agg.result_sort_filter(result, "balance > 0", ["balance"], ascending=False)


# --- set operations ------------------------------------------------------------------------


@query("drop_duplicates", "SELECT DISTINCT * FROM orders_dups", derived=["orders_dups"])
def _(t):
    return agg.drop_duplicates(t.orders_dups)


@query("union_distinct_nodes", "SELECT o_orderstatus AS node FROM orders UNION SELECT o_orderpriority FROM orders")
def _(t):
    return agg.union_distinct_nodes(t.orders, "o_orderstatus", "o_orderpriority")




@query("fuzzy_duplicates", """
WITH d AS (SELECT DISTINCT 'p_name' AS "column", p_name AS v FROM part_text UNION SELECT DISTINCT 'p_type', p_type FROM part_text)
SELECT a."column", a.v AS a, b.v AS b, 1 - levenshtein(a.v, b.v) / greatest(length(a.v), length(b.v)) AS similarity
FROM d a JOIN d b ON a."column" = b."column" AND a.v < b.v
WHERE 1 - levenshtein(a.v, b.v) / greatest(length(a.v), length(b.v)) >= 0.85""", derived=["part_text"], doubles=["similarity"])
def _(t):
    return fuzzy.fuzzy_duplicates(t.part_text, ["p_name", "p_type"], 0.85)
