"""Text, numeric and date transforms, binning, encodings and type repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescope.operators import clean
from tablescope.operators import transform as tr
from tablescope.plans.registry import query

_TRIM = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"

# --- text ----------------------------------------------------------------------------------


@query("text_strip", f"SELECT * REPLACE ({_TRIM.format(c='p_name')} AS p_name) FROM part_text", derived=["part_text"])
def _(t):
    return tr.text_strip(t.part_text, "p_name")


@query("text_lower", "SELECT * REPLACE (lower(text) AS text) FROM benchmark")
def _(t):
    return tr.text_lower(t.benchmark, "text")


@query("text_upper", "SELECT * REPLACE (upper(p_type) AS p_type) FROM part")
def _(t):
    return tr.text_upper(t.part, "p_type")


@query("text_normalize_all", "SELECT * REPLACE (lower(p_name) AS p_name, lower(p_brand) AS p_brand, "
       "lower(p_type) AS p_type, lower(p_size_txt) AS p_size_txt) FROM part_text", derived=["part_text"])
def _(t):
    return tr.text_normalize_all(t.part_text, "lower")


@query("regex_replace", "SELECT page_id, url, regexp_replace(html, '<[^>]*>', ' ', 'g') AS html FROM pages")
def _(t):
    return tr.regex_replace(t.pages, "html", "<[^>]*>", " ")


@query("regex_extract", """
SELECT page_id, url, CASE WHEN regexp_matches(url, '://[^/]+') THEN regexp_extract(url, '(://[^/]+)', 1) END AS host
FROM pages""")
def _(t):
    return tr.regex_extract(t.pages, "url", "://[^/]+", "host").drop("html")


@query("text_split", """
WITH s AS (SELECT *, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, p_name, w[1] AS p_name_part1,
       CASE WHEN len(w) > 1 THEN array_to_string(w[2:], ' ') END AS p_name_part2 FROM s""")
def _(t):
    return tr.text_split(t.part.select("p_partkey", "p_name"), "p_name", " ", 1)


@query("collapse_whitespace", "SELECT doc_id, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') "
       "AS text FROM documents")
def _(t):
    return tr.collapse_whitespace(t.documents, "text").select("doc_id", "text")


@query("normalize_labels", f"SELECT * REPLACE (lower({_TRIM.format(c='p_name')}) AS p_name) FROM part_text",
       derived=["part_text"])
def _(t):
    return tr.normalize_labels(t.part_text, "p_name")


# --- numbers and dates ---------------------------------------------------------------------


@query("transform_log", "SELECT c_custkey, ln(1 + abs(c_acctbal)) AS c_acctbal FROM customer", doubles=["c_acctbal"])
def _(t):
    return tr.transform_log(t.customer, "c_acctbal").select("c_custkey", "c_acctbal")


@query("transform_sqrt", "SELECT c_custkey, sqrt(abs(c_acctbal)) AS c_acctbal FROM customer", doubles=["c_acctbal"])
def _(t):
    return tr.transform_sqrt(t.customer, "c_acctbal").select("c_custkey", "c_acctbal")


@query("transform_square", "SELECT l_orderkey, l_linenumber, l_discount * l_discount AS l_discount FROM lineitem",
       doubles=["l_discount"])
def _(t):
    return tr.transform_square(t.lineitem, "l_discount").select("l_orderkey", "l_linenumber", "l_discount")


@query("transform_abs", "SELECT c_custkey, abs(c_acctbal) AS c_acctbal FROM customer", doubles=["c_acctbal"])
def _(t):
    return tr.transform_abs(t.customer, "c_acctbal").select("c_custkey", "c_acctbal")


@query("transform_normalize", """
SELECT l_orderkey, l_linenumber, (l_extendedprice - lo) / (hi - lo) AS l_extendedprice
FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)""",
       doubles=["l_extendedprice"])
def _(t):
    return tr.transform_normalize(t.lineitem, "l_extendedprice").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("transform_standardize", """
SELECT l_orderkey, l_linenumber, (l_quantity - m) / s AS l_quantity
FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem)""", doubles=["l_quantity"])
def _(t):
    return tr.transform_standardize(t.lineitem, "l_quantity").select("l_orderkey", "l_linenumber", "l_quantity")


@query("date_extract", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS o_orderdate FROM orders")
def _(t):
    return tr.date_extract(t.orders, "o_orderdate", "year").select("o_orderkey", "o_orderdate")


@query("feature_compute", """
SELECT l_orderkey, l_linenumber, l_tax, ln(1 + abs(l_extendedprice)) AS l_extendedprice,
       (l_quantity - mq) / sq AS l_quantity, (l_discount - ld) / (hd - ld) AS l_discount
FROM lineitem, (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, min(l_discount) AS ld,
                max(l_discount) AS hd FROM lineitem)""",
       doubles=["l_tax", "l_extendedprice", "l_quantity", "l_discount"])
def _(t):
    return tr.feature_compute(
        t.lineitem, {"l_tax": "identity", "l_extendedprice": "log1p", "l_quantity": "zscore", "l_discount": "minmax"},
        keep=["l_orderkey", "l_linenumber"])


# --- binning -------------------------------------------------------------------------------


_WIDTH = """
WITH s AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part),
b AS (SELECT p_partkey, CASE
  WHEN p_retailprice <= lo + (hi - lo) / 5 THEN 0 WHEN p_retailprice <= lo + 2 * ((hi - lo) / 5) THEN 1
  WHEN p_retailprice <= lo + 3 * ((hi - lo) / 5) THEN 2 WHEN p_retailprice <= lo + 4 * ((hi - lo) / 5) THEN 3
  ELSE 4 END AS code FROM part, s)"""


@query("bin_equal_width", _WIDTH + " SELECT p_partkey, code::INTEGER AS p_retailprice_binned FROM b")
def _(t):
    return tr.bin_equal_width(t.part, "p_retailprice", 5, codes=True).select("p_partkey", "p_retailprice_binned")


@query("bin_equal_width_labels", _WIDTH + """
SELECT p_partkey, (['very low', 'low', 'middle', 'high', 'very high'])[code + 1] AS band FROM b""")
def _(t):
    labels = ["very low", "low", "middle", "high", "very high"]
    return tr.bin_equal_width(t.part, "p_retailprice", 5, labels=labels, new="band").select("p_partkey", "band")


@query("bin_quantile", """
WITH q AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, (CASE WHEN l_extendedprice <= e[1] THEN 0 WHEN l_extendedprice <= e[2] THEN 1
       WHEN l_extendedprice <= e[3] THEN 2 ELSE 3 END)::INTEGER AS quartile FROM lineitem, q""")
def _(t):
    return tr.bin_quantile(t.lineitem, "l_extendedprice", 4, codes=True, new="quartile").select(
        "l_orderkey", "l_linenumber", "quartile")


@query("bin_custom", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 'small'
  WHEN l_quantity > 10 AND l_quantity <= 30 THEN 'medium' WHEN l_quantity > 30 AND l_quantity <= 45 THEN 'large' END AS size
FROM lineitem""")
def _(t):
    return tr.bin_custom(t.lineitem, "l_quantity", [0, 10, 45, 30], labels=["small", "medium", "large"],
                         new="size").select("l_orderkey", "l_linenumber", "size")


@query("bin_distribution", """
SELECT CASE WHEN l_quantity <= 10 THEN '(0.0, 10.0]' WHEN l_quantity <= 30 THEN '(10.0, 30.0]'
       WHEN l_quantity <= 50 THEN '(30.0, 50.0]' END AS bin, count(*) AS "count" FROM lineitem GROUP BY 1""")
def _(t):
    return tr.bin_distribution(tr.bin_custom(t.lineitem, "l_quantity", [0, 10, 30, 50], new="size"), "size")


# --- encodings -----------------------------------------------------------------------------


@query("encode_label", """
WITH d AS (SELECT p_name AS v, (row_number() OVER (ORDER BY p_name) - 1)::INTEGER AS code
           FROM (SELECT DISTINCT p_name FROM part))
SELECT p_partkey, p_name, code AS p_name_encoded FROM part JOIN d ON p_name = v""")
def _(t):
    return tr.encode_label(t.part, "p_name").select("p_partkey", "p_name", "p_name_encoded")


@query("encode_onehot", """
SELECT l_orderkey, l_linenumber, (coalesce(l_returnflag = 'A', false))::INTEGER AS "l_returnflag_A",
       (coalesce(l_returnflag = 'N', false))::INTEGER AS "l_returnflag_N",
       (coalesce(l_returnflag = 'R', false))::INTEGER AS "l_returnflag_R" FROM lineitem_gaps""",
       derived=["lineitem_gaps"])
def _(t):
    return tr.encode_onehot(t.lineitem_gaps, "l_returnflag").select(
        "l_orderkey", "l_linenumber", "l_returnflag_A", "l_returnflag_N", "l_returnflag_R")


_PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query("encode_ordinal", "SELECT o_orderkey, (list_position(" + str(_PRIORITIES) +
       ", o_orderpriority) - 1)::DOUBLE AS o_orderpriority_ordinal FROM orders")
def _(t):
    return tr.encode_ordinal(t.orders, "o_orderpriority", _PRIORITIES).select("o_orderkey", "o_orderpriority_ordinal")


@query("target_encode", """
WITH g AS (SELECT p_brand AS k, avg(p_retailprice) AS m, count(*) AS n FROM part GROUP BY 1),
a AS (SELECT avg(p_retailprice) AS am FROM part)
SELECT p_partkey, n / (n + 5.0) * m + (1 - n / (n + 5.0)) * am AS p_brand_target
FROM part JOIN g ON p_brand = k, a""", doubles=["p_brand_target"])
def _(t):
    return tr.target_encode(t.part, "p_brand", "p_retailprice", 5.0).select("p_partkey", "p_brand_target")


# --- type repair ---------------------------------------------------------------------------


@query("to_numeric", "SELECT p_partkey, CAST(p_size_txt AS DOUBLE) AS p_size_txt FROM part_text", derived=["part_text"])
def _(t):
    return clean.to_numeric(t.part_text, "p_size_txt").select("p_partkey", "p_size_txt")


@query("to_datetime", "SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS d FROM orders")
def _(t):
    # month-first text on odd keys, ISO text on even ones
    text = F.when(F.col("o_orderkey") % 2 == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    return clean.to_datetime(t.orders.select("o_orderkey", text.alias("d")), "d")


@query("convert_type", """
SELECT l_orderkey, l_linenumber, coalesce(trunc(l_tax * 100), 0)::BIGINT AS tax,
       CASE WHEN l_returnflag IN ('T', 'Y') THEN true END AS flag, CAST(l_linenumber = 1 AS BOOLEAN) AS first,
       CAST(l_linenumber AS VARCHAR) AS line FROM lineitem_gaps""", derived=["lineitem_gaps"])
def _(t):
    df = t.lineitem_gaps.select(
        "l_orderkey", "l_linenumber", (F.col("l_tax") * 100).alias("tax"), F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_linenumber") == 1, "Yes").otherwise("no").alias("first"), F.col("l_linenumber").alias("line"))
    for name, kind in (("tax", "int64"), ("flag", "bool"), ("first", "bool"), ("line", "text")):
        df = clean.convert_type(df, name, kind)
    return df


@query("suggest_type", """
SELECT 'p_name' AS "column", 'text' AS suggested_type UNION ALL SELECT 'p_brand', 'text'
UNION ALL SELECT 'p_type', 'text' UNION ALL
SELECT 'p_size_txt', CASE WHEN count(TRY_CAST(p_size_txt AS DOUBLE)) > 0.9 * count(*) THEN
  CASE WHEN count(*) FILTER (TRY_CAST(p_size_txt AS DOUBLE) = floor(TRY_CAST(p_size_txt AS DOUBLE))) > 0.9 * count(*)
       THEN 'int64' ELSE 'float64' END ELSE 'text' END FROM part_text""", derived=["part_text"])
def _(t):
    return clean.suggest_type(t.part_text)


@query("fix_types", "SELECT o_orderkey, o_orderstatus, date_trunc('day', o_orderdate)::TIMESTAMP AS day, o_totalprice "
       "FROM orders", doubles=["o_totalprice"])
def _(t):
    return clean.fix_types(t.orders.select(
        "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.col("o_totalprice").cast("string").alias("o_totalprice")))


@query("type_issues", """
SELECT 'day' AS "column", 'values look like dates' AS issue, 100.0::DOUBLE AS success_pct, 'to_datetime' AS suggested_action
FROM orders HAVING count(*) >= 10
UNION ALL SELECT 'price', 'values look numeric', 100.0, 'to_numeric' FROM orders HAVING count(*) >= 10""")
def _(t):
    return clean.type_issues(t.orders.select(
        "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.col("o_totalprice").cast("string").alias("price")))
