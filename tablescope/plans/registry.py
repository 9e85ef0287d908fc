"""Registry, inputs derived from the given tables, and helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables of one folder and the inputs derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in DERIVED:
            table, exprs, extra = DERIVED[name]
            df = getattr(self, table)
            out = df.selectExpr(*exprs)
            return out.unionByName(df.where(extra).selectExpr(*exprs)) if extra else out
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


# Inputs derived from the given tables by expressions both engines read alike:
# name -> (table, projection, rows that appear a second time).
LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _swap(cols: Sequence[str], **new: str) -> list[str]:
    return [f"{new[c]} AS {c}" if c in new else c for c in cols]


DERIVED: dict[str, tuple[str, list[str], str | None]] = {
    "lineitem_gaps": ("lineitem", _swap(
        LINEITEM,
        l_discount="CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END",
        l_tax="CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_tax END",
        l_returnflag="CASE WHEN l_linenumber = 1 THEN NULL ELSE l_returnflag END"), None),
    "orders_dups": ("orders", ORDERS, "o_orderpriority = '1-URGENT'"),
    "part_text": ("part", _swap(
        PART, p_name="CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) "
                     "WHEN p_partkey % 4 = 1 THEN concat('  ', p_name, ' ') ELSE p_name END")
        + ["CAST(p_size AS string) AS p_size_txt"], None),
    "lineitem_wide": ("lineitem", LINEITEM + [
        "l_extendedprice * 2 + 1 AS l_twice", "CAST(4.0 AS double) AS l_const"], None),
    "customer_outliers": ("customer", _swap(
        CUSTOMER, c_acctbal="CASE WHEN c_custkey % 100 = 0 THEN c_acctbal * 50 ELSE c_acctbal END"), None),
    "predictions": ("labels", [
        "doc_id", "quality AS label",
        "CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS prediction",
        "CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END * 0.5 + (doc_id % 37) / 100.0 AS score"], None),
    "regression_preds": ("lineitem", [
        "l_extendedprice AS label", "l_quantity * 1500 AS prediction"], None),
}


def with_derived(sql: str, *names: str) -> str:
    """Prefix a DuckDB query with the derived inputs it reads."""
    ctes = []
    for n in names:
        table, exprs, extra = DERIVED[n]
        body = f"SELECT {', '.join(exprs)} FROM {table}"
        if extra:
            body += f" UNION ALL {body} WHERE {extra}"
        ctes.append(f"{n} AS ({body.replace('AS string', 'AS varchar')})")
    head = "WITH " + ", ".join(ctes)
    return f"{head}, {sql[5:]}" if sql.lstrip().startswith("WITH ") else f"{head} {sql}"


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the doubles, so that the order in which a sum is formed does not show."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def tidy_sql(sql: str, doubles: Sequence[str], digits: int = 6) -> str:
    swaps = ", ".join(f"round({d}, {digits}) + 0.0 AS {d}" for d in doubles)
    return f"SELECT * REPLACE ({swaps}) FROM ({sql})"


def query(key: str, sql: str | None = None, derived: Sequence[str] = (), doubles: Sequence[str] = (),
          digits: int = 6):
    """Register ``fn(tables) -> DataFrame`` under a key, with its DuckDB twin."""
    def register(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = lambda spark, folder: tidy(fn(Tables(spark, folder)), digits)
        if sql is not None:
            text = tidy_sql(sql, doubles, digits) if doubles else sql
            ORACLES[key] = with_derived(text, *derived) if derived else text
        return fn
    return register


def union_all(template: str, cols: Sequence[str]) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in cols)
