"""Run registered queries on Spark and their twins on DuckDB and compare the results."""

from __future__ import annotations

import glob
import os
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return sorted((str(k), _plain(x)) for k, x in v.items())
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([_plain(r[i]) for i in order]) for r in rows)


def compare(df, con, sql) -> str | None:
    """None when both results agree, else what differs."""
    cols, rows = normal(df.columns, df.collect())
    cur = con.execute(sql)
    dcols, drows = normal([d[0] for d in cur.description], cur.fetchall())
    if cols != dcols:
        return f"columns {cols} != {dcols}"
    if rows != drows:
        left, right = set(rows), set(drows)
        only_s = [r for r in rows if r not in right][:4]
        only_d = [r for r in drows if r not in left][:4]
        return f"{len(rows)} vs {len(drows)} rows\n   spark {only_s}\n   duck  {only_d}"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    from tablescope.plans import ORACLES, QUERIES
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in QUERIES if not sys.argv[1:] or any(a == n or (a.endswith("*") and n.startswith(a[:-1]))
                                                          for a in sys.argv[1:])]
    con, bad = duck(folder), []
    for n in names:
        start = time.time()
        try:
            df = QUERIES[n](spark, folder)
            if n in ORACLES:
                problem = compare(df, con, ORACLES[n])
                note = "ok" if problem is None else f"DIFF {problem}"
            else:
                rows = df.collect()
                problem, note = (None if rows else "no rows"), f"rows only: {len(rows)}"
        except Exception as e:  # a failing query must not hide the others
            problem = note = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        if problem:
            bad.append(n)
        print(f"{time.time() - start:6.2f}s {n}: {note}", flush=True)
    print(f"{len(names) - len(bad)}/{len(names)} good; bad: {bad}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
