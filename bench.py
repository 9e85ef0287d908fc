"""Time the headline queries: warm median of three full runs each, one JSON line at the end.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_KEYS (comma list or
``all``), BENCH_RUNS (default 3), BENCH_DUCK=1 to print DuckDB's time beside each query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from tablescope.plans import ORACLES, QUERIES  # noqa: E402

HEADLINE = (
    "column_profile", "describe_numeric", "statistical_summary", "null_counts", "distinct_counts", "duplicate_count",
    "dataset_diff", "quality_report", "health_score", "auto_insights", "missingness_patterns", "cleaning_suggestions",
    "correlation_matrix", "chi_square", "anova_groups", "mutual_info", "group_agg", "pivot_table", "value_counts",
    "drop_duplicates", "impute_median", "outlier_bounds", "outlier_clip", "auto_clean", "bin_quantile", "encode_label",
    "target_encode", "ecdf", "waterfall", "datetime_profile", "histogram_data", "box_data", "density2d_data",
    "sql_inner_join", "sql_asof_join", "sql_range_join", "sql_count_distinct", "sql_running_sum", "sql_cube",
    "roc_auc", "regression_metrics", "train_linear", "fuzzy_duplicates",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    picked = os.environ.get("BENCH_KEYS", "")
    keys = list(QUERIES) if picked == "all" else picked.split(",") if picked else list(HEADLINE)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = None
    if os.environ.get("BENCH_DUCK"):
        from tests.oracle import duck
        con = duck(folder)
    times: dict[str, float] = {}
    for key in keys:
        took = []
        for _ in range(runs + 1):  # the first run warms up
            start = time.perf_counter()
            QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[key] = round(statistics.median(took[1:] or took), 4)
        note = ""
        if con is not None and key in ORACLES:
            start = time.perf_counter()
            con.execute(ORACLES[key]).fetch_arrow_table() if hasattr(con, "fetch_arrow_table") else con.execute(ORACLES[key]).fetchall()
            note = f"  duckdb {time.perf_counter() - start:.3f}"
        print(f"{key}: {times[key]}{note}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, warm median, total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": Path(folder).name}))
    spark.stop()


if __name__ == "__main__":
    main()
