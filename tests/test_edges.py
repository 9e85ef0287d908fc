"""Empty, constant, missing and odd inputs."""

import pytest
from pyspark.sql import functions as F

from tablescope.functions import parsing
from tablescope.functions.columns import nan_to_null
from tablescope.operators import aggregate, chartdata, clean, evaluate, ordered, profile, project, quality, runs, sqlapi, stats, transform
from tablescope.sources import io, store


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "a double, b string")


@pytest.fixture(scope="module")
def all_null(spark):
    return spark.createDataFrame([(None, None)] * 5, "a double, b string")


@pytest.fixture(scope="module")
def one_row(spark):
    return spark.createDataFrame([(2.5, "x", "2024-01-02 00:00:00")], "a double, b string, c string").withColumn(
        "c", F.col("c").cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 3.0, 9.0, None, 7.0, 5.0, 5.0, 11.0)], "x double")


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


REPORTS = [
    profile.column_profile, profile.dataset_profile, profile.dataset_info, profile.dtype_counts, profile.column_inventory,
    profile.dataset_metadata, profile.profile_report, aggregate.null_counts, aggregate.distinct_counts,
    aggregate.duplicate_count, aggregate.describe_numeric, aggregate.category_frequencies, clean.analyze_issues,
    clean.cleaning_suggestions, clean.outlier_bounds, clean.type_issues, clean.suggest_type, quality.health_score,
    quality.health_recommendations, quality.health_insights, quality.auto_insights, quality.quality_report,
    quality.quality_issues, quality.missingness_patterns, quality.missingness_correlation, quality.range_validation,
    quality.impute_advice, quality.null_patterns, stats.statistical_summary, stats.skew_adjusted,
    stats.correlation_matrix, stats.normality_test, stats.baseline_stats, chartdata.missing_bar,
    chartdata.histogram_data, ordered.datetime_profile, store.dataset_fingerprint, io.compact_plan,
]


@pytest.mark.parametrize("report", REPORTS, ids=lambda f: f.__name__)
@pytest.mark.parametrize("table", ["empty", "all_null", "one_row"])
def test_reports_survive_odd_tables(request, report, table):
    report(request.getfixturevalue(table)).collect()


def test_health_of_empty_table_is_zero(empty):
    r = quality.health_score(empty).first()
    assert r["final_score"] == 0 and r["completeness"] == 0.0 and r["badge"] == "Critical Issues"


def test_nan_counts_as_missing_and_zero_signs_are_equal(spark):
    df = spark.createDataFrame([(float("nan"), None)] * 2 + [(0.0, "a"), (-0.0, "a")], "a double, b string")
    assert rows(aggregate.duplicate_count(df), "duplicates") == [(2,)]
    assert dict(rows(aggregate.null_counts(df), "column", "nulls")) == {"a": 2, "b": 2}
    assert nan_to_null(df).where("a is null").count() == 2


NUMBERS = {"12": 12.0, " 12 ": 12.0, "1e3": 1000.0, "": None, "nan": None, "inf": float("inf"), "1_000": None, "1,000": None,
           "$5": None, "-3.5": -3.5, "abc": None, "0x1F": None, "1.": 1.0, ".5": 0.5, "12d": None, "5f": None}


def test_number_parsing(spark):
    df = spark.createDataFrame([(k,) for k in NUMBERS], "v string")
    got = {r["v"]: r["n"] for r in df.withColumn("n", parsing.parse_number(F.col("v"))).collect()}
    assert got == NUMBERS


DATES = {"2024-01-02": "2024-01-02 00:00:00", "01/02/2024": "2024-01-02 00:00:00", "2024-1-2": "2024-01-02 00:00:00",
         "2024-01-02 03:04:05": "2024-01-02 03:04:05", "13/02/2024": "2024-02-13 00:00:00",
         "Jan 5 2024": "2024-01-05 00:00:00", "20240102": "2024-01-02 00:00:00", "12-31-2024": "2024-12-31 00:00:00",
         "abc": None, "12": None, "2024-13-45": None, None: None}


def test_date_parsing(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "v string")
    got = {r["v"]: r["d"] for r in df.withColumn("d", parsing.parse_datetime(F.col("v")).cast("string")).collect()}
    assert got == DATES


def test_convert_type(spark):
    df = spark.createDataFrame([("12",), ("1.9",), ("x",), (None,), ("YES",), ("f",)], "v string")
    assert rows(clean.convert_type(df, "v", "int64")) == [(12,), (1,), (0,), (0,), (0,), (0,)]
    assert rows(clean.convert_type(df, "v", "bool")) == [(None,), (None,), (None,), (None,), (True,), (False,)]
    with pytest.raises(ValueError):
        clean.convert_type(df, "v", "complex")


def test_skewed_fixture_moments(skewed):
    s = stats.statistical_summary(skewed).first()
    assert s["q1"] == 2.0 and s["median"] == 5.0
    assert s["skewness"] == pytest.approx(0.533267, abs=1e-6)
    assert s["kurtosis"] == pytest.approx(-0.960842, abs=1e-6)
    assert s["std"] == pytest.approx(3.427827, abs=1e-6)
    assert stats.skew_adjusted(skewed).first()["skew"] == pytest.approx(0.646417, abs=1e-6)
    assert rows(clean.mode_values(skewed, ["x"], "double")) == [("x", 2.0)]


def test_bins(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (5.0,), (10.0,), (None,)], "x double")
    assert rows(transform.bin_equal_width(df, "x", 4, codes=True), "x_binned") == [(0,), (0,), (1,), (3,), (None,)]
    labels = [r[0] for r in rows(transform.bin_equal_width(df, "x", 4), "x_binned")]
    assert labels == ["(0.991, 3.25]", "(0.991, 3.25]", "(3.25, 5.5]", "(7.75, 10.0]", None]
    assert [r[0] for r in rows(transform.bin_quantile(df, "x", 2, codes=True), "x_binned")] == [0, 0, 1, 1, None]
    assert [r[0] for r in rows(transform.bin_custom(df, "x", [5, 1, 9]), "x_binned")] == [
        None, "(1.0, 5.0]", "(1.0, 5.0]", None, None]
    with pytest.raises(ValueError):
        transform.bin_custom(df, "x", [3])


def test_bins_of_constant_column(spark):
    df = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert {r[0] for r in rows(transform.bin_equal_width(df, "x", 2, codes=True), "x_binned")} == {0}
    assert transform.interval_labels([0.01134, 0.337, 0.66]) == ["(0.0113, 0.337]", "(0.337, 0.66]"]


def test_target_encoding(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0), ("b", 1.0), ("b", 0.0), (None, None)], "c string, y double")
    got = {(r["c"], round(r["c_target"], 6)) for r in transform.target_encode(df, "c", "y").collect()}
    assert got == {("a", 0.533333), ("b", 0.65), (None, 0.6)}


def test_encodings(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    assert sorted(rows(transform.encode_label(df, "c")), key=str) == sorted(
        [("b", 1), ("a", 0), (None, None), ("b", 1)], key=str)
    assert rows(transform.encode_onehot(df, "c"), "c_a", "c_b") == [(0, 1), (1, 0), (0, 0), (0, 1)]
    known = df.dropna()
    assert rows(transform.encode_ordinal(known, "c", ["b", "a"]), "c_ordinal") == [(0.0,), (1.0,), (0.0,)]
    with pytest.raises(Exception, match="unknown category"):
        transform.encode_ordinal(known, "c", ["b"]).collect()
    with pytest.raises(ValueError):
        transform.encode_ordinal(known, "c", [])
    assert rows(transform.encode_onehot(df, "c", ["a"]), "c_a") == [(0,), (1,), (0,), (0,)]
    assert sorted(r["value"] for r in transform.onehot_long(df, "c", ["c"]).collect()) == ["a", "b", "b"]


def test_pivot_drops_null_keys(spark):
    df = spark.createDataFrame([("a", "u", 1.0), ("a", "v", 2.0), (None, "u", 3.0), ("b", None, 4.0)], "i string, c string, v double")
    assert [r.asDict() for r in aggregate.pivot_table(df, ["i"], ["c"], ["v"]).collect()] == [{"i": "a", "v_u": 1.0, "v_v": 2.0}]


def test_column_operations(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert project.rename_column(df, "a", " n ").columns == ["n", "b"]
    for bad in ("", "b"):
        with pytest.raises(ValueError):
            project.rename_column(df, "a", bad)
    with pytest.raises(ValueError, match="zz"):
        project.select_features(df, "a", ["b", "zz"])
    assert project.select_features(df, "a").columns == ["b"]
    assert project.filter_in(df, "gone", [1]).count() == 1


def test_date_filter_covers_whole_last_day(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-02 23:59:59.7",), ("2024-01-03 00:00:00",)], "d string")
    df = df.withColumn("d", F.col("d").cast("timestamp_ntz"))
    assert project.filter_date_range(df, "2024-01-01", "2024-01-02").count() == 2


def test_text_operations_keep_nulls(spark):
    df = spark.createDataFrame([(" \tA b\n",), (None,), ("x,y,z,w",)], "t string")
    assert rows(transform.text_strip(df, "t")) == [("A b",), (None,), ("x,y,z,w",)]
    assert rows(transform.text_split(df, "t", ",", 2), "t_part1", "t_part2", "t_part3")[1:] == [
        (None, None, None), ("x", "y", "z,w")]
    assert rows(transform.regex_extract(df, "t", "q*"), "t_extracted") == [("",), (None,), ("",)]
    with pytest.raises(Exception):
        transform.regex_replace(df, "t", "(", "")


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(float(i), 4.0, float(-i)) for i in range(9)], "a double, k double, b double")
    got = {(r["a"], r["b"]): r["corr"] for r in stats.correlation_matrix(df).collect()}
    assert got["a", "b"] == pytest.approx(-1) and got["a", "a"] == pytest.approx(1)
    assert got["k", "k"] is None and got["a", "k"] is None


def test_gaps_of_dates(spark):
    days = ["2024-01-01 10:00:00", "2024-01-01 12:00:00", "2024-01-02 09:00:00", "2024-01-12 12:00:00", None]
    df = spark.createDataFrame([(d,) for d in days], "d string").withColumn("d", F.col("d").cast("timestamp_ntz"))
    r = ordered.datetime_profile(df).first()
    assert (r["range_days"], r["null_count"], r["avg_gap_days"], r["max_gap_days"]) == (11, 1, 10 / 3, 10)
    assert rows(ordered.sampling_gap(df)) == [("d", 0.0, False)]


def test_ecdf_and_auc(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (None,)], "x double")
    assert sorted(rows(ordered.ecdf(df, "x"))) == [(1.0, 1, 1 / 3), (3.0, 2, 1.0)]
    p = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.5), (0, 0.5)], "label int, score double")
    assert evaluate.roc_auc(p).first()[0] == pytest.approx(0.875)


def test_only_reading_sql_is_run(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        sqlapi.sql_query(spark, "DROP TABLE df", {"df": df})
    assert sqlapi.sql_query(spark, "select a + 1 as b from df", {"df": df}).first()[0] == 2
    assert not spark.catalog.tableExists("df")


def test_sql_still_runs_every_join_kind(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(7,)], "y int")
    assert sqlapi.sql_query(spark, "SELECT * FROM a CROSS JOIN b", {"a": a, "b": b}).count() == 2


def test_timed_query(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    r = sqlapi.timed_query(spark, "SELECT a FROM df", {"df": df}, store.scratch_dir(spark)).first()
    assert r["row_count"] == 2 and r["columns"] == ["a"] and r["elapsed_seconds"] > 0


def test_fingerprint_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    mark = lambda df: store.dataset_fingerprint(df).first()["fingerprint"]
    assert mark(a) == mark(a.repartition(5)) == mark(a.select("b", "a"))
    assert mark(a) != mark(a.withColumn("a", F.col("a") + F.when(F.col("a") == 3, 1).otherwise(0)))


def test_undo_restores_the_last_snapshot(spark):
    root = store.scratch_dir(spark)
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    store.save_version(df, root, "t", "first")
    store.save_version(df.dropna(), root, "t", "second")
    assert store.undo(spark, root, "t").count() == 1
    assert [r["note"] for r in store.version_history(spark, root, "t").collect()] == ["first", "second"]
    with pytest.raises(ValueError):
        store.undo(spark, root, "other")


def test_recipe_rejects_unknown_steps(spark):
    with pytest.raises(ValueError):
        clean.apply_recipe(spark.createDataFrame([(1,)], "a int"), [("explode", {})])


def test_auto_clean(spark):
    df = spark.createDataFrame(
        [(1.0, " A ", "3"), (1.0, " A ", "3"), (None, None, "4"), (2.0, "b", "5"), (900.0, "b", "6")], "x double, t string, n string")
    out = clean.auto_clean(df, remove_duplicates=True, missing="median", repair_types=True, outliers="clip", text="strip")
    assert out.count() == 4 and dict(out.dtypes)["n"] == "double"
    assert {r["t"] for r in out.collect()} == {"A", "Unknown", "b"}
    assert out.agg(F.max("x")).first()[0] < 900
    for way in ("knn", "mice"):
        filled = clean.auto_clean(df, missing=way)
        assert filled.where("x is null").count() == 0


def test_clip_stays_inside_and_keeps_nulls(spark):
    df = spark.createDataFrame([(float(x),) for x in (*range(20), 500, -500)] + [(None,)], "x double")
    b = clean.outlier_bounds(df).first()
    out = clean.outlier_clip(df, ["x"])
    assert out.agg(F.min("x"), F.max("x")).first() == (b["lower"], b["upper"])
    assert out.where("x is null").count() == 1 and clean.outlier_remove(df, ["x"]).count() == 20


def test_runs(spark):
    import datetime
    at = datetime.datetime(2024, 1, 1)
    data = [("a1", "base", {"model": "rf"}, {"accuracy": 0.5, "rmse": 2.0, "zero": 0.0}, "done", ["x"], at),
            ("b2", "next", {}, {"accuracy": 0.75, "rmse": 1.0, "zero": -1.0}, "done", ["y"], at),
            ("c3", "last", {}, {"f1": 0.1}, "done", ["y"], at)]
    df = spark.createDataFrame(data, "id string, name string, params map<string,string>, metrics map<string,double>, "
                               "status string, tags array<string>, ts timestamp")
    got = {r["metric"]: (r["change_percent"], r["direction"]) for r in runs.experiment_compare(df, ["a1", "b2"]).collect()}
    assert got == {"accuracy": (50.0, "improvement"), "rmse": (-50.0, "improvement"), "zero": (float("-inf"), "regression")}
    with pytest.raises(ValueError, match="at least two"):
        runs.experiment_compare(df, ["a1"])
    with pytest.raises(ValueError, match="zz"):
        runs.experiment_compare(df, ["a1", "zz"])
    with pytest.raises(ValueError, match="common"):
        runs.experiment_compare(df, ["a1", "c3"])
    assert runs.ab_compare(df, "a1", "b2").first()["winner"] == "B"
    assert rows(runs.list_experiments(df, "y"), "id") == [("b2",), ("c3",)]


def test_dashboard_has_twenty_charts(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), float(i), f"k{i % 3}", f"g{i % 4}") for i in range(60)],
                               "id int, a double, b double, c double, s string, t string")
    assert len(chartdata.dashboard_specs(df)) == 20
    out = chartdata.dashboard(df, key=["id"], n_points=10)
    charts = {r["chart"] for r in out.select("chart").distinct().collect()}
    assert charts == set(range(20)) - {i for i, s in enumerate(chartdata.dashboard_specs(df)) if s[0] == "missing"}


def test_recommend_chart(spark, empty):
    assert chartdata.recommend_chart(empty) == ("histogram", ("a",))
    with pytest.raises(ValueError):
        chartdata.recommend_chart(spark.createDataFrame([], "d date"))


# --- inputs that once gave wrong results ---------------------------------------------------


def test_pivot_labels_that_join_alike_stay_apart(spark):
    df = spark.createDataFrame([("i", "a_b", "c", 1.0), ("i", "a", "b_c", 10.0)], "i string, x string, y string, v double")
    row = aggregate.pivot_table(df, ["i"], ["x", "y"], ["v"]).first().asDict()
    assert sorted(v for k, v in row.items() if k != "i") == [1.0, 10.0] and len(row) == 3
    assert aggregate.pivot_long(df, ["i"], ["x", "y"], ["v"]).count() == 2
    named = aggregate.pivot_table(df, ["i"], ["x"], ["v"], labels=[["a"], ["none"]])
    assert named.first().asDict() == {"i": "i", "v_a": 10.0, "v_none": 0.0}


def test_filters_apply_to_any_number_of_labels_and_columns(spark):
    labels = spark.createDataFrame([(f"l{i}",) for i in range(40)], "c string")
    assert project.filter_categories(labels, {"c": ["l3", "l39"]}).count() == 2
    wide = spark.createDataFrame([tuple(range(i, i + 14)) for i in range(5)], ", ".join(f"n{i} int" for i in range(14)))
    assert project.filter_numeric_ranges(wide, {"n13": (14, 15)}).count() == 2


def test_asof_join_never_matches_null(spark):
    left = spark.createDataFrame([(None, 5, "a"), ("k", None, "b"), ("k", 5, "c")], "k string, s int, tag string").withColumn(
        "t", F.timestamp_seconds("s").cast("timestamp_ntz"))
    right = spark.createDataFrame([(None, 1, 7), ("k", 2, 8), ("k", None, 9)], "k string, s int, v int").withColumn(
        "t", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = {r["tag"]: r["asof_v"] for r in ordered.asof_join(left, right.drop("s"), ["k"], "t", "t", ["v"]).collect()}
    assert got == {"a": None, "b": None, "c": 8}


def test_undo_takes_effect_and_goes_further_back(spark):
    root = store.scratch_dir(spark)
    states = [spark.range(n).toDF("n") for n in (3, 5, 7)]
    for s in states[:2]:
        store.write_dataset(s, root, "d")
        store.save_version(s, root, "d", "before a change")
    store.write_dataset(states[2], root, "d")
    assert store.current_dataset(spark, root, "d").count() == 7
    assert store.undo(spark, root, "d").count() == 5 == store.current_dataset(spark, root, "d").count()
    assert store.undo(spark, root, "d").count() == 3
    with pytest.raises(ValueError, match="left"):
        store.undo(spark, root, "d")


def test_sql_guard_reads_the_plan(spark):
    df = spark.range(3).toDF("n")
    assert sqlapi.sql_query(spark, "-- a remark\n(SELECT count(*) AS c FROM df)", {"df": df}).first()["c"] == 3
    assert sqlapi.sql_query(spark, "WITH a AS (SELECT n FROM df) SELECT n FROM a UNION SELECT 9", {"df": df}).count() == 4
    for text in ("DROP TABLE df", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a", "FROM df INSERT INTO x SELECT n",
                 "CREATE TABLE x AS SELECT 1", "SET a = 1", "CACHE TABLE df"):
        with pytest.raises(ValueError, match="read"):
            sqlapi.sql_query(spark, text, {"df": df})


def test_several_aggregates_share_a_pass(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 8.0), ("b", 2.0)], "k string, v double")
    got = [tuple(r) for r in aggregate.group_agg(df, "k", "v", ["min", "median", "sum"]).collect()]
    assert got == [("a", 1.0, 3.0, 12.0), ("b", 2.0, 2.0, 2.0)]
