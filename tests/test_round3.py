"""Scaling of single steps: tree tables, subtrees per chunk, box joins, ties in sorts, quantiles, pair cells."""

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablescope.functions import quantiles
from tablescope.functions.histograms import bin_matrix, binned, lists, merged, packed
from tablescope.operators import aggregate, boosting, chartdata, clean, neighbours, stats, trees


def test_tree_tables_agree_with_routes():
    rng = np.random.default_rng(3)
    for depth in (1, 2, 3):
        for _ in range(20):
            inner = (1 << depth) - 1
            tree = boosting.Tree(depth, rng.integers(0, 4, inner), rng.integers(0, 256, inner), rng.random(1 << depth))
            x = np.asfortranarray(rng.integers(0, 256, (500, 4)).astype(np.uint8))
            assert (tree.scores(x) == tree.value[tree.route(x, depth)]).all()


def test_cells_and_lists_keep_their_rows():
    x = np.arange(12, dtype=np.uint8).reshape(4, 3)
    assert (bin_matrix(packed(x).slice(1, 2), 3) == x[1:3]).all() and bin_matrix(packed(x[:0]), 3).shape == (0, 3)
    assert lists(x.astype(float)).to_pylist() == x.astype(float).tolist() and lists(np.zeros((0, 2))).type == pa.list_(pa.float64())


def test_squares_are_boosted_from_one_row_per_cell(spark):
    df = spark.range(600).select(array_to_vector(F.array((F.col("id") % 4).cast("double"))).alias("features"), F.col("id").cast("double").alias("label"))
    cells = binned(df, [np.arange(4.0)], mean_label=True).collect()
    assert len(cells) == 4 and sum(r["w"] for r in cells) == 600
    fitted = boosting.fit_boosted(df, boosting.REGRESSION, rounds=60)
    assert np.allclose(fitted.outputs(np.arange(4.0)[:, None])[:, 0], 298 + np.arange(4.0), atol=0.1)


def test_a_subtree_is_copied_for_the_chunks_of_its_leaf_only(spark, monkeypatch):
    top = trees.Top()
    top.split(0, 0, 0.5)
    rows = spark.range(1300).select(F.col("id").alias("row"), F.array((F.col("id") >= 1000).cast("double")).alias("x"))
    monkeypatch.setattr(trees, "LOCAL", 400)
    assert [c.tolist() for c in trees.leaf_chunks(rows, [top], 1)] == [[1, 3, 1]]
    routed = trees.routed(rows, [top], False, 0, 1, [np.array([1, 3, 1])])
    assert {(r["leaf"], r["chunk"]) for r in routed.select("leaf", "chunk").distinct().collect()} == {(1, 0), (1, 1), (1, 2), (2, 0)}


def test_wide_coordinates_are_halved_first():
    assert neighbours.bit_order([800.0, 100.0], 5) == [0, 0, 0, 0, 1, 0, 1, 1, 1, 1]
    assert neighbours.bit_order([1.0, 1.0], 2) == [0, 1, 0, 1] and neighbours.bit_order([0.0], 3) == [0, 0, 0]


def test_box_joins_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PAIRS", 64)
    held = spark.createDataFrame([(float(i), float(i), 1, 0) for i in range(4)], "y0 double, _payload double, _n long, _box long")
    asks = spark.createDataFrame([(i / 7.0, -1, 0) for i in range(50)], "x0 double, _j int, _box long")
    found = neighbours._inside(asks, held, 1, 2)
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    got = sorted((r["x0"], r["_payload"], r["_d2"]) for r in found.collect())
    assert got == sorted((i / 7.0, float(j), (i / 7.0 - j) ** 2) for i in range(50) for j in range(4))


def test_ties_of_a_sort_go_to_many_tasks(spark, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    df = spark.range(40_000).withColumn("v", F.col("id") % 1)  # all equal, unknown to the optimizer
    for made in (aggregate.sort_by(df, "v", ascending=False), aggregate.result_sort_filter(df, order=["v"])):
        parts = made.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert made.columns == ["id", "v"] and max(parts) < 20_000 and sum(parts) == 40_000


def test_histograms_of_many_nodes_take_rows_of_many_batches(spark, monkeypatch):
    parts = [pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64())], ["v"]) for n in (3, 0, 4, 5, 1)]
    assert [b.num_rows for b in merged(iter(parts), 6)] == [7, 6] and [b.num_rows for b in merged(iter(parts), 99)] == [13]
    rows = spark.range(4000, numPartitions=3).select(
        F.col("id").alias("row"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"), F.floor(F.col("id") / 500).cast("double").alias("label"))
    cuts, tops = [np.arange(499.0, 4000.0, 500.0), np.array([1.0])], []
    monkeypatch.setattr(trees, "LOCAL", 600)
    for chunk in (1, 1 << 18):
        monkeypatch.setattr(trees, "CHUNK", chunk)
        tops.append(trees.grow_tops(rows, 4000, 1, 0, False, 2, False, 99, 0, cuts, np.zeros(2))[0])
    assert tops[0] == tops[1] and sorted(c for c, f in zip(tops[0].cut, tops[0].feature) if f >= 0) == list(np.arange(499.0, 3500.0, 500.0))


def _skewed():
    rng = np.random.default_rng(5)
    u = rng.normal(size=6000)
    return {"u": u, "ties": rng.integers(0, 5, 6000) * 1.0, "one": np.ones(6000), "gaps": np.where(u > 1, np.nan, u * 1e9),
            "half": np.where(u > 0, 0.0, u), "none": np.full(6000, np.nan), "g": rng.integers(0, 3, 6000) * 1.0}


def _frame(spark, data):
    return spark.createDataFrame(list(zip(*[[float(x) for x in v] for v in data.values()])), ", ".join(f"{c} double" for c in data))


def test_quantiles_of_columns_need_no_table_of_all_values(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "EXACT_GROUP_ROWS", 1000)
    monkeypatch.setattr(quantiles, "to_long", None)
    data, probs = _skewed(), [0, 0.1, 0.25, 0.5, 0.999, 1]
    got = {r["column"]: r["q"] for r in quantiles.wide_percentiles(_frame(spark, data), list(data), probs).collect()}
    assert got.pop("none") is None and set(got) == set(data) - {"none"}
    for c, q in got.items():
        assert np.allclose(q, np.nanquantile(data[c], probs), rtol=1e-12, atol=0), c


def test_quantiles_of_infinite_values(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "EXACT_GROUP_ROWS", 1000)
    u = np.random.default_rng(6).normal(size=6000)
    df = _frame(spark, {"high": np.where(u > 1, np.inf, u), "u": u})
    got = {r["column"]: r["q"] for r in quantiles.wide_percentiles(df, ["high", "u"], [0.25, 0.5]).collect()}
    want = np.quantile(u, [0.25, 0.5])
    assert np.allclose(got["high"], want, rtol=1e-12) and np.allclose(got["u"], want, rtol=1e-12)


def test_quantiles_of_frequent_groups_start_from_brackets(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "EXACT_GROUP_ROWS", 1000)
    monkeypatch.setattr(quantiles, "GRID", None)  # the grid over all values
    data, probs = _skewed(), [0, 0.2, 0.5, 1]
    for c in ("u", "ties", "one", "half"):
        found = quantiles.grouped_quantiles(_frame(spark, data), ["g"], c, probs)
        for r in found.collect():
            assert np.allclose(r["q"], np.quantile(data[c][data["g"] == r["g"]], probs), rtol=1e-12, atol=0), c


def test_pairs_of_columns_are_counted_per_batch(spark, monkeypatch):
    monkeypatch.setattr(stats, "inline_rows", None)
    df = spark.createDataFrame([(float(i), float(i % 4), "ab"[i % 2]) for i in range(400)] + [(None, 1.0, "a")], "x double, y double, t string")
    got = {(r["a"], r["b"]): r["mutual_info"] for r in stats.mutual_info(df, bins=4).collect()}
    assert set(got) == {("x", "y"), ("x", "t"), ("y", "t")}
    # quartiles of 0, 1, 2, 3 are 0.75, 1.5, 2.25: four bins, of which the parity tells half
    assert abs(got["y", "t"] - np.log(2)) < 1e-12 and abs(got["x", "t"]) < 1e-12


def test_cleaning_seeks_distinct_rows_once(spark, monkeypatch):
    kept, real = [], clean.stored
    monkeypatch.setattr(clean, "stored", lambda df: kept.append(1) or real(df))
    df = spark.createDataFrame([(1, 2.0, " a"), (1, 2.0, " a"), (2, None, None), (3, 4.0, "b")], "k int, x double, t string")
    out = clean.auto_clean(df, remove_duplicates=True, missing="median", outliers="clip", text="strip")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2.0, "a"), (2, 3.0, "Unknown"), (3, 4.0, "b")] and kept == [1]


def test_boxes_of_a_dashboard_are_made_once(spark):
    df = spark.createDataFrame([(float(i),) for i in range(9)], "x double")
    out = chartdata.dashboard(df, [("box", "x", None)])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line for line in plan.splitlines()) == 1
    assert {r["series"]: r["y"] for r in out.collect()} == {"whisker_low": 0, "q1": 2, "median": 4, "q3": 6, "whisker_high": 8}
