"""The ways taken beyond the size limits must give what the small ways give."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.functions import gram, indexing, quantiles, running
from tablescope.operators import clusters, fuzzy, neighbours, ordered, outliers
from tablescope.sources import io

from .conftest import SF_DIR


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SF_DIR}/lineitem.parquet")


def _q(df, keys):
    return {tuple(r[k] for k in keys): [None if x is None else round(x, 8) for x in r["q"]] for r in df.collect()}


@pytest.mark.parametrize("value", ["l_extendedprice", "l_quantity"])
def test_narrowed_quantiles_equal_percentile(lineitem, value):
    keys, probs = ["l_returnflag"], [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    small = quantiles.grouped_quantiles(lineitem, keys, value, probs)
    big = quantiles.grouped_quantiles(lineitem, keys, value, probs, limit=20)
    assert _q(small, keys) == _q(big, keys)


def test_narrowed_quantiles_with_hot_value_and_small_groups(spark):
    rows = [("hot", 5.0)] * 700 + [("hot", float(i)) for i in range(300)] + [("cold", float(i)) for i in range(7)]
    rows += [(None, float(i)) for i in range(400)] + [("cold", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    a = quantiles.grouped_quantiles(df, ["k"], "v", [0.1, 0.5, 0.75, 0.99])
    b = quantiles.grouped_quantiles(df, ["k"], "v", [0.1, 0.5, 0.75, 0.99], limit=10)
    assert _q(a, ["k"]) == _q(b, ["k"])


def test_weighted_quantiles(lineitem):
    counts = lineitem.groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("c"))
    plain = quantiles.grouped_quantiles(lineitem, ["l_returnflag"], "l_quantity", [0.3, 0.95])
    for limit in (None, 5):
        weighted = quantiles.grouped_quantiles(counts, ["l_returnflag"], "l_quantity", [0.3, 0.95], limit, "c")
        assert _q(plain, ["l_returnflag"]) == _q(weighted, ["l_returnflag"])


def test_wide_percentiles_beyond_limit(lineitem, monkeypatch):
    cols = ["l_quantity", "l_extendedprice", "l_tax"]
    small = _q(quantiles.wide_percentiles(lineitem, cols, [0.25, 0.75]), ["column"])
    monkeypatch.setattr(quantiles, "EXACT_GROUP_ROWS", 100)
    assert _q(quantiles.wide_percentiles(lineitem, cols, [0.25, 0.75]), ["column"]) == small


def test_running_sums_over_buckets(lineitem):
    counts = lineitem.groupBy("l_extendedprice").agg(F.count("*").alias("n"))
    one = running.running_sums(counts, "l_extendedprice", ["n"], ["upto"])
    many = running.running_sums(counts, "l_extendedprice", ["n"], ["upto"], rows_per_bucket=300)
    assert many.select(F.max("upto")).first()[0] == lineitem.count()
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_running_sums_over_dates(spark):
    days = spark.read.parquet(f"{SF_DIR}/orders.parquet").groupBy("o_orderdate").agg(F.count("*").alias("n"))
    one = running.running_sums(days, "o_orderdate", ["n"], ["upto"])
    many = running.running_sums(days, "o_orderdate", ["n"], ["upto"], rows_per_bucket=100)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_sorted_index_over_ranges(spark):
    names = spark.read.parquet(f"{SF_DIR}/customer.parquet").select("c_name").distinct()
    one = indexing.sorted_index(names, "c_name", "i")
    many = indexing.sorted_index(names, "c_name", "i", limit=40)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_pair_correlations_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 1, (400, 4))
    x[:, 1] += x[:, 0]
    x[rng.random((400, 4)) < 0.2] = np.nan
    x[:, 3] = 7.1
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], "a double, b double, c double, d double")
    got = {(r["i"], r["j"]): r["corr"] for r in gram.pair_correlations(df, df.columns).collect()}
    for i, j in itertools.product(range(3), repeat=2):
        ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert got[i, j] == pytest.approx(np.corrcoef(x[ok, i], x[ok, j])[0, 1], abs=1e-9)
    assert all(got[3, j] is None and got[j, 3] is None for j in range(4))


# --- neighbours ----------------------------------------------------------------------------


def _brute(queries, donors, k):
    out = {}
    for q in set(queries):
        ranked = sorted((sum((a - b) ** 2 for a, b in zip(q, d[:-1])), d[-1]) for d in donors)
        out[q] = [(f"{x:.9g}", p) for x, p in ranked[:k]]
    return out


@pytest.mark.parametrize("limits", [{}, {"broadcast_limit": 0, "sample": 12}])
@pytest.mark.parametrize("shape", ["spread", "clumped"])
def test_nearest_equals_brute_force(spark, limits, shape, monkeypatch):
    monkeypatch.setattr(neighbours, "GROWTH", 4)
    rnd = random.Random(3)
    at = (lambda: (rnd.gauss(0, 100), rnd.gauss(0, 1), rnd.random())) if shape == "spread" else (
        lambda: (float(rnd.randrange(3)), float(rnd.randrange(3)), 0.0))
    donors = [(*at(), float(rnd.randrange(50))) for _ in range(600)]
    queries = [at() for _ in range(60)] + [(1e5, 0.0, 0.0)]
    q = spark.createDataFrame(queries, "x0 double, x1 double, x2 double")
    d = spark.createDataFrame(donors, "x0 double, x1 double, x2 double, _payload double")
    hits = neighbours.nearest(q, d, ["x0", "x1", "x2"], 5, **limits).collect()
    got = {}
    for r in sorted(hits, key=lambda r: (r["_d2"], r["_payload"])):
        got.setdefault((r["x0"], r["x1"], r["x2"]), []).extend([(f"{r['_d2']:.9g}", r["_payload"])] * r["_take"])
    assert got == _brute(queries, donors, 5)


def test_impute_knn_with_several_patterns(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(120):
        r = [rnd.gauss(0, 1) for _ in range(3)]
        for i in range(3):
            if rnd.random() < 0.2:
                r[i] = None
        rows.append(tuple(r))
    df = spark.createDataFrame(rows, "a double, b double, c double")

    def expect(row, j):
        near = []
        for d in rows:
            if d[j] is None:
                continue
            both = [(x - y) ** 2 for x, y in zip(row, d) if x is not None and y is not None]
            if both:
                near.append((sum(both) * 3 / len(both), d[j]))
        near.sort()
        present = [d[j] for d in rows if d[j] is not None]
        return sum(p for _, p in near[:5]) / len(near[:5]) if near else sum(present) / len(present)

    want = sorted(tuple(round(v if v is not None else expect(r, j), 9) for j, v in enumerate(r)) for r in rows)
    for limits in ({}, {"broadcast_limit": 0, "sample": 10}):
        got = neighbours.impute_knn(df, **limits).collect()
        assert sorted(tuple(round(v, 9) for v in r) for r in got) == want


def _nan_euclidean(rows, k):
    """Brute force: fills by the k nearest rows that have the value, ties by value; the column's mean without any."""
    x = np.array(rows, float)
    gap = x[:, None, :] - x[None, :, :]
    both = (~np.isnan(gap)).sum(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        d2 = np.where(both > 0, np.nansum(gap * gap, 2) * (x.shape[1] / both), np.inf)
    out = x.copy()
    for r, j in zip(*np.nonzero(np.isnan(x))):
        able = np.flatnonzero(np.isfinite(d2[r]) & ~np.isnan(x[:, j]))
        near = able[np.lexsort((x[able, j], d2[r, able]))][:k]
        out[r, j] = x[near, j].mean() if len(near) else np.nanmean(x[:, j])
    return out


@pytest.mark.parametrize("limits", [{}, {"broadcast_limit": 0, "sample": 8}])
@pytest.mark.parametrize("shape", ["normal", "ties"])
def test_impute_knn_in_five_columns_against_brute_force(spark, limits, shape, monkeypatch):
    """300 rows, four columns with gaps, patterns in many mixtures, a row of gaps only, repeated rows."""
    monkeypatch.setattr(neighbours, "GROWTH", 4)
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (300, 5)) if shape == "normal" else rng.integers(0, 3, (300, 5)).astype(float)
    x[:, :4][rng.random((300, 4)) < 0.25] = np.nan
    x[7] = np.nan
    x[8:12] = x[8]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = np.array(sorted(tuple(r) for r in neighbours.impute_knn(df, **limits).collect()))
    want = np.array(sorted(map(tuple, _nan_euclidean(x, 5))))
    assert np.allclose(got, want, atol=1e-9)


def test_impute_knn_without_rows_or_gaps(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert neighbours.impute_knn(empty).collect() == []
    full = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    assert sorted(map(tuple, neighbours.impute_knn(full, broadcast_limit=0).collect())) == [(1.0, 2.0), (3.0, 4.0)]
    alone = spark.createDataFrame([(1.0, None), (None, 4.0)], "a double, b double")
    assert sorted(map(tuple, neighbours.impute_knn(alone, broadcast_limit=0).collect())) == [(1.0, 4.0), (1.0, 4.0)]


def test_predict_knn_votes(spark):
    train = spark.createDataFrame([(float(i), float(i // 50)) for i in range(100)], "x double, y double")
    test = spark.createDataFrame([(10.2,), (80.1,)], "x double")
    got = {r["x"]: r["prediction"] for r in neighbours.predict_knn(train, test, ["x"], "y", "classification").collect()}
    assert got == {10.2: 0.0, 80.1: 1.0}


# --- outlier factor ------------------------------------------------------------------------


def _lof(values, k):
    x = np.array(values)
    d = np.abs(x[:, None] - x[None, :])
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    kd = np.take_along_axis(d, near, 1)[:, -1]
    reach = np.maximum(kd[near], np.take_along_axis(d, near, 1))
    lrd = 1 / (reach.mean(1) + 1e-10)
    return lrd[near].mean(1) / lrd


@pytest.mark.parametrize("rows_per_bucket", [None, 90])
def test_lof_equals_brute_force(spark, rows_per_bucket):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(0, 1, 250), rng.normal(50, 9, 140), [400.0]])
    counts = spark.createDataFrame([(float(v), 1) for v in values], "v double, c long")
    got = {r["v"]: r["lof"] for r in outliers.lof_scores(counts, 7, rows_per_bucket).collect()}
    for v, want in zip(values, _lof(values, 7)):
        assert got[float(v)] == pytest.approx(want, rel=1e-6)


def test_lof_counts_copies(spark):
    values = [1.0] * 9 + [2.0] * 3 + [3.0, 3.5, 10.0]
    counts = spark.createDataFrame([(1.0, 9), (2.0, 3), (3.0, 1), (3.5, 1), (10.0, 1)], "v double, c long")
    got = {r["v"]: r["lof"] for r in outliers.lof_scores(counts, 2).collect()}
    want = dict(zip(values, _lof(values, 2)))
    for v in (2.0, 3.0, 3.5, 10.0):
        assert got[v] == pytest.approx(want[v], rel=1e-6)


def test_isolation_forest_flags_the_far_values(spark):
    rows = [(i, float(i % 50)) for i in range(950)] + [(1000 + i, 5000.0 + 37 * i) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v double")
    got = outliers.outlier_isolation_forest(df, "v", ["id"]).where("is_outlier").select("id").collect()
    hit = {r["id"] for r in got}
    assert hit and len(hit) <= 0.05 * len(rows) + 1 and sum(i >= 1000 for i in hit) >= 0.8 * len(hit)


# --- density clusters ----------------------------------------------------------------------


def _dbscan(points, eps, min_pts):
    x = np.array(points)
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps * (1 + 1e-12)
    core = near.sum(1) >= min_pts
    label = -np.ones(len(x), int)
    group = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] >= 0:
                    continue
                label[j] = group
                todo += [n for n in np.flatnonzero(near[j] & core) if label[n] < 0]
            group += 1
    border = {i: {label[n] for n in np.flatnonzero(near[i] & core)} for i in range(len(x)) if not core[i]}
    return label, core, border


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_dbscan_equals_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    blobs = [rng.normal(c, 0.25, (90, dims)) for c in (0.0, 3.0)] + [rng.uniform(-6, 9, (60, dims))]
    chain = np.array([[6 + 0.09 * i] + [0.0] * (dims - 1) for i in range(60)])
    points = np.concatenate([*blobs, chain]).round(6)
    points = np.unique(points, axis=0)
    eps, min_pts = 0.4, 4
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)],
                               "id int, " + ", ".join(f"f{i} double" for i in range(dims)))
    got = {r["id"]: r["cluster"] for r in clusters.cluster_dbscan(
        df, [f"f{i}" for i in range(dims)], eps, min_pts, scale=False).collect()}
    label, core, border = _dbscan(points, eps, min_pts)
    name = {}
    for i in range(len(points)):
        if core[i]:
            assert name.setdefault(label[i], got[i]) == got[i]
    assert len(set(name.values())) == len(name)
    for i, touching in border.items():
        assert got[i] == -1 if not touching else got[i] in {name[t] for t in touching}


def test_connected_components(spark):
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)]
    edges += [(200 + rnd.randrange(80), 200 + rnd.randrange(80)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in clusters.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}


# --- labels, joins, samples ----------------------------------------------------------------


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_fuzzy_pairs_equal_brute_force(spark):
    rnd = random.Random(4)
    base = ["northern lights", "blue mountain ridge", "customer services department", "ab", "the quick brown fox jumps over it"]
    labels = set(base)
    for b in base:
        for _ in range(12):
            s = list(b)
            for _ in range(rnd.randrange(1, 5)):
                at = rnd.randrange(len(s)) if s else 0
                rnd.choice([lambda: s.insert(at, rnd.choice("abcxyz ")), lambda: s and s.pop(at),
                            lambda: s and s.__setitem__(min(at, len(s) - 1), rnd.choice("abcxyz"))])()
            labels.add("".join(s))
    df = spark.createDataFrame([(s,) for s in labels] + [(None,)], "t string")
    got = {(r["a"], r["b"]) for r in fuzzy.fuzzy_duplicates(df).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(labels), 2)
            if 1 - _levenshtein(a, b) / max(len(a), len(b)) >= 0.92}
    assert got == want and want


def test_fuzzy_long_texts(spark):
    rnd = random.Random(8)
    labels = set()
    for n in (60, 90, 150):
        base = [rnd.choice("abcdefgh ") for _ in range(n)]
        for edits in range(0, n // 9):
            s = list(base)
            for _ in range(edits):
                at = rnd.randrange(len(s))
                rnd.choice([lambda: s.insert(at, "x"), lambda: s.pop(at), lambda: s.__setitem__(at, "y")])()
            labels.add("".join(s))
    got = {(r["a"], r["b"]) for r in fuzzy.fuzzy_duplicates(spark.createDataFrame([(s,) for s in labels], "t string")).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(labels), 2) if 1 - _levenshtein(a, b) / max(len(a), len(b)) >= 0.92}
    assert got == want and len(want) > 20


@pytest.mark.parametrize("bucket", ["DAY", "HOUR", "MONTH"])
def test_asof_join_equals_brute_force(spark, bucket):
    rnd = random.Random(6)
    at = lambda: f"2024-01-{rnd.randrange(1, 12):02d} {rnd.randrange(24):02d}:{rnd.randrange(60):02d}:00"
    left = [(i, rnd.randrange(4), at()) for i in range(80)]
    right = [(k, t, float(i)) for i, (k, t) in enumerate({(rnd.randrange(3), at()) for _ in range(60)})]
    l_df = spark.createDataFrame(left, "id int, k int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    r_df = spark.createDataFrame(right, "k int, t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = {r["id"]: r["asof_v"] for r in ordered.asof_join(l_df, r_df, ["k"], "t", "t", ["v"], bucket).collect()}
    for i, k, t in left:
        best = max(((rt, v) for rk, rt, v in right if rk == k and rt <= t), default=(None, None))
        assert got[i] == best[1]


def test_range_join_equals_brute_force(spark):
    rnd = random.Random(7)
    points = [(i, rnd.uniform(-50, 50)) for i in range(100)]
    spans = [(j, a, a + rnd.uniform(0, 30)) for j, a in enumerate(rnd.uniform(-60, 50) for _ in range(30))]
    p, s = spark.createDataFrame(points, "i int, x double"), spark.createDataFrame(spans, "j int, a double, b double")
    got = {(r["i"], r["j"]) for r in ordered.range_join(p, s, F.col("x"), F.col("a"), F.col("b"), 4.0).collect()}
    assert got == {(i, j) for i, x in points for j, a, b in spans if a <= x <= b}


def test_sample_is_stable_and_whole(lineitem):
    keys = ["l_orderkey", "l_linenumber"]
    a = io.sample_rows(lineitem, 50, keys).collect()
    b = io.sample_rows(lineitem.repartition(13), 50, keys).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 50
    everything = sorted(lineitem.select(F.xxhash64(*keys).alias("h")).collect())[:50]
    assert sorted(lineitem.sparkSession.createDataFrame(a, lineitem.schema).select(F.xxhash64(*keys).alias("h")).collect()) == everything


def test_sample_of_equal_rows(spark):
    df = spark.createDataFrame([(1,)] * 20_000, "a int")
    assert io.sample_rows(df, 10, ["a"]).count() == 10


def test_large_sample_over_ranges(lineitem, monkeypatch):
    keys = ["l_orderkey", "l_linenumber"]
    n = lineitem.count() // 2
    want = io.sample_rows(lineitem, n, keys)
    monkeypatch.setattr(indexing, "ROWS_PER_RANGE", 300)
    got = io.sample_rows(lineitem, n, keys)
    assert got.exceptAll(want).count() == 0 and got.count() == n


def test_dbscan_in_six_dimensions(spark):
    """Clusters of rows in six features, against comparing all points."""
    rnd = random.Random(11)
    rows = [tuple(rnd.gauss(5.0 * (i % 3), 0.3) for _ in range(6)) for i in range(90)] + [tuple(rnd.uniform(-20, 40) for _ in range(6)) for _ in range(10)]
    names = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{n} double" for n in names))
    got = {r["id"]: r["cluster"] for r in clusters.cluster_dbscan(df, names, eps=1.2, min_pts=4, scale=False).collect()}
    near = {i: [j for j in range(100) if math.dist(rows[i], rows[j]) <= 1.2] for i in range(100)}
    core = {i for i in near if len(near[i]) >= 4}
    top = {i: i for i in core}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    for i in core:
        for j in near[i]:
            if j in core:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    for i in range(100):
        assert (got[i] == -1) == (i not in core and not any(j in core for j in near[i]))
        for j in core:
            if i in core:
                assert (got[i] == got[j]) == (find(i) == find(j))


def test_range_join_with_long_intervals(spark):
    rnd = random.Random(12)
    points = [(i, rnd.uniform(-50, 5000)) for i in range(300)]
    spans = [(i, a, a + rnd.choice([0.0, 0.5, 3.0, 700.0, 1e7])) for i in range(60) for a in [rnd.uniform(-60, 4000)]]
    p, s = spark.createDataFrame(points, "p int, at double"), spark.createDataFrame(spans, "s int, lo double, hi double")
    got = {(r["p"], r["s"]) for r in ordered.range_join(p, s, F.col("at"), F.col("lo"), F.col("hi"), 1.0).collect()}
    assert got == {(i, j) for i, x in points for j, a, b in spans if a <= x <= b}
