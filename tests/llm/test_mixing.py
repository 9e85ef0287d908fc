import pytest

from tablescope.llm import mixing
from tablescope.llm.mixing import flight, mix_sources

from .helpers import no_docs, odd_docs, odd_rows, prose


def targets(sizes, ceiling=3.0):
    """Water-filling one round at a time."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > ceiling * sizes[s]}
        if not over:
            return out | share
        out |= {s: ceiling * sizes[s] for s in over}
        open_ -= over
    return out


def test_flight_keeps_totals():
    import numpy as np
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 50, 500):
        sizes, p = rng.integers(0, 900, n), np.full(n, 0.37)
        out = flight(sizes, p, "s")
        assert abs(out.sum() - p.sum()) < 1e-6 and abs(sizes @ out - sizes @ p) < 1e-4
        assert ((out > 0) & (out < 1)).sum() <= 2 and (n == 0 or (out.min() >= 0 and out.max() <= 1))
        assert (flight(sizes, p, "s") == out).all()
    equal = flight(np.full(9, 5), np.full(9, 1 / 3), "t")
    assert ((equal > 0) & (equal < 1)).sum() <= 2 and abs(equal.sum() - 3) < 1e-9


@pytest.mark.parametrize("block, fan", [(4096, 256), (16, 2)])
def test_mix_near_targets(spark, monkeypatch, block, fan):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "FAN", fan)
    rows = [(i, prose(i, 5 + i % 60), "abcdéz"[i % 6] if i % 3 else "hot") for i in range(600)] + [(900, prose(1, 12), "tiny"), (901, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = mix_sources(docs).collect()
    size, taken = {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.size == len(rows[r.doc_id if r.doc_id < 600 else r.doc_id - 300][1].split()) and 0 <= r.taken <= 3 * r.size
    want = targets(size)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in size:
        assert abs(taken[s] - want[s]) <= max(3, 0.02 * want[s]), s
    assert sorted(map(str, mix_sources(docs).collect())) == sorted(map(str, got))


def test_odd_rows(spark):
    got = mix_sources(odd_docs(spark)).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), len((t or "").split())) for d, t, *_ in odd_rows())
    assert abs(sum({r.source: r.target for r in got}.values()) - sum(r.size for r in got)) < 1e-6
    assert mix_sources(no_docs(spark)).collect() == []
    wordless = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id int, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mix_sources(wordless).collect()] == [(0, 0.0, 0)] * 2
