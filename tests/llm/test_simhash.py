import random

import numpy as np
import pytest

from tablescope.llm import simhash
from tablescope.llm.simhash import components, fingerprint, links, near_duplicates

from .helpers import no_docs, odd_docs, odd_rows, prose


def brute(values):
    """Smallest member of the component of each value."""
    top = {v: v for v in values}

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    for a in values:
        for b in values:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("long", [48, 2])
def test_links_lose_nothing(spark, monkeypatch, tmp_path, long):
    """Families of close values, at distances up to 5; with ``long`` 2 nearly all lists go over midpoints."""
    monkeypatch.setattr(simhash, "LONG", long)
    rng = random.Random(4)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(5):
            v = base
            for bit in rng.sample(range(64), rng.randrange(0, 5)):
                v ^= 1 << bit
            values.add(v)
            base = v if rng.random() < 0.5 else base
    signed = sorted(v - 2**64 if v >= 2**63 else v for v in values)
    nodes = spark.createDataFrame([(v, 1) for v in signed], "fp bigint, doc int")
    tops = components(links(nodes, f"{tmp_path}/x"), f"{tmp_path}/x")
    got = {v: v for v in signed} | {r.node: r.top for r in tops.collect()}
    assert got == brute(signed)


def test_whole_operator_on_odd_rows(spark):
    got = near_duplicates(odd_docs(spark)).collect()
    assert len(got) == len(odd_rows())
    for row, text in zip(sorted(odd_rows(), key=str), got):
        assert len(text.fingerprint) == 16
    by_text = {}
    for doc, text, *_ in odd_rows():
        by_text.setdefault(f"{fingerprint(text):016x}", []).append(doc)
    assert sorted(r.fingerprint for r in got) == sorted(k for k, v in by_text.items() for _ in v)
    component = {r.doc_id: r.component_id for r in got}
    assert component[1] == component[2] == component[3] == 1 and component[8] == component[7] == 7 and component[None] is None
    assert near_duplicates(no_docs(spark)).collect() == []


def test_fingerprint_against_plain_counting():
    import xxhash
    for seed, n in ((1, 3), (2, 4), (3, 5), (4, 700)):
        words = prose(seed, n).upper().split()
        low = [w.lower() for w in words]
        shingles = [" ".join(low[i:i + 4]) for i in range(len(low) - 3)] if n >= 4 else [" ".join(low)]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
        assert fingerprint(" \n".join(words)) == want
    assert fingerprint(None) == fingerprint(" ") == 0
    assert np.uint64(fingerprint("a b c d")) > 0
