import hashlib
import math
import random

import numpy as np
import pytest

from tablescope.llm.gnat import Gnat, nearest, product_codes

SCHEMA = "vec_id bigint, embedding array<double>, label string"


def brute(rows):
    """{(vec_id, code, error, label_error)} and the digest, in plain integers."""
    kept = [(i, v, lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max([len(v) for _, v, _ in rows if v is not None], default=0)
    width = 4 * -(-width // 4)
    whole = [[math.floor(1024 * x) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    part = width // 4
    cut = [[w[p * part:(p + 1) * part] for p in range(4)] for w in whole]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:256]
    books = [[list(cut[i][p]) for i in order] for p in range(4)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(4):
        after = []
        for p in range(4):
            got = [near(p, c[p])[1] for c in cut]
            after.append([[sum(cut[i][p][d] for i in own) // len(own) for d in range(part)]
                          if (own := [i for i, g in enumerate(got) if g == k]) else e for k, e in enumerate(books[p])])
        books = after
    found, sums = [], {}
    for (i, _, lab), c in zip(kept, cut):
        pairs = [near(p, c[p]) for p in range(4)]
        error = min(sum(d for d, _ in pairs), 2**63 - 1)
        found.append((i, "".join(f"{k:02x}" for _, k in pairs), error, lab))
        sums[lab] = sums.get(lab, 0) + error
    text = ",".join(str(v) for b in books for e in b for v in e)
    return sorted(str((i, c, e, min(sums[lab], 2**63 - 1))) for i, c, e, lab in found), hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows):
    want, digest = brute(rows)
    got = product_codes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(tuple(r)[:4]) for r in got) == want
    assert {r.codebooks_sha256 for r in got} <= {digest}
    return got


def test_against_plain_integers(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], rng.choice(["a", "a", "b", None])) for i in range(700)]
    rows += [(1000 + i, [rng.choice([-0.001, 0.0, 0.001]) for _ in range(8)], "t") for i in range(200)]  # ties
    rng.shuffle(rows)
    assert len(check(spark, rows)) == 900


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [0.5, -0.25, 0.125, 1.0, -1.0, 0.0]
    rows = [(1, None, "a"), (2, [nan] * 6, "a"), (3, [inf, 1.0], "a"), (4, [1.0, None], "a"), (5, [], "a"), (6, good, None),
            (6, good, None), (6, [0.5], "b"), (None, good, "b"), (8, [-x for x in good], "b"), (9, [1e-320, -1e-320, 0.0], "b")]
    assert len(check(spark, rows)) == 7
    assert product_codes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert product_codes(spark.createDataFrame([(1, None, "a")], SCHEMA)).collect() == []
    big = [(i, [(-1.0) ** i * 10.0 ** (i % 9), 3.0, -0.1, 2.0 ** (i % 23)], "a") for i in range(40)]
    check(spark, big)
    huge = [(i, [(-1.0) ** i * 1e250, 3.0 * i, 1e30 * i, 0.0], "a") for i in range(5)]
    check(spark, huge)
    extra = spark.createDataFrame([("k", [0.5, 1.0], 3, 1, 2)], "id string, vec array<float>, kind int, vector int, n int")
    assert product_codes(extra, key="id", vector="vec", label="kind").first().code == "00000000"


@pytest.mark.parametrize("kind", ["clusters", "ties", "noise"])
def test_tree_finds_the_nearest_of_lowest_index(kind):
    rng = np.random.default_rng(4)
    if kind == "ties":
        entries, points = rng.integers(-2, 3, (256, 3)), rng.integers(-2, 3, (3000, 3))
    else:
        centres = rng.integers(-1000, 1000, (12, 16)) if kind == "clusters" else np.zeros((1, 16), int)
        entries = centres[rng.integers(0, len(centres), 256)] + rng.integers(-60, 60, (256, 16))
        points = centres[rng.integers(0, len(centres), 3000)] + rng.integers(-60, 60, (3000, 16))
    tree = Gnat(entries.astype(float), np.arange(256))
    four = np.tile(points, 4).astype(float)
    index, best = nearest([tree] * 4, four)
    far = ((points[:, None, :] - entries[None]) ** 2).sum(2)
    assert (index[:, 0] == far.argmin(1)).all() and (best[:, 3] == far.min(1)).all()
    wide, _ = nearest([Gnat(entries.astype(object), np.arange(256))] * 4, four[:50].astype(int).astype(object))
    assert (wide[:, 0] == far.argmin(1)[:50]).all()


def test_subtrees_are_left_out(monkeypatch):
    """On clustered entries most distances are never measured."""
    import tablescope.llm.gnat as gnat
    rng, measured = np.random.default_rng(1), [0]
    centres = rng.integers(-4000, 4000, (16, 16))
    entries = (np.repeat(centres, 16, axis=0) + rng.integers(-30, 30, (256, 16))).astype(float)
    points = (centres[rng.integers(0, 16, 2000)] + rng.integers(-30, 30, (2000, 16))).astype(float)
    tree, real = Gnat(entries, np.arange(256)), gnat.squares

    def counted(a, b):
        measured[0] += len(a) * len(b)
        return real(a, b)

    monkeypatch.setattr(gnat, "squares", counted)
    tree.search(points, np.arange(2000), np.full(2000, np.inf), np.full(2000, 256))
    assert measured[0] < 2000 * 256 / 4
