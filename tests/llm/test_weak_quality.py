import numpy as np

from tablescope.llm.weak_quality import BAD, GOOD, LABELLERS, SILENT, estimate, weak_quality

from .helpers import no_docs, odd_docs, odd_rows, prose


def test_estimation_recovers_rates():
    """Votes drawn from known rates: the estimates come near them and the posterior near the truth."""
    rng = np.random.default_rng(7)
    n, k = 20_000, len(LABELLERS)
    truth = rng.random(n) < 0.85
    on_good, on_bad = np.full(k, 0.99), np.linspace(0.1, 0.5, k)
    good = np.where(truth[:, None], rng.random((n, k)) < on_good, rng.random((n, k)) < on_bad)
    votes = np.where(rng.random((n, k)) < 0.1, SILENT, np.where(good, GOOD, BAD))
    patterns, at, counts = np.unique(votes @ 3 ** np.arange(k), return_inverse=True, return_counts=True)
    posterior, rates, prior = estimate(patterns, counts.astype(float))
    assert abs(prior - truth.mean()) < 0.01 and np.abs(rates[1] - on_good).max() < 0.02 and np.abs(rates[0] - on_bad).max() < 0.04
    assert ((posterior[at] >= 0.5) == truth).mean() > 0.99


def sentence(seed, n):
    words = [w if i % 4 else "the" for i, w in enumerate(prose(seed, n).split())]
    return " ".join(w + "." if i % 12 == 11 else w for i, w in enumerate(words))


def test_keeps_prose_and_rejects_junk(spark):
    good = [(i, sentence(i, 60 + i % 100)) for i in range(300)]
    junk = ([(1000 + i, " ".join(w + "***" for w in sentence(i, 80).split())) for i in range(30)]
            + [(2000 + i, " ".join([w for w in sentence(i, 9).split() for _ in range(12)])) for i in range(30)]
            + [(3000 + i, sentence(i, 90).upper().replace(" ", "!! ")) for i in range(30)])
    got = {r.doc_id: r for r in weak_quality(spark.createDataFrame(good + junk, "doc_id int, text string")).collect()}
    assert len(got) == 390
    assert np.mean([got[i].kept for i, _ in good]) > 0.98 and np.mean([got[i].kept for i, _ in junk]) < 0.05


def test_odd_rows(spark):
    got = weak_quality(odd_docs(spark)).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert weak_quality(no_docs(spark)).collect() == []


def test_shape_reads_whole_words():
    from tablescope.llm.weak_quality import shape
    assert shape("a" * 64 + "9" * 50) == "a9" and shape("Ab-" * 40) == "Aa-" * 40 and shape("") == ""
