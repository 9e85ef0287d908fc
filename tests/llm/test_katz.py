import math
import zlib
from collections import Counter, defaultdict

import pytest

from tablescope.llm import katz
from tablescope.llm.katz import END, OTHER, discounts, model_scores

from .helpers import no_docs, odd_docs, odd_rows, prose


def tokens(text):
    return [w for w in (text or "").encode().lower().split()] + [b""]


class Plain:
    """The same model by dictionaries."""

    def __init__(self, texts, vocabulary):
        self.c = Counter(w for t in texts for w in tokens(t))
        self.n, self.v = sum(self.c.values()), len(self.c)
        d = discounts(Counter(self.c.values()))
        freed = sum(r * (1 - d[r]) for r in self.c.values() if r <= 6) / self.n
        scale, self.unknown = (1, freed) if freed > 0 else (self.n / (self.n + 1), 1 / (self.n + 1))
        self.one = lambda w: scale * d[min(self.c[w], 6)] * self.c[w] / self.n if self.c[w] else self.unknown
        floor, held = 10**9, 0
        for n, rows in sorted(Counter(v for w, v in self.c.items() if w).items(), reverse=True):
            held += rows
            if held > vocabulary:
                break
            floor = n
        self.known = {w for w, n in self.c.items() if w and n >= floor} | {b""}
        self.prob = {w: self.one(w) for w in self.known}
        self.prob[None] = 1 - sum(self.prob.values())
        self.pairs = Counter(p for t in texts for p in self.steps(t))
        self.d2 = discounts(Counter(self.pairs.values()))
        self.seen, self.kept, self.covered, self.kinds = Counter(), defaultdict(float), defaultdict(float), Counter()
        for (h, w), n in self.pairs.items():
            self.seen[h] += n
            self.kept[h] += self.d2[min(n, 6)] * n
            self.covered[h] += self.prob[w]
            self.kinds[h] += 1

    def steps(self, text):
        words = [w if w in self.known else None for w in tokens(text)]
        return list(zip(["start", *words], words))

    def two(self, h, w):
        if not self.seen[h]:
            return self.prob[w]
        if self.kinds[h] == len(self.prob):
            return self.d2[min(self.pairs[h, w], 6)] * self.pairs[h, w] / self.kept[h]
        total = self.seen[h] if self.kept[h] < self.seen[h] * (1 - 1e-12) else self.seen[h] + 1
        n = self.pairs[h, w]
        return self.d2[min(n, 6)] * n / total if n else (1 - self.kept[h] / total) / max(1e-12, 1 - self.covered[h]) * self.prob[w]

    def score(self, text):
        out = 0.0
        for (h, w), word in zip(self.steps(text), tokens(text)):
            out += math.log10(self.two(h, w) * (self.one(word) / self.prob[None] if w is None else 1))
        return out


@pytest.mark.parametrize("vocabulary, frequent, per_bucket", [(500_000, 500_000, 3_000_000), (60, 10, 700), (60, 0, 100)])
def test_equals_plain_model(spark, monkeypatch, vocabulary, frequent, per_bucket):
    for name, value in (("VOCABULARY", vocabulary), ("FREQUENT", frequent), ("PER_BUCKET", per_bucket)):
        monkeypatch.setattr(katz, name, value)
    rows = odd_rows() + [(100 + i, prose(i, i % 40), "en", "a", 1, "s", 0, "x", 1) for i in range(150)]
    docs = spark.createDataFrame(rows, odd_docs(spark).schema)
    held = {d: zlib.crc32((str(d) if d is not None else "").encode()) % 7 == 2 for d, *_ in rows}
    model = Plain([t for d, t, *_ in rows if not held[d]], vocabulary)
    for h in ["start", None, b"", *list(model.known)[:5]]:
        assert abs(sum(model.two(h, w) for w in model.prob) - 1) < 1e-9
    text = {}
    for d, t, *_ in rows:
        text.setdefault(d, []).append(t)
    got = model_scores(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        t = text[r.doc_id][0]
        own = tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(model.c[w] > 0 for w in own), model.n)
        base = sum(math.log10((model.c[w] + 1) / (model.n + model.v + 1)) for w in own)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, model.score(t), rel_tol=1e-7), r.doc_id


@pytest.mark.parametrize("numbered, frequent, per_bucket", [(60, 10, 700), (60, 0, 100), (0, 0, 5_000)])
def test_every_word_is_its_own_history(spark, monkeypatch, numbered, frequent, per_bucket):
    """However few words have numbers, the model is the one without a class."""
    for name, value in (("NUMBERED", numbered), ("FREQUENT", frequent), ("PER_BUCKET", per_bucket)):
        monkeypatch.setattr(katz, name, value, raising=False)
    rows = odd_rows() + [(100 + i, prose(i, i % 40), "en", "a", 1, "s", 0, "x", 1) for i in range(150)]
    docs = spark.createDataFrame(rows, odd_docs(spark).schema)
    model = Plain([t for d, t, *_ in rows if zlib.crc32((str(d) if d is not None else "").encode()) % 7 != 2], 10**9)
    assert len(model.known) > 500
    text = {d: t for d, t, *_ in rows}
    got = model_scores(docs).collect()
    assert len(got) == len(rows) and any(r.held_out and r.n_known > 5 for r in got)
    assert all(math.isclose(r.score, model.score(text[r.doc_id]), rel_tol=1e-7) for r in got)


def test_nothing_to_train_on(spark):
    assert model_scores(no_docs(spark)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = model_scores(spark.createDataFrame([(held, "a b")], "doc_id int, text string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in only] == [(True, 3, 0, 0)]
    assert all(math.isfinite(r.score) and r.base_score == 0 for r in only)


def test_discounts_are_usable():
    for of in ({}, {1: 5}, {1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 5}, {1: 3, 2: 9, 7: 2}, {2: 4}):
        d = discounts(of)
        assert d[0] == d[6] == 1 and ((d > 0) & (d <= 1)).all()
    assert END == 0 and OTHER == 1
