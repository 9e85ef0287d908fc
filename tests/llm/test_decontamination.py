import random

import numpy as np
import pyarrow as pa
import pytest

from tablescope.llm import decontamination
from tablescope.llm.decontamination import Items, align, contaminated, encode, passages, rarest

from .helpers import no_docs, odd_docs, prose


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1, j] - 0.5, h[i, j - 1] - 0.5)
    return h.max()


def test_alignment_against_full_table():
    rng = np.random.default_rng(1)
    for _ in range(150):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 14))
        score, begin, end = align(a, b)
        assert score == smith_waterman(a, b)
        assert score == 0 or smith_waterman(a, b[begin:end]) == score


@pytest.fixture(scope="module")
def bench():
    return [(i, prose(1000 + i, 30 + i)) for i in range(12)]


@pytest.mark.parametrize("block", [8 << 20, 900])
def test_finds_copies_and_leaves_others(spark, bench, monkeypatch, block):
    """Exact, recased, repunctuated and edited copies; a passage in many documents; one and several item blocks."""
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    rng = random.Random(2)

    def edited(text):
        words = text.split()
        for k in rng.sample(range(len(words)), len(words) // 6):
            words[k] = "changed"
        return " ".join(words)

    docs, want = [], set()
    for n in range(40):
        around = prose(n, 150), prose(n + 500, 80)
        item, text = bench[n % 12] if n < 24 else bench[3]
        copy = [text, text.upper(), text.replace(" ", ",\n"), edited(text)][n % 4]
        docs.append((n, f"{around[0]} {copy} {around[1]}"))
        want.add((n, item))
    docs += [(100 + n, prose(n + 7000, 300)) for n in range(20)]
    docs += [(200, " ".join(bench[5][1].split()[:9]) + " " + prose(1, 100))]  # too little of an item
    got = contaminated(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(bench, "item_id int, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert all(0.5 <= r.score <= 1 and r.end_word - r.start_word <= 60 for r in got.collect())


@pytest.mark.parametrize("beside", [False, True])
@pytest.mark.parametrize("every", [4, 5, 6, 7])
def test_regularly_edited_copies_against_whole_alignment(spark, bench, every, beside):
    """One word of every few changed, as the only copy of an item and beside an exact one; all pairs aligned in full."""
    docs = []
    for i, text in bench:
        words = [f"new{k}" if k % every == every - 1 else w for k, w in enumerate(text.split())]
        docs.append((i, f"{prose(i, 40)} {' '.join(words)} {prose(i + 500, 40)}"))
        docs += [(100 + i, f"{prose(i + 900, 30)} {text}")] if beside else []
    numbers = {}
    code = lambda t: np.array([numbers.setdefault(w, len(numbers)) for w in t.split()])
    want = {(d, i) for d, t in docs for i, item in bench if align(code(item), code(t))[0] >= 0.5 * len(item.split())}
    assert want >= {(i, i) for i, _ in bench}
    got = contaminated(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(bench, "item_id int, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


@pytest.mark.parametrize("n", [3, 12, 16, 30, 45, 60, 61, 150])
def test_rarest_triples_meet_every_copy_within_the_edit_rate(n):
    """Random stretches with at most one edit in four words, scored without gaps, always keep a seed; adverse counts."""
    rng = random.Random(n)
    enough = min(0.5 * n, 30.0)
    tried = 0
    for _ in range(3000):
        length = rng.randint(min(n, 3), min(n, 48))
        start = rng.randrange(n - length + 1)
        phase = rng.randrange(4)
        edits = rng.choice([set(range(start + phase, start + length, 4)), set(rng.sample(range(start, start + length), length // 4)),
                            set(rng.sample(range(start, start + length), rng.randint(0, length // 4)))])
        if len(edits) > length // 4 or length - 1.5 * len(edits) < enough:
            continue
        tried += 1
        kept = [p for p in range(start, start + length - 2) if not {p, p + 1, p + 2} & edits]
        # the copy's own triples are counted most often
        frequency = np.array([9 if p in kept else rng.randint(0, 9) for p in range(n - 2)])
        chosen = rarest(frequency, enough, n)
        assert any(chosen[p] for p in kept)
    assert tried


def test_common_phrase_does_not_join_all(spark):
    """A phrase of every item and every text links none of them: only the copies are aligned."""
    vocabulary = [f"w{k}" for k in range(30_000)]
    phrase = " as well as "
    items = [(i, prose(i, 20, vocabulary) + phrase + prose(5000 + i, 20, vocabulary)) for i in range(400)]
    docs = [(d, prose(9000 + d, 60, vocabulary) + phrase + (items[d][1] if d < 20 else "")) for d in range(400)]
    held = Items(items)
    words, owners = encode(pa.array([t for _, t in docs]), held.numbers)
    ends = np.cumsum(np.bincount(owners, minlength=len(docs)))
    starts = np.r_[0, ends[:-1]]
    frequency = np.ones(len(held.codes), np.int64)
    common = np.bincount(np.concatenate(held.places)) > 300
    frequency[common] = 400
    found = list(passages(held, held.members(), held.seeds(frequency), words, owners, starts, ends))
    assert [(t, i) for t, i, _, _ in found] == [(d, d) for d in range(20)]
    # the same where the phrase stays a seed: passages that share too few words are left out before alignment
    every = (np.concatenate(held.places), np.repeat(np.arange(400), [len(p) for p in held.places]),
             np.concatenate([np.arange(len(p)) for p in held.places]))
    order = np.argsort(every[0], kind="stable")
    seeds = held.codes[every[0][order]], every[1][order], every[2][order]
    assert {(t, i) for t, i, _, _ in passages(held, held.members(), seeds, words, owners, starts, ends)} == {(d, d) for d in range(20)}
    got = contaminated(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(d, d) for d in range(20)}


def test_odd_rows(spark, bench):
    items = spark.createDataFrame(bench + [(50, None), (51, ""), (52, "two words"), (None, prose(7, 60)), (53, prose(7, 60))],
                                  "item_id int, text string")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in contaminated(odd_docs(spark), items).collect())
    assert got == sorted([("7", "None"), ("7", "None"), ("7", "53"), ("7", "53"), ("8", "None"), ("8", "53")])
    assert contaminated(no_docs(spark), items).collect() == []
    assert contaminated(odd_docs(spark), items.where("false")).collect() == []
