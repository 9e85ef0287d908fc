import hashlib
import random
import re

import pytest

from tablescope.llm import lempel_ziv
from tablescope.llm.lempel_ziv import distinct_texts, distinct_words, duplicate_spans

from .helpers import no_docs, odd_docs, odd_rows, prose


def brute(rows):
    """(key, n_words, n_removed, digest) for (key, text) rows, by all windows in order."""
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i:i + 20])
            if window in seen:
                gone[i:i + 20] = [True] * 20
            seen.add(window)
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((key, len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept)))
    return out


def corpus():
    """Passages of 15 to 60 words shared whole, cut and mixed, runs of one word, copies, periodic text."""
    rng, rows = random.Random(8), []
    shared = [prose(100 + i, n).split() for i, n in enumerate((15, 19, 20, 21, 33, 60, 60))]
    for i in range(160):
        words = prose(i, rng.randrange(0, 50)).split()
        for _ in range(rng.randrange(4)):
            passage = rng.choice(shared)
            cut = rng.randrange(0, 8)
            words += passage[cut:len(passage) - rng.randrange(0, 8)] + prose(1000 + i, rng.randrange(3)).split()
        rows.append((3 * i, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(1001, "a " * 300), (1002, "b a " * 30), (1004, "a b c d e " * 6), (1007, rows[5][1]), (1008, rows[5][1])]
    rows += [(2000 + i, f"{prose(7, 8)} x{i} {prose(9, 30)}") for i in range(40)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize("batch, block", [(8 << 20, 2_000_000), (700, 300)])
def test_against_all_windows(spark, monkeypatch, batch, block):
    monkeypatch.setattr(lempel_ziv, "BATCH", batch)
    monkeypatch.setattr(lempel_ziv, "BLOCK", block)
    rows = corpus()
    random.Random(1).shuffle(rows)
    want = brute(rows)
    got = distinct_words(frame(spark, rows).repartition(5)).orderBy("doc_id").collect()
    assert [tuple(r)[:4] for r in got] == [w[:4] for w in want]
    assert sum(r.n_removed for r in got) > 1000
    kept = {r.doc_id: r.text for r in distinct_texts(frame(spark, rows)).collect()}
    assert kept == {w[0]: w[4] for w in want}


def test_spans_point_at_earlier_equal_words(spark, monkeypatch):
    monkeypatch.setattr(lempel_ziv, "BATCH", 900)
    rows = corpus()
    words = {k: t.split() for k, t in rows}
    spans = duplicate_spans(frame(spark, rows).coalesce(1)).collect()
    bases = {r.base: r.doc_id for r in spans}
    assert spans and all(r.length >= 20 and r.source < r.base + r.start for r in spans)
    checked = 0
    for r in spans:
        own = [b for b in bases if b <= r.source < b + len(words[bases[b]])]
        if own:  # the source is a row that has spans itself, so its place is known
            at = r.source - own[0]
            assert words[bases[own[0]]][at:at + r.length] == words[r.doc_id][r.start:r.start + r.length]
            checked += 1
    assert checked


def test_odd_rows(spark):
    rows = odd_rows()
    want = sorted(str(w[:4]) for w in brute([(r[0], r[1]) for r in rows]))
    got = distinct_words(odd_docs(spark)).collect()
    assert sorted(str(tuple(r)[:4]) for r in got) == want
    assert distinct_words(no_docs(spark)).collect() == []
    assert distinct_texts(no_docs(spark)).collect() == [] and duplicate_spans(no_docs(spark)).collect() == []
    same = spark.createDataFrame([(None, prose(3, 30))] * 50, "id string, body string")
    assert sorted(r.n_removed for r in distinct_words(same, key="id", text="body").collect()) == [0] + [30] * 49
