import math
import re
from collections import Counter

from tablescope.llm.quality_rules import COMMON, WORD_GUARD, quality_rules

from .helpers import no_docs, odd_docs, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def jsd(p, q):
    out = 0.0
    for a, b in zip(p, q):
        for x in (a, b):
            if x:
                out += 0.5 * x * math.log2(2 * x / (a + b))
    return math.sqrt(max(0.0, out))


def test_base_numbers_on_odd_rows(spark):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in quality_rules(odd_docs(spark)).collect()), key=str)
    want = sorted(((d, *(b := base(t)), b[0] < 10 or 100 * b[4] > 20 * b[0]) for d, t, *_ in odd_rows()), key=str)
    assert got == want
    assert quality_rules(no_docs(spark)).collect() == []


def test_overlapping_repeats(spark):
    texts = ["a b a b a b a b a b", "x " * 30, "p q r s t u p q r s t z p q r s t", "a b c d e f g h i j k", "l1 l2\nl1 l2 \nl1 l2\n\n  \n"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id int, text string, lang string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules(docs).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}


def test_word_distance_and_verdict(spark):
    texts = [prose(i, 300) + " " + "the of and " * 30 for i in range(12)]
    texts.append(" ".join(w + "###" for w in prose(50, 300).split()))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id int, text string, lang string")
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    counts = Counter(w.lower() for t in texts for w in WORD.findall(t))
    common = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:COMMON]]
    whole = sum(counts.values())
    q = [counts[w] / whole for w in common]
    q.append(1 - sum(q))
    for i, t in enumerate(texts):
        own = Counter(w.lower() for w in WORD.findall(t))
        n = sum(own.values())
        p = [own[w] / n for w in common]
        p.append(1 - sum(p))
        assert n >= WORD_GUARD and abs(got[i].word_distance - jsd(p, q)) < 1e-9
    assert not got[12].kept and got[12].char_distance > 0.3
