import random

from tablescope.llm import toxicity as T

from .helpers import no_docs, odd_docs, odd_rows, prose


def distances(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def test_automaton_against_edit_distance(monkeypatch):
    monkeypatch.setattr(T, "MOST_STATES", 60)  # the table is rebuilt now and then
    rng = random.Random(3)
    terms = list(dict.fromkeys(["".join(rng.choice("ab") for _ in range(rng.randint(2, 10))) for _ in range(12)]
                               + ["abab*", "babbabbaaa*", "aabbaabba*"]))
    automaton = T.Automaton(terms)
    for _ in range(2500):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        best = None
        for t in terms:
            bare = t.rstrip("*")
            d = min(distances(bare, word)) if t.endswith("*") else distances(bare, word)[-1]
            if d <= T.edits_allowed(t) and (best is None or d < best):
                best = d
        found = automaton.match(word)
        assert (found and found[1]) == best, word


def test_context_tells_quotation_from_abuse():
    def weight(text, word="fool"):
        raw = text.split()
        words = [T.plain(w) for w in raw]
        return T.context(words, raw, words.index(word), 0, len(raw))
    assert weight("a plain fool walks by") == 1.0
    assert weight('they wrote about "a fool" here') == T.QUOTED
    assert weight("he said fool to nobody") == T.QUOTED
    assert weight("you fool go away") == T.ADDRESSED


def corpus(n):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        words = prose(i, 40 + i % 50).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["grobnik", "Vileton!", "snarlish", "grobnics"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_learns_terms_and_catches_misspelling(spark):
    docs, labels = corpus(600)
    extra = [(9001, prose(1, 30) + " vilet0n and snarlishh " + prose(2, 30)), (9002, prose(3, 60)), (9003, None), (9004, "")]
    frame = spark.createDataFrame(docs + extra, "doc_id int, text string")
    got = {r.doc_id: r for r in T.toxicity(frame, spark.createDataFrame(labels, "doc_id int, quality int, toxic int")).collect()}
    assert len(got) == len(docs) + 4
    held = [(got[i].predicted, toxic) for i, _, toxic in labels if got[i].held_out]
    assert len(held) > 50 and all(p == t for p, t in held)
    assert got[9001].misspelled > 0 and got[9001].score > got[9002].score
    assert got[9003].score == got[9004].score < 0.5 and all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (7, None), (None, 1), (6, 0)], "doc_id bigint, toxic int")
    got = T.toxicity(odd_docs(spark), labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert T.toxicity(no_docs(spark), labels).collect() == []
    none = T.toxicity(odd_docs(spark), labels.where("false")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}


def test_stems_of_learnt_lengths_may_be_misspelled():
    from tablescope.llm.toxicity import STEMS, Automaton, edits_allowed
    assert [edits_allowed("x" * n + "*") for n in STEMS] == [0, 0, 1, 1, 1, 1]
    stem = Automaton(["stupid*"])
    assert stem.match("stupud") and stem.match("stupudness") and stem.match("stupids") and stem.match("stopud") is None
