"""Toxicity: Levenshtein automata over a lexicon trie, weighed by context windows.

The lexicon is learnt from labelled rows: words, and stems that many words share, which toxic texts hold far more often than
others. Its trie is intersected with the Levenshtein automata of all its terms: a state is a set of (trie node, edits) pairs,
built when a text first needs it, so a word costs one step per character however many terms and edits are allowed. Each
match is weighed by the words around it: inside quotation marks or after a word of report it counts less, next to a word of address
it counts more. Sums of these weights are the features of a logistic model fitted on the labelled rows.

Labelled rows beyond ``SAMPLE`` are thinned by a hash of the key; that bound covers the fit only, every text is
scored whole. Defined results: null and empty texts have no match and get the score of a text without any; without both kinds
of labels the score is 0; null keys are held out; labels that are null count as absent, repeated labels of a key as
toxic if one is; repeated rows are scored each; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import column, pieces, shared_folder, split_words, write

SAMPLE = 20_000            # labelled rows that the lexicon and the model are fitted on
LEXICON = 500              # terms
STEMS = range(3, 9)        # lengths of stems
LEAST_TEXTS, LEAST_RATIO, LEAST_G, NEARLY = 4, 12.0, 22.0, 0.9
ONE_EDIT, TWO_EDITS = 5, 9  # length from which a term may be misspelled by so many edits
AROUND = 8                 # words on either side that make the context
QUOTED, ADDRESSED = 0.3, 1.3
QUOTES = "\"“”„«»‘’"
REPORT = frozenset("said says saying wrote writes called quote quoted quotes word words term terms meaning".split())
ADDRESS = frozenset("you your you're youre u du dich dein tu te ton toi tú eres vous ihr".split())
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
MOST_STATES = 100_000
FEATURES = ["exact", "misspelled", "terms", "density", "length"]


def plain(word: str) -> str:
    """A word without punctuation at its ends, with digits and signs that stand for letters read as those."""
    word = EDGES.sub("", word.lower())
    return word.translate(LOOKALIKE) if any(c.isalpha() for c in word) else ""


def edits_allowed(term: str) -> int:
    size = len(term.rstrip("*"))
    return (size >= ONE_EDIT) + (size >= TWO_EDITS and not term.endswith("*"))


class Automaton:
    """All Levenshtein automata of the terms on their common trie; a term ending in * matches any ending."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach = [0]   # most edits allowed to any term below a node
        for number, term in enumerate(terms):
            node, most = 0, edits_allowed(term)
            self.reach[0] = max(self.reach[0], most)
            for letter in term.rstrip("*"):
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][letter]
                self.reach[node] = max(self.reach[node], most)
            self.ends[node].append(number)
        self.reset()

    def reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.finals: list[tuple[int, int] | None] = []
        self.first = self.state(self.closed({(0, 0)}), frozenset())

    def closed(self, pairs: set) -> frozenset:
        """Add the nodes reached by leaving out letters of terms; keep the fewest edits of each node."""
        fewest: dict[int, int] = {}
        todo = sorted(pairs, key=lambda p: p[1])
        while todo:
            node, edits = todo.pop()
            if edits > self.reach[node] or fewest.get(node, 99) <= edits:
                continue
            fewest[node] = edits
            todo += [(child, edits + 1) for child in self.children[node].values()]
        return frozenset(fewest.items())

    def state(self, pairs: frozenset, begun: frozenset) -> int:
        """``begun``: stems (term, edits) that the word already starts with."""
        reached = {}
        for node, edits in pairs:
            for term in self.ends[node]:
                if edits <= edits_allowed(self.terms[term]):
                    reached[term] = edits
        begun = frozenset(dict(sorted([*begun, *((t, n) for t, n in reached.items() if self.terms[t].endswith("*"))],
                                      key=lambda x: -x[1])).items())
        key = frozenset([("pairs", pairs), ("begun", begun)])
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append((pairs, begun))
            self.steps.append({})
            done = [(n, -len(self.terms[t]), t) for t, n in [*reached.items(), *begun]]
            self.finals.append((min(done)[2], min(done)[0]) if done else None)
        return self.states[key]

    def step(self, state: int, letter: str) -> int:
        pairs, begun = self.sets[state]
        after = set()
        for node, edits in pairs:
            after.add((node, edits + 1))  # a letter too many
            for other, child in self.children[node].items():
                after.add((child, edits + (other != letter)))
        to = self.state(self.closed(after), begun)
        self.steps[state][letter] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """The term with the fewest edits, and their number."""
        if len(self.sets) > MOST_STATES:
            self.reset()
        state, sets, steps = self.first, self.sets, self.steps
        for letter in word:
            to = steps[state].get(letter)
            state = self.step(state, letter) if to is None else to
            if not sets[state][0] and not sets[state][1]:
                return None
        return self.finals[state]


def labelled(labels: DataFrame, key: str, label: str) -> DataFrame:
    """_key, toxic of the rows to learn from: known labels, not held out, at most about ``SAMPLE``."""
    known = (labels.where(column(label).isNotNull() & column(key).isNotNull())
             .groupBy(column(key).alias("_key")).agg(F.max((column(label).cast("double") > 0).cast("int")).alias("toxic")).where(~held_out(F.col("_key"))))
    rate = min(1.0, SAMPLE / max(1, known.count()))
    return known.where(F.xxhash64("_key", F.lit("toxic")).cast("double") / 2.0 ** 64 + 0.5 < rate)


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def g_score(a: float, b: float, pos: int, neg: int) -> float:
    """Log-likelihood ratio of a term in ``a`` of ``pos`` toxic and ``b`` of ``neg`` other texts."""
    def part(seen: float, expected: float) -> float:
        return seen * math.log(seen / expected) if seen else 0.0
    share = (a + b) / (pos + neg)
    return 2 * (part(a, pos * share) + part(b, neg * share) + part(pos - a, pos * (1 - share)) + part(neg - b, neg * (1 - share)))


def learn_lexicon(train: DataFrame) -> list[tuple[str, float]]:
    """Terms with their log ratio; ``train`` has text, toxic and a bounded number of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                words = {plain(w) for w in re.split(r"[\x20\x09-\x0D]+", text or "")} - {""}
                for term in words | {w[:n] + "*" for w in words for n in STEMS if n <= len(w)}:
                    seen.setdefault(term, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()),
                                              pa.array([v[0] for v in seen.values()], pa.int64())], ["term", "a", "b"])

    neg, pos = (train.where(f"toxic = {k}").count() for k in (0, 1))
    if not pos or not neg:
        return []
    counts = train.select("text", "toxic").mapInArrow(run, "term string, a bigint, b bigint").groupBy("term").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"))
    ratio = F.expr(f"(a / {pos}) / ((b + 0.5) / {neg})")
    strong = counts.where((F.col("a") >= LEAST_TEXTS) & (ratio >= LEAST_RATIO)).orderBy(F.desc("a"), "b", "term").limit(20 * LEXICON)
    found = [(g_score(a, b, pos, neg), t.rstrip("*"), t, a, b) for t, a, b in strong.collect()]
    chosen: list[tuple[str, float]] = []
    taken: list[str] = []
    for g, bare, term, a, b in sorted(found, key=lambda x: (-x[0], x[2])):
        if g < LEAST_G or any(bare.startswith(c) or c.startswith(bare) for c in taken):
            continue
        # the longest form that says nearly as much: a word rather than its first letters
        _, _, bare, term, a, b = max((len(x), not t.endswith("*"), x, t, c, d) for h, x, t, c, d in found
                                     if x.startswith(bare) and h >= NEARLY * g)
        taken.append(bare)
        chosen.append((term, math.log((a + 0.5) / (pos + 1) / ((b + 0.5) / (neg + 1)))))
        if len(chosen) == LEXICON:
            break
    return chosen


def context(words: list[str], raw: list[str], at: int, first: int, last: int) -> float:
    """Weight of a match by the words around it, between the text's first and last word."""
    low, high = max(first, at - AROUND), min(last, at + AROUND + 1)
    mine = raw[at]
    opened = mine[0] in QUOTES or any(w[0] in QUOTES for w in raw[low:at])
    closed = mine.rstrip(".,;:!?")[-1:] in QUOTES and mine[-1:] != "" or any(w.rstrip(".,;:!?")[-1:] in QUOTES
                                                                           for w in raw[at + 1:high] if w.rstrip(".,;:!?"))
    if opened and closed or not REPORT.isdisjoint(words[low:at]):
        return QUOTED
    return ADDRESSED if not ADDRESS.isdisjoint(words[low:high]) else 1.0


def features(docs: DataFrame, lexicon: list[tuple[str, float]]) -> DataFrame:
    """doc and the features of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([t for t, _ in lexicon])
        weight = np.array([w for _, w in lexicon] + [0.0])
        for b in pieces(batches, "text"):
            flat, owners = split_words(b.column("text"), lower=False)
            coded = flat.dictionary_encode()
            forms = coded.dictionary.to_pylist()
            found = [automaton.match(p) if (p := plain(f)) else None for f in forms]
            term = np.array([f[0] if f else -1 for f in found] or [-1])
            edits = np.array([f[1] if f else 0 for f in found] or [0])
            codes = coded.indices.to_numpy()
            hits = np.flatnonzero(term[codes] >= 0) if len(codes) else np.array([], np.int64)
            sizes = np.bincount(owners, minlength=b.num_rows)
            ends = np.cumsum(sizes)
            out = np.zeros((b.num_rows, len(FEATURES)))
            distinct: dict[int, set] = {}
            for at in hits.tolist():
                text = int(owners[at])
                low, high = max(int(ends[text] - sizes[text]), at - AROUND), min(int(ends[text]), at + AROUND + 1)
                raw = [forms[c] for c in codes[low:high].tolist()]
                power = context([plain(r) for r in raw], raw, at - low, 0, len(raw)) * weight[term[codes[at]]]
                wrong = int(edits[codes[at]])
                out[text, 1 if wrong else 0] += power * 0.5 ** wrong
                if not wrong:
                    distinct.setdefault(text, set()).add(int(term[codes[at]]))
            for text, terms in distinct.items():
                out[text, 2] = len(terms)
            out[:, 3] = out[:, 0] / np.sqrt(sizes + 1)
            out[:, :3] = np.log1p(out[:, :3])
            out[:, 4] = np.log1p(sizes) / 10
            yield pa.RecordBatch.from_arrays([b.column("doc"), *(pa.array(out[:, i]) for i in range(len(FEATURES)))], ["doc", *FEATURES])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc {kind}, " + ", ".join(f"{f} double" for f in FEATURES))


def toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Key, held_out, score, predicted and the features of every text."""
    root = shared_folder(docs.sparkSession, "toxic")
    plain_docs = docs.select(column(key).alias("doc"), column(text).alias("text"))
    chosen = write(labelled(labels, key, label).coalesce(1), f"{root}/labels")
    train = write(plain_docs.join(F.broadcast(chosen), F.col("doc") == F.col("_key")).select("text", "toxic"), f"{root}/train")
    lexicon = learn_lexicon(train)
    scored = write(features(plain_docs, lexicon), f"{root}/features")
    rows = scored.join(F.broadcast(chosen), F.col("doc") == F.col("_key"))
    both = rows.select("toxic").distinct().count() == 2
    score = F.lit(0.0)
    if both:
        assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
        model = LogisticRegression(labelCol="toxic", regParam=1e-3, maxIter=50).fit(assembled)
        margin = F.lit(float(model.intercept))
        for name, w in zip(FEATURES, model.coefficients.toArray()):
            margin = margin + F.col(name) * float(w)
        score = 1 / (1 + F.exp(-margin))
    return scored.select(F.col("doc").alias(key), held_out(F.col("doc")).alias("held_out"), score.alias("score"),
                         F.when(score >= 0.5, 1).otherwise(0).alias("predicted"), *FEATURES)
