import hashlib
import random
import re
import zlib

import pytest

from tablescope.llm import auction
from tablescope.llm.auction import repaired

SPACE = " \t\n\x0b\f\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def brute(rows):
    """All of one conversation's row but its id: plain dynamic programming from the front over (cost, audit, texts)."""
    rows, seen, faults = damage(rows), set(), []
    for _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        faults.append("b" if not last else "d" if (role, text) in seen else "t" if last not in ".!?" else "")
        seen.add((role, text))

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, said) in list(best.items()):
                r = NEXT[state]
                new = (cost + 3, audit + "I", said + [f"{ROLE[r]}:"])
                if r not in best or new[:2] < best[r][:2]:
                    best[r] = new
        return best

    best = inserted({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, said) in best.items():
            options = [(4, "D", state, [])]
            if fault not in ("b", "d"):
                more, fit, first = 3 * (fault == "t"), NEXT[state], role[:1]
                options.append((3 + more, "R", fit, [f"{ROLE[fit]}:{text}"]))
                if first == fit or (first == "s" and state == ""):
                    options.append((more, "K", first, [f"{role}:{text}"]))
            for c, e, s, t in options:
                new = (cost + c, audit + e, said + t)
                if s not in after or new[:2] < after[s][:2]:
                    after[s] = new
        best = inserted(after)
    cost, audit, said = min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    firsts = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def talks(seed, n):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        length = rng.choice([1, 2, 3, 8, 8, 20, 90])
        for turn in range(length):
            role = rng.choice(["user", "assistant"] * 3 + ["system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "maybe", " ", "", None, f"What {rng.randrange(9)}? \n", "ünï"])
            if rng.random() < 0.9:
                rows.append((conv, turn if rng.random() < 0.95 else None, role, f"{turn} {text}" if text and rng.random() < 0.6 else text))
    # one row per (conversation, turn): the order of several is the operator's own
    return list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def check(spark, rows, **names):
    got = {r[0]: tuple(r)[1:] for r in repaired(spark.createDataFrame(rows, SCHEMA), **names).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    for conv, its in by.items():
        assert got[conv] == brute(its), (conv, its)


@pytest.mark.parametrize("block", [64, 3])
def test_against_dynamic_programming(spark, monkeypatch, block):
    monkeypatch.setattr(auction, "BLOCK", block)
    rows = talks(block, 150)
    random.Random(2).shuffle(rows)
    check(spark, rows)


def test_one_conversation_of_most_rows(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), f"{t} {rng.choice(['a.', 'b', 'c?'])}")
            for t in range(3000)] + talks(9, 20)[:60]
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    check(spark, rows)


def test_nulls_repeats_and_empty(spark):
    extra = spark.createDataFrame([(None, None, None, None, 1, 2)] * 3 + [(5, 2, "user", "Hi.", 3, 4)] * 4,
                                  SCHEMA + ", row int, block int")
    got = {r.conv_id: r for r in repaired(extra).collect()}
    copies = 2 if zlib.crc32(b"5:2") % 20 == 3 else 1
    assert zlib.crc32(b"5:2") % 20 not in (0, 1, 2) and got[5].duplicate == 4 * copies - 1 and got[5].audit.count("K") == 1
    assert got[None].blank == 3 * (2 if zlib.crc32(b" : ") % 20 == 3 else 1) and got[None].audit == "D" * got[None].blank
    assert repaired(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    row = repaired(spark.createDataFrame([(gone, 1, "user", "x")], SCHEMA)).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    text = spark.createDataFrame([("k", "1", "user", "x.", 0)], "c string, t string, r string, x string, part int")
    row = repaired(text, conversation="c", turn="t", role="r", text="x", damage=False).first()
    assert row.c == "k" and row.audit == "KI" and row.cost == 3


def test_auction_prices_are_shortest_distances():
    """Every way through random blocks costs what relaxation to a fixed point says."""
    rng = random.Random(3)
    for _ in range(200):
        codes = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randrange(1, 9)))
        lattice, last = auction.arcs(codes), 4 * len(codes)
        for out in range(4):
            far = [auction.FAR] * (last + 4)
            far[last + out] = 0
            for _ in range(len(far)):
                for i, row in enumerate(lattice):
                    for _, cost, j in row:
                        far[i] = min(far[i], cost + far[j])
            want = [f if f < auction.FAR else auction.FAR for f in far[:4]]
            assert [auction.passage(codes)[4 * s + out] for s in range(4)] == want
