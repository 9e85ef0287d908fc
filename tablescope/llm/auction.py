"""Conversation structure repair by an auction algorithm for shortest paths over a lattice of integer costs.

A conversation is read turn by turn by a machine of four states: nothing yet, after the system's turn, after the user's, after the
assistant's. Nodes of the lattice are (rows read, state); an arc is an edit: keep a row (0), give it the role that fits (3), delete
it (4; the only edit of a blank or repeated row), insert an empty turn (3); an undeleted truncated row adds 3. The cheapest
path from the start to an accepting end is the repair.

The auction keeps a price per node and one path from its origin. With end node i of the path and best arc (i, j), the least of
cost + price of j: if i's price is below that, i is raised to it and the path contracts by one node, else the path is extended
to j. When the path reaches the target, prices differ along every shortest path by exactly the costs, so all arcs of all
shortest paths are tight. Among tight arcs that lead on to the target by tight arcs, the least letter is taken step by step.

A conversation of any length is cut into blocks of at most 64 rows. An auction per block prices its ways between the
states at its two ends; passing over the blocks from the last to the first, four numbers per conversation are carried, the
exact cost from each state to the end; with these as the target, an auction in each block traces its edits from each state
it can be entered in; passing over them in order with the texts, the state, the counts and the digest are carried.
The two passes stream a conversation's blocks in constant memory (a digest of the whole repaired text needs its texts in
order); all auctions, marks and the order itself are spread evenly, also when one conversation holds a third of all rows.

Defined results: null text, role and turn act as one space in the damage key, the text or the role (null turns come
first; a null conversation id is a conversation of its own, returned as null). Rows of one turn are ordered by role, then by a
hash of the text, as they were before the damage; a turn that is no whole number counts as null. Conversations that lose all rows get zeros, the empty audit and the digest of the
empty string; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import column, shared_folder, write

BLOCK = 64                # rows of a block
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3             # added by an undeleted truncated row
NONE, SYSTEM, USER, ASSISTANT = range(4)
FITTING = {NONE: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}    # the role that always fits in a state
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = {"u": "user", "a": "assistant"}
END = (0, 6, 3, 0)        # cost of finishing without further rows, from each state: inserted turns
END_EDITS = ("", "II", "I", "")


def steps(state: int, code: str) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) for a row in a state. ``code``: x must go; else s, u, a or o (other), upper case if truncated."""
    found = [("D", DELETE, state)]
    if code != "x":
        more, low = TRUNCATED if code.isupper() else 0, code.lower()
        fit = FITTING[state]
        if low == fit or (low == "s" and state == NONE):
            found.append(("K", KEEP + more, AFTER[low]))
        found.append(("R", REROLE + more, AFTER[fit]))
    return found


def arcs(codes: str) -> list[list[tuple[str, int, int]]]:
    """Arcs (edit, cost, node) of every node 4 * rows read + state. After the last row nothing is inserted: the next block does."""
    out = []
    for i, code in enumerate(codes):
        for state in range(4):
            found = [(edit, cost, 4 * (i + 1) + after) for edit, cost, after in steps(state, code)]
            found.append(("I", INSERT, 4 * i + AFTER[FITTING[state]]))
            out.append(sorted(found))
    return out + [[] for _ in range(4)]


def floor_prices(codes: str) -> list[int]:
    """First prices: the least that the rows still to come cost in any state. No arc is shorter than the fall of price along it."""
    least = [min(cost for state in range(4) for _, cost, _ in steps(state, code)) for code in codes]
    total, out = 0, [0] * 4
    for cost in reversed(least):
        total += cost
        out += [total] * 4
    return [p for i in range(len(out) - 4, -1, -4) for p in out[i:i + 4]]


def auction(lattice: list[list[tuple[str, int, int]]], price: list[int], origin: int, target: int) -> int:
    """Cost of the cheapest path; ``price`` rises in place and stays below every arc's cost plus the price behind it."""
    path = [origin]
    while path[-1] != target:
        i = path[-1]
        best, j = min((cost + price[j], j) for _, cost, j in lattice[i])
        if price[i] < best:
            price[i] = best              # raise, then contract
            if i != origin:
                path.pop()
        else:
            path.append(j)               # extend
    return price[origin] - price[target]


def reachable(codes: str, entry: int, out: int) -> bool:
    if out == NONE:
        return entry == NONE
    if out == SYSTEM:
        return entry == SYSTEM or (entry == NONE and any(c in "sS" for c in codes))
    return True


FAR = 1 << 60


@lru_cache(1 << 15)
def passage(codes: str) -> tuple[int, ...]:
    """Cost from state s before a block to state t after it at 4 * s + t; FAR if there is no way."""
    lattice, last, found = arcs(codes), 4 * len(codes), [FAR] * 16
    for out in range(4):
        price = floor_prices(codes)
        for other in range(4):  # other ends lead nowhere: a price that no path pays keeps the auction off them
            price[last + other] = 0 if other == out else FAR
        for entry in range(4):
            if reachable(codes, entry, out):
                found[4 * entry + out] = auction(lattice, price, entry, last + out)
    return tuple(found)


@lru_cache(1 << 15)
def edits(codes: str, ends: tuple[int, ...]) -> tuple[tuple[str, int], ...]:
    """For each state before a block, its cheapest edits (the least letters among equals) and the state after it.

    ``ends`` are the costs from the states after the block to the end of the conversation.
    """
    lattice, last = arcs(codes), 4 * len(codes)
    target = last + 4
    for state in range(4):
        lattice[last + state] = [("", ends[state], target)]
    low = min(ends)
    first = [p + low for p in floor_prices(codes)] + [0]
    found = []
    for entry in range(4):
        price = list(first)
        auction(lattice, price, entry, target)
        tight = [[a for a in row if price[i] == a[1] + price[a[2]]] for i, row in enumerate(lattice)]
        leads: dict[int, bool] = {target: True}

        def on(node: int) -> bool:
            stack = [node]
            while stack:
                i = stack[-1]
                if i in leads:
                    stack.pop()
                    continue
                todo = [j for _, _, j in tight[i] if j not in leads]
                if todo:
                    stack.extend(todo)
                else:
                    leads[i] = any(leads[j] for _, _, j in tight[i])
                    stack.pop()
            return leads[node]

        letters, node = [], entry
        while node < last:
            letter, _, node = next(a for a in tight[node] if on(a[2]))
            letters.append(letter)
        found.append(("".join(letters), node - last))
    return tuple(found)


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(talks: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text, copy, first_role, first_text: rows after the damage that the check sum of their key chooses."""
    plain = talks.select(column(conversation).alias("conv"), column(turn).alias("turn"), text_of(column(role)).alias("first_role"),
                         text_of(column(text)).alias("first_text"))
    kind = F.crc32(F.concat(text_of(F.col("conv")), F.lit(":"), text_of(F.col("turn")))) % 20
    hurt = plain.withColumn("kind", kind).where("kind <> 0").withColumn(
        "text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("first_text", "[.!?]", ""))
        .otherwise(F.col("first_text"))).withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("first_role")))
    return hurt.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
                           ).drop("kind")


def ordered_rows(rows: DataFrame, path: str) -> DataFrame:
    """row, conv, turn, role, text, blank, truncated, digest: numbered in order of conversation and turn, written once."""
    # equal rows are spread by the scan's own numbers; which of them comes first doesn't matter
    keyed = rows.withColumn("hash", F.xxhash64("first_text")).withColumn("spread", F.monotonically_increasing_id())
    keys = ["conv", "turn", "first_role", "hash", "spread", "copy"]
    laid = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), -1, 1)
    return write(laid.select(
        F.monotonically_increasing_id().alias("row"), "conv", "turn", "role", "text", (last == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("truncated"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("digest")), path)


def marked(rows: DataFrame) -> DataFrame:
    """row, conv, fault (b, d, t or null), code: the first fault of each row, and its letter for the lattice."""
    first = rows.groupBy("conv", "digest").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    fault = (F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d").when(F.col("truncated"), "t"))
    initial = F.substring("role", 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return (rows.select("row", "conv", "role", "blank", "truncated").join(first.hint("shuffle_hash"), "row", "left")
            .select("row", "conv", fault.alias("fault"), code.alias("code"))
            .withColumn("code", F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper("code"))
                        .otherwise(F.col("code"))))


def per_block(blocks: DataFrame, name: str, kind: str, run) -> DataFrame:
    """conv, block, codes and a new column, from ``run``, which maps batches to values."""
    names = ["conv", "block", "codes"]
    fields = ", ".join(f"{n} {blocks.schema[n].dataType.simpleString()}" for n in names)
    type_ = pa.list_(pa.int64() if kind == "bigint" else pa.string())

    def each(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = run()
        for b in table:
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(step(b), type_)], [*names, name])

    return blocks.mapInArrow(each, f"{fields}, {name} array<{kind}>")


def costed(blocks: DataFrame) -> DataFrame:
    """The blocks with the cost of every way through them."""
    return per_block(blocks, "ways", "bigint", lambda: lambda b: [passage(c) for c in b.column("codes").to_pylist()])


def ended(blocks: DataFrame) -> DataFrame:
    """The blocks with the cost from each state after them to the end of the conversation, carried from last to first."""
    def run():
        held: list = [None, None]

        def step(b: pa.RecordBatch) -> list[tuple[int, ...]]:
            out = []
            for conv, ways in zip(b.column("conv").to_pylist(), b.column("ways").to_pylist()):
                talk, costs = held
                if costs is None or conv != talk:
                    costs = END
                out.append(costs)
                held[:] = conv, tuple(min(ways[4 * s + t] + costs[t] for t in range(4)) for s in range(4))
            return out
        return step

    return per_block(blocks.repartition("conv").sortWithinPartitions("conv", F.desc("block")), "ends", "bigint", run)


def traced(blocks: DataFrame) -> DataFrame:
    """The blocks with, for each state before them, their edits and, as a last letter, the state after them."""
    def step(b: pa.RecordBatch) -> list[list[str]]:
        return [[f"{letters}{state}" for letters, state in edits(codes, tuple(ends))]
                for codes, ends in zip(b.column("codes").to_pylist(), b.column("ends").to_pylist())]

    return per_block(blocks.repartition("conv", "block"), "paths", "string", lambda: step)


class Talk:
    """What is carried through one conversation."""

    def __init__(self, conv):
        self.conv, self.state, self.plan, self.at = conv, NONE, "", 0
        self.audit, self.sha, self.started = [], hashlib.sha256(), False
        self.faults, self.illegal, self.cost, self.before = {"b": 0, "d": 0, "t": 0}, 0, 0, None
        self.low = self.high = None
        self.turns, self.seen = 0, None

    def say(self, role: str, text: str) -> None:
        self.sha.update((f"\n{role}:{text}" if self.started else f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.started = True

    def insert(self) -> None:
        role = FITTING[self.state]
        self.say(ROLES[role], "")
        self.state, self.cost = AFTER[role], self.cost + INSERT

    def block(self, paths: list[str]) -> None:
        path = paths[self.state]
        self.plan, self.at = path[:-1], 0
        self.audit.append(self.plan)

    def row(self, turn, role: str, text: str, fault: str | None) -> None:
        if turn is not None:
            if self.seen is None or turn != self.seen:
                self.turns += 1
            self.low, self.high, self.seen = turn if self.low is None else self.low, turn, turn
        if fault:
            self.faults[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        while self.plan[self.at] == "I":
            self.insert()
            self.at += 1
        edit = self.plan[self.at]
        self.at += 1
        if edit == "D":
            self.cost += DELETE
            return
        if edit == "R":
            self.cost += REROLE
            initial = FITTING[self.state]
            role = ROLES[initial]
        self.cost += TRUNCATED if fault == "t" else 0
        self.say(role, text)
        self.state = AFTER[initial]

    def result(self) -> tuple:
        tail = END_EDITS[self.state]
        for _ in tail:
            self.insert()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, self.cost,
                "".join(self.audit) + tail, self.sha.hexdigest())


def finished(rows: DataFrame, paths: DataFrame, talks: DataFrame, kind: str) -> DataFrame:
    """One row per conversation of ``talks``, from its rows with faults and the traced edits of its blocks, in order."""
    def fill(df: DataFrame, part: int) -> DataFrame:
        have = set(df.columns)
        wanted = [("conv", kind), ("block", "bigint"), ("row", "bigint"), ("turn", "bigint"), ("role", "string"),
                  ("text", "string"), ("fault", "string"), ("paths", "array<string>")]
        return df.select(F.lit(part).alias("part"), *(F.col(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in wanted))

    texts = rows.withColumn("block", F.expr(f"row div {BLOCK}"))
    every = fill(talks, 0).union(fill(paths, 1)).union(fill(texts, 2))
    # a conversation starts with its row of ``talks``, whose block is null; each block's edits come before its rows
    laid = every.repartition("conv").sortWithinPartitions("conv", "block", "part", "row")
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk, done, type_ = None, [], None
        for b in table:
            type_ = b.schema.field("conv").type
            for part, conv, turn, role, text, fault, paths_ in zip(*(b.column(n).to_pylist() for n in (
                    "part", "conv", "turn", "role", "text", "fault", "paths"))):
                if part == 0:
                    if talk is not None:
                        done.append(talk.result())
                    talk = Talk(conv)
                elif part == 1:
                    talk.block(paths_)
                else:
                    talk.row(turn, role, text, fault)
            if len(done) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), [type_, *kinds])], names)
                done = []
        if talk is not None:
            done.append(talk.result())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), [type_, *kinds])], names)

    return laid.mapInArrow(run, f"conv {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
                                "cost bigint, audit string, repaired_sha256 string")


def repaired(talks: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             damage: bool = True) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    With ``damage`` the rows are first damaged as their keys' check sums choose; without it they are repaired as they are.
    """
    root = shared_folder(talks.sparkSession, "auction")
    if damage:
        start = damaged(talks, conversation, turn, role, text)
    else:
        start = talks.select(column(conversation).alias("conv"), column(turn).alias("turn"),
                             text_of(column(role)).alias("first_role"), text_of(column(text)).alias("first_text"),
                             F.lit(0).alias("copy")).withColumn("role", F.col("first_role")).withColumn("text", F.col("first_text"))
    rows = ordered_rows(start.withColumn("turn", F.expr("try_cast(turn AS bigint)")), f"{root}/rows")
    marks = write(marked(rows), f"{root}/marks")
    blocks = marks.groupBy("conv", F.expr(f"row div {BLOCK}").alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "code"))), lambda x: x["code"]), "").alias("codes"))
    paths = traced(ended(costed(blocks)))
    faults = marks.where("fault IS NOT NULL").select("row", "fault")
    texts = rows.select("row", "conv", "turn", "role", "text").join(faults.hint("shuffle_hash"), "row", "left")
    kind = talks.select(column(conversation).alias("conv")).schema["conv"].dataType.simpleString()
    every = talks.select(column(conversation).alias("conv")).distinct()
    return finished(texts, paths, every, kind).withColumnRenamed("conv", conversation)
