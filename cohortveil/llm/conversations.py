"""Conversation structure repair: the cheapest edits, by Four-Russians block tables.

A conversation is legal if the initials of its roles match (s?(ua)+)?.  Each
of its rows is one symbol: must go (blank or seen before), or a role's initial
with or without a proper end.  What the rows from some place on cost, for each
state of the pattern's automaton, is a vector of four; less its minimum it is
one of a few.  So its change over every block of BLOCK symbols is a table,
made once: a conversation is read from its end by one look-up a block, and
traced from its start by expanding each block backward from the vector at its
right end.  Every step takes the ASCII-least letter that keeps the least cost,
which makes the audit the ASCII-least of all cheapest ones.

Rows are sorted by conversation and turn over all partitions, so a conversation
of any size is cut into chunks of at most CHUNK symbols.  A chunk's own table
(the vector at its left for each vector at its right, and where each state
leads) is what chunks of one conversation tell each other, in two passes over
a row a chunk; texts are only brought together, a chunk at a time and in
order, for the digest of a conversation that was cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import map_batches, stored

BLOCK, CHUNK, CHUNK_BYTES = 4, 4096, 1 << 22
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States of the automaton: nothing yet, after s, after u, after a.  Only the first and the last are ends.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "": {}}
#: The user or assistant turn that may come in each state, and where it leads.
FILL = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: Symbols: 0 must go; then for each initial (no other one has edges) with a proper end, without one.
GONE, SYMBOLS = 0, 1 + 2 * len(NEXT)
INITIALS = list(NEXT)
END = (0, 2 * INSERT, INSERT, 0)
LEGAL_PAIRS = frozenset({"su", "ua", "au"})
SPACE = " \t\n\x0b\x0c\r"


def symbol(role: str, truncated: bool) -> int:
    initial = role[:1]
    return 1 + 2 * INITIALS.index(initial if initial in NEXT else "") + truncated


def steps(vector: tuple[int, ...], code: int) -> tuple[tuple[int, ...], list[tuple[str, int]]]:
    """Costs before a symbol, from those after it, and by state the letters up to that symbol's own and the state they lead to."""
    extra = TRUNCATED if code and (code - 1) % 2 else 0
    edges = NEXT[INITIALS[(code - 1) // 2]] if code else {}
    ways = []
    for state in range(4):
        own = [(DELETE + vector[state], "D", state)]
        if code:
            if state in edges:
                own.append((extra + vector[edges[state]], "K", edges[state]))
            own.append((REROLE + extra + vector[FILL[state][1]], "R", FILL[state][1]))
        ways.append(own)
    least = [min(own)[0] for own in ways]
    for _ in range(3):  # a turn put in leads to a state whose own turn may be put in too
        least = [min(least[s], INSERT + least[FILL[s][1]]) for s in range(4)]
    moves = []
    for state in range(4):
        letters = ""
        while True:
            best = min(((x, t) for cost, x, t in ways[state] if cost == least[state]), default=("Z", 0))
            if best[0] != "D" and least[state] == INSERT + least[FILL[state][1]]:
                letters, state = letters + "I", FILL[state][1]
            else:
                moves.append((letters + best[0], best[1]))
                break
    return tuple(least), moves


class Tables:
    """Vectors less their minimum by number, 0 being the end's, and their changes over one symbol and over each block."""

    def __init__(self) -> None:
        self.vectors, number = [END], {END: 0}
        step, cost, self.moves = [], [], []
        for vector in self.vectors:  # grows while it is read
            row = [steps(vector, c) for c in range(SYMBOLS)]
            for full, _ in row:
                small = tuple(x - min(full) for x in full)
                if small not in number:
                    number[small] = len(self.vectors)
                    self.vectors.append(small)
            step.append([number[tuple(x - min(full) for x in full)] for full, _ in row])
            cost.append([min(full) for full, _ in row])
            self.moves.append([moves for _, moves in row])
        self.step, self.cost = np.array(step), np.array(cost)
        self.exits = np.array([[[state for _, state in moves] for moves in row] for row in self.moves])
        self.block, self.block_exits = np.zeros((len(step), SYMBOLS**BLOCK), np.int64), np.zeros((len(step), SYMBOLS**BLOCK, 4), np.int64)
        for code, symbols in enumerate(product(range(SYMBOLS), repeat=BLOCK)):
            self.block[:, code], self.block_exits[:, code] = self.followed(symbols, np.arange(len(step)), self.step, self.exits)
        self.weights = np.array([SYMBOLS**k for k in reversed(range(BLOCK))])
        self.expanded: dict[tuple[int, bytes, int], tuple[str, int]] = {}

    def codes(self, symbols: np.ndarray) -> tuple[int, list[int]]:
        """How many symbols stand before the first block, and the blocks' codes."""
        odd = len(symbols) % BLOCK
        return odd, (symbols[odd:].reshape(-1, BLOCK) @ self.weights).tolist()

    def backward(self, symbols: np.ndarray, right: int) -> list[int]:
        """The vector at the left of the odd symbols, and at both sides of each block."""
        odd, codes = self.codes(symbols)
        out = [right]
        for code in reversed(codes):
            out.append(int(self.block[out[-1], code]))
        at = out[-1]
        for s in symbols[:odd][::-1]:
            at = int(self.step[at, s])
        return [at, *reversed(out)]

    def expand(self, right: int, symbols: bytes, state: int) -> tuple[str, int]:
        """Letters of a few symbols from a state, given the vector at their right, and the state after them."""
        known = self.expanded.get((right, symbols, state))
        if known is None:
            at, began = [right], state
            for s in reversed(symbols[1:]):
                at.append(int(self.step[at[-1], s]))
            letters = ""
            for s, v in zip(symbols, reversed(at), strict=True):
                more, state = self.moves[v][s][state]
                letters += more
            known = self.expanded[(right, symbols, began)] = letters, state
        return known

    def trace(self, symbols: np.ndarray, right: int, state: int) -> tuple[str, int]:
        odd, raw, out = len(symbols) % BLOCK, symbols.astype(np.uint8).tobytes(), []
        edges = self.backward(symbols, right)
        if odd:
            letters, state = self.expand(edges[1], raw[:odd], state)
            out.append(letters)
        for k in range(len(symbols) // BLOCK):
            letters, state = self.expand(edges[k + 2], raw[odd + k * BLOCK : odd + (k + 1) * BLOCK], state)
            out.append(letters)
        return "".join(out), state

    def followed(self, symbols, at: np.ndarray, step: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the right: each vector's vector at the left, and the state that each state leads to."""
        leads = np.tile(np.arange(4), (len(at), 1))
        for s in reversed(symbols):
            leads = np.take_along_axis(leads, exits[at, s], 1)
            at = step[at, s]
        return at, leads

    def through(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`followed` over a chunk, block by block."""
        odd, codes = self.codes(symbols)
        at, leads = self.followed(codes, np.arange(len(self.vectors)), self.block, self.block_exits)
        first, to = self.followed(symbols[:odd].tolist(), at, self.step, self.exits)
        return first, np.take_along_axis(leads, to, 1)


@lru_cache(1)
def tables() -> Tables:
    return Tables()


# Rows to chunks.

CHUNK_FIELDS = "part int, seq long, whole boolean, turns array<bigint>, roles array<string>, texts array<string>, copies array<bigint>, fresh array<boolean>"


def prepared(df: DataFrame, copies: Column | None = None) -> DataFrame:
    """Equal rows as one with their number, marked `fresh` if their role and text come first there; sorted over all partitions."""
    one = F.lit(1) if copies is None else copies
    role, text = (F.when(one > 0, F.coalesce(F.col(c).cast("string"), F.lit(" "))) for c in ("role", "text"))
    rows = df.select(F.col("conv_id").alias("conv"), F.when(one > 0, F.col("turn").cast("long")).alias("turn"), role.alias("role"), text.alias("text"), one.cast("long").alias("copies"))
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("same")
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = rows.where("copies > 0").select("conv", same, when.alias("when")).groupBy("conv", "same").agg(F.min("when").alias("first")).select(F.col("conv").alias("c"), F.col("same").alias("s"), "first.known", F.col("first.turn").alias("t"))
    counted = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("same", same)
    own = counted.withColumns({"has_turn": F.col("turn").isNotNull(), "turn_or_0": F.coalesce("turn", F.lit(0))})
    met = own.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")) & (F.col("has_turn") == F.col("known")) & (F.col("turn_or_0") == F.col("t")), "left")
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.substring("role", 1, 64), F.substring("text", 1, 64), F.col("same")]
    return met.select("conv", "turn", "role", "text", "copies", "same", F.col("s").isNotNull().alias("fresh")).repartitionByRange(*order).sortWithinPartitions(*order)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as chunks, one record each."""
    part, seq, first = TaskContext.get().partitionId(), 0, True
    held: list[tuple] = []
    size = symbols = 0
    conv, began, kind = None, False, None

    def chunk(whole: bool) -> pa.RecordBatch:
        nonlocal held, size, symbols, seq
        columns = [pa.array([[r[k] for r in held]], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()))]
        head = [pa.array([conv], kind), pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([whole])]
        held, size, symbols, seq = [], 0, 0, seq + 1
        return pa.RecordBatch.from_arrays([*head, *columns], ["conv", "part", "seq", "whole", "turns", "roles", "texts", "copies", "fresh"])

    alone = True  # no chunk of this conversation has gone out
    for batch in batches:
        kind = batch.schema.field("conv").type
        for own, *row in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "copies", "fresh")), strict=True):
            if began and own != conv:
                yield chunk(alone and not first)
                first, alone = False, True
            conv, began = own, True
            turn, role, text, left, fresh = row
            while left:
                if symbols == CHUNK or size and size + len(text) > CHUNK_BYTES:
                    yield chunk(False)
                    alone = False
                n = min(left, CHUNK - symbols)
                held.append((turn, role, text, n, fresh))
                size, symbols, left, fresh = size + len(text), symbols + n, left - n, False
    if began:
        yield chunk(False)


def chunks(df: DataFrame, copies: Column | None = None) -> DataFrame:
    rows = prepared(df, copies)
    return rows.mapInArrow(cut, f"conv {rows.schema['conv'].dataType.simpleString()}, {CHUNK_FIELDS}")


# A chunk's rows.

FAULTS = ("", "blank", "duplicate", "truncated")


class Rows:
    """A chunk's rows, one for each copy."""

    def __init__(self, turns: list, roles: list, texts: list, copies: list, fresh: list) -> None:
        self.turns, self.at, self.symbols, self.faults = turns, [], [], []
        self.roles, self.texts = roles, texts
        for k, (role, text, n, new) in enumerate(zip(roles, texts, copies, fresh, strict=True)):
            end = text.rstrip(SPACE)
            if not end:
                own = [(GONE, 1)] * n
            else:
                cut_short = end[-1] not in ".!?"
                own = ([(symbol(role, cut_short), 3 * cut_short)] if new else []) + [(GONE, 2)] * (n - new)
            self.at += [k] * n
            self.symbols += [x for x, _ in own]
            self.faults += [x for _, x in own]
        self.symbols = np.array(self.symbols, np.int64)

    def counts(self) -> list[int]:
        """Blank, duplicate and truncated rows, and neighbours that may not be."""
        initials = [self.roles[k][:1] for k in self.at]
        return [*(self.faults.count(k) for k in (1, 2, 3)), sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:]))]

    def ends(self) -> tuple[str | None, str | None]:
        return (self.roles[self.at[0]][:1], self.roles[self.at[-1]][:1]) if self.at else (None, None)

    def span(self) -> tuple[int | None, int | None, int]:
        known = [t for t in self.turns if t is not None]
        return (min(known), max(known), len(set(known))) if known else (None, None, 0)

    def applied(self, letters: str, state: int) -> Iterator[tuple[str, int | None, str | None, str | None]]:
        """Letter, row, role and text of each edit; a deleted row has neither role nor text."""
        rows = iter(zip(self.at, self.symbols.tolist(), strict=True))
        for x in letters:
            if x == "I":
                role, state = FILL[state]
                yield x, None, role, ""
                continue
            k, s = next(rows)
            if x == "D":
                yield x, k, None, None
            elif x == "R":
                role, state = FILL[state]
                yield x, k, role, self.texts[k]
            else:
                state = NEXT[INITIALS[(s - 1) // 2]][state]
                yield x, k, self.roles[k], self.texts[k]

    def cost(self, letters: str) -> int:
        total, k = 0, 0
        for x in letters:
            if x == "I":
                total += INSERT
                continue
            total += {"D": DELETE, "R": REROLE, "K": 0}[x] + (TRUNCATED if x != "D" and self.faults[k] == 3 else 0)
            k += 1
        return total


def rows_of(batch: pa.RecordBatch) -> Iterator[Rows]:
    for values in zip(*(batch.column(c).to_pylist() for c in ("turns", "roles", "texts", "copies", "fresh")), strict=True):
        yield Rows(*values)


# Chunks of one conversation tell each other what they need.


def heads(cuts: DataFrame) -> DataFrame:
    """What a chunk does to any vector and state, its outer initials and turns: a small record."""

    def work():
        known = tables()

        def step(batch):
            out = []
            for r in rows_of(batch):
                left, exits = known.through(r.symbols)
                (a, z), (low, high, _) = r.ends(), r.span()
                out.append((left.astype(np.int16).tobytes(), exits.astype(np.int8).tobytes(), a, z, low, high))
            types = (pa.binary(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "part", "seq")), *columns], ["conv", "part", "seq", "lefts", "exits", "a", "z", "low", "high"])

        return step

    kind = cuts.schema["conv"].dataType.simpleString()
    return map_batches(cuts, work, f"conv {kind}, part int, seq long, lefts binary, exits binary, a string, z string, low long, high long")


def along(df: DataFrame, down: bool, columns: list[str], start, step, schema: str) -> DataFrame:
    """A pass over each conversation's records in order, holding one state: step(state, record) gives the next state and what is added."""
    order = [F.col("conv").asc_nulls_first(), *(F.col(c).desc() if down else F.col(c).asc() for c in ("part", "seq"))]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        conv, state, began = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for own, *values in zip(batch.column("conv").to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
                if not began or own != conv:
                    conv, state, began = own, start, True
                state, added = step(state, *values)
                out.append(added)
            types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            added = [pa.array([o[k] for o in out], types[x.split()[1]]) for k, x in enumerate(schema.split(", "))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    full = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition("conv").sortWithinPartitions(*order).mapInArrow(run, f"{full}, {schema}")


def entries(cuts: DataFrame) -> DataFrame:
    """By chunk: the vector at its right, the state in which it starts, the initial and the turn before it, and if it is the last."""

    def from_right(after, lefts, exits):
        at = after or 0
        return int(np.frombuffer(lefts, np.int16)[at]), (at, bytes(exits[4 * at : 4 * at + 4]), int(after is None))

    def from_left(before, exits, a, z, low, high):
        state, initial, turn = before
        after = (exits[state], initial if z is None else z, turn if high is None else high)
        return after, before

    back = along(heads(cuts), True, ["lefts", "exits"], None, from_right, "right long, leads binary, last int").drop("lefts", "exits")
    return along(back, False, ["leads", "a", "z", "low", "high"], (0, None, None), from_left, "state int, initial string, turn long").select("part", "seq", "right", "state", "initial", F.col("turn").alias("before"), "last")


def placed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole conversations, and chunks of others with what they need to know; the same columns."""
    whole = found.where("whole").withColumns({"right": F.lit(0).cast("long"), "state": F.lit(0), "initial": F.lit(None).cast("string"), "before": F.lit(None).cast("long"), "last": F.lit(1)})
    cuts = found.where("NOT whole")
    return whole, cuts.join(entries(cuts), ["part", "seq"])


def traced(df: DataFrame) -> DataFrame:
    """By chunk: letters, the repaired lines, counts and turns."""

    def work():
        known = tables()

        def step(batch):
            out = []
            for r, right, state, initial, before, last in zip(rows_of(batch), *(batch.column(c).to_pylist() for c in PLACE), strict=True):
                letters = edits(known, r, right, state, last)
                lines = "\n".join(f"{role}:{text}" for _, _, role, text in r.applied(letters, state) if role is not None)
                (a, _), (low, high, turns) = r.ends(), r.span()
                blank, twice, short, illegal = r.counts()
                illegal += initial is not None and a is not None and initial + a not in LEGAL_PAIRS
                turns -= low is not None and low == before
                out.append((letters, lines, len(letters) - letters.count("D"), blank, twice, short, illegal, r.cost(letters), low, high, turns))
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.string(), *[pa.int64()] * 9))]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "part", "seq")), *columns], ["conv", "part", "seq", *TRACED])

        return step

    kind = df.schema["conv"].dataType.simpleString()
    return map_batches(df, work, f"conv {kind}, part int, seq long, letters string, lines string, " + ", ".join(f"{c} long" for c in TRACED[2:]))


def edits(known: Tables, rows: Rows, right: int, state: int, last: int) -> str:
    """A chunk's letters, with those after a conversation's last row."""
    letters, after = known.trace(rows.symbols, right, state)
    return letters + ("I" * (END[after] // INSERT) if last else "")


#: What a chunk has to know of the others.
PLACE = ("right", "state", "initial", "before", "last")
TRACED = ("letters", "lines", "n_lines", "blank", "duplicate", "truncated", "illegal", "cost", "low", "high", "turns")


def summed(df: DataFrame) -> DataFrame:
    """One record a conversation from its chunks in order; what is held is the audit and the digest's state."""

    def run(batches):
        conv, held, types = None, None, None

        def records(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], DIGEST)

        def record():
            gaps = 0 if held["low"] is None else held["high"] - held["low"] + 1 - held["turns"]
            return (conv, gaps, *held["counts"], "".join(held["letters"]), held["sha"].hexdigest())

        for batch in batches:
            types, done = (batch.schema.field("conv").type, *[pa.int64()] * 6, pa.string(), pa.string()), []
            for own, letters, lines, n_lines, *counts, low, high, turns in zip(batch.column("conv").to_pylist(), *(batch.column(c).to_pylist() for c in TRACED), strict=True):
                if held is None or own != conv:
                    if held is not None:
                        done.append(record())
                    conv, held = own, {"sha": hashlib.sha256(), "n": 0, "letters": [], "counts": [0] * 5, "low": None, "high": None, "turns": 0}
                held["letters"].append(letters)
                if n_lines:
                    held["sha"].update((("\n" if held["n"] else "") + lines).encode())
                held["counts"] = [a + b for a, b in zip(held["counts"], counts, strict=True)]
                held |= {"n": held["n"] + n_lines, "low": low if held["low"] is None else held["low"], "high": held["high"] if high is None else high, "turns": held["turns"] + turns}
            if done:
                yield records(done)
        if held is not None:
            yield records([record()])

    order = [F.col("conv").asc_nulls_first(), "part", "seq"]
    return df.repartition("conv").sortWithinPartitions(*order).mapInArrow(run, digest_schema(df))


DIGEST = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def digest_schema(df: DataFrame) -> str:
    return f"conv {df.schema['conv'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in DIGEST[1:7]) + ", audit string, repaired_sha256 string"


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns; `found` is a stored table of chunks."""
    whole, cuts = placed(found)

    def work():
        def step(batch):
            gaps = [h - lo + 1 - t if lo is not None else 0 for lo, h, t in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "turns")), strict=True)]
            hashes = [hashlib.sha256(x.encode()).hexdigest() for x in batch.column("lines").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(gaps, pa.int64()), *(batch.column(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost", "letters")), pa.array(hashes, pa.string())], DIGEST)

        return step

    alone = traced(whole)
    return map_batches(alone, work, digest_schema(alone)).unionByName(summed(traced(cuts))).withColumnRenamed("conv", "conv_id")


def repair(df: DataFrame, copies: Column | None = None) -> DataFrame:
    """What is wrong with each conversation, the cheapest edits that mend it and a digest of the result.

    df has conv_id (any type), turn, role and text; other columns don't
    matter.  Returns conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit and repaired_sha256, one row for each conv_id, a null one
    included.  A null role or text counts as one space (so such a row is
    blank, or of no legal role).  Rows of equal turn are taken by role, then
    text (by their first 64 characters each, then by MD5), null turns first;
    equal rows stand beside each other, so all but the first are duplicates.
    `copies` says how often each row counts; a conversation whose rows all
    count 0 times has zeros, an empty audit and the empty string's digest.
    No rows give no rows.  A conversation's audit is one value, as the
    contract wants it, and its digest is one pass over its text; nothing else
    of a conversation is brought together.
    """
    return digests(stored(chunks(df, copies)))


def repaired_rows(df: DataFrame, copies: Column | None = None) -> DataFrame:
    """The edits themselves: conv_id, part, seq and pos (which order them), edit (K, R, D or I), turn, and the role and text after it (null if deleted)."""
    whole, cuts = placed(stored(chunks(df, copies)))
    kind = whole.schema["conv"].dataType.simpleString()
    names, types = ["conv", "part", "seq", "pos", "edit", "turn", "role", "text"], (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())

    def run(batches):
        known = tables()
        for batch in batches:
            for r, conv, part, seq, right, state, last in zip(rows_of(batch), *(batch.column(c).to_pylist() for c in ("conv", "part", "seq", "right", "state", "last")), strict=True):
                letters = edits(known, r, right, state, last)
                found = [(part, seq, pos, x, None if k is None else r.turns[k], role, text) for pos, (x, k, role, text) in enumerate(r.applied(letters, state))]
                yield pa.RecordBatch.from_arrays([pa.array([conv] * len(found), batch.schema.field("conv").type), *(pa.array([f[k] for f in found], t) for k, t in enumerate(types))], names)

    return whole.unionByName(cuts).mapInArrow(run, f"conv {kind}, part int, seq long, pos long, edit string, turn long, role string, text string").withColumnRenamed("conv", "conv_id")


def damaged(df: DataFrame) -> tuple[DataFrame, Column]:
    """The contract's damage, by crc32 of conv_id:turn modulo 20, and how often each row counts after it."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    own = df.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = own.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return out, F.col("times")
