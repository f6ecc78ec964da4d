"""SentencePiece encoding by a score-ordered agenda, and decoding.

A merge-type vocabulary joins, again and again, the adjacent pair of symbols
whose piece has the best score, leftmost first among equals.  No piece of such
a vocabulary has a space mark behind another character, so a text falls apart
into units (space marks and the word behind them) that can't influence each
other; the units of an Arrow batch that are new are encoded together, one step
of all their agendas at a time.  The sentencepiece library encodes the new
units of each batch too, and where it differs its answer stands and is counted.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import as_text, map_texts

SPACE = "▁"
#: Units of more symbols than this have an agenda of their own.
LONG = 48
#: The cache of encoded units is dropped when it holds so many.
CACHE = 400_000
#: Units whose agendas go in step; few enough for their arrays to stay in a core's cache.
STEP = 4000
NONE = np.int32(2**31 - 1)


def slots(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key * np.int64(-7046029254386353131)).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def pair_tables(pairs: dict[int, tuple[int, int]], bits: int = 19) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Direct-address tables (key, rank, merged piece); what collides goes to the next one, with other slots."""
    keys = np.array(sorted(pairs), np.int64)
    tables = []
    while len(keys):
        slot = slots(keys, bits - len(tables))
        _, first = np.unique(slot, return_index=True)
        table = np.full(1 << bits - len(tables), -1, np.int64), np.full(1 << bits - len(tables), NONE, np.int32), np.zeros(1 << bits - len(tables), np.int32)
        here = keys[first]
        table[0][slot[first]] = here
        table[1][slot[first]] = [pairs[k][0] for k in here.tolist()]
        table[2][slot[first]] = [pairs[k][1] for k in here.tolist()]
        tables.append(table)
        left = np.ones(len(keys), bool)
        left[first] = False
        keys = keys[left]
        if len(tables) > 12:
            raise ValueError("the pair tables don't converge")
    return tables


class Vocabulary:
    """Pieces, scores and pair ranks of a merge-type model, read through the library."""

    def __init__(self, processor):
        sp = self.processor = processor
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space mark behind another character: units aren't independent")
        long = [p for p in self.ids if len(p) > 1]
        inside = set("".join(long))
        self.breaks = "" if "\n" in inside else "\n"
        # No piece has a letter before one of these marks, so nothing joins across that place either.
        self.marks = "".join(c for c in ",.!?;:|#$%&*" if not any(a.isalpha() and b == c for p in long for a, b in zip(p, p[1:], strict=False)))
        ahead = f"{SPACE}*[^\\W\\d_]+(?=[{re.escape(self.marks)}])|" if self.marks else ""
        self.unit = re.compile(f"{ahead}{SPACE}*[^{SPACE}{self.breaks}]+|{SPACE}+|\n+")
        scores = sorted({-sp.get_score(self.ids[p]) for p in long})
        order = {s: k for k, s in enumerate(scores)}
        self.rank = {p: order[-sp.get_score(self.ids[p])] for p in long}
        # Symbols are numbered by piece; characters outside the vocabulary get numbers from n on.
        self.first_free = n
        pairs = {}
        for p in long:
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = (self.rank[p], self.ids[p])
        self.size = n
        self.tables = pair_tables(pairs)

    def out(self, symbol: str) -> list[int]:
        """Ids of a final symbol: its piece, or else its bytes."""
        known = self.ids.get(symbol)
        if known is not None:
            return [known]
        return [self.bytes.get(b, self.unknown) for b in symbol.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def agenda(self, unit: str) -> list[int]:
        """One unit, with a heap of (rank, place) of its adjacent pairs."""
        symbols: list[str | None] = list(unit)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, str]] = []

        def offer(a: int, b: int) -> None:
            pair = symbols[a] + symbols[b]
            if (rank := self.rank.get(pair)) is not None:
                heapq.heappush(heap, (rank, a, pair))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, pair = heapq.heappop(heap)
            b = after[a] if symbols[a] is not None else n
            if b >= n or symbols[a] + symbols[b] != pair:
                continue
            symbols[a], symbols[b] = pair, None
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        return list(itertools.chain.from_iterable(self.out(s) for s in symbols if s is not None))

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of pairs of symbols; NONE if there is no such piece."""
        key = a.astype(np.int64) * self.size + b
        key[(a >= self.size) | (b >= self.size)] = -2
        rank, into = np.full(len(key), NONE, np.int32), np.zeros(len(key), np.int32)
        todo = np.arange(len(key))
        for k, (keys, ranks, merged) in enumerate(self.tables):
            slot = slots(key[todo], len(keys).bit_length() - 1)
            there = keys[slot]
            hit = there == key[todo]
            rank[todo[hit]], into[todo[hit]] = ranks[slot[hit]], merged[slot[hit]]
            if k + 1 < len(self.tables):
                todo = todo[~hit & (there >= 0)]
        return rank, into

    def encode_units(self, units: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for k in range(0, len(units), STEP):
            out += self.in_step(units[k : k + STEP])
        return out

    def in_step(self, units: list[str]) -> list[list[int]]:
        """The agendas of many short units in step; each step merges the best pair of every unit."""
        out: list[list[int] | None] = [None] * len(units)
        short = [k for k, u in enumerate(units) if len(u) <= LONG]
        for k, u in enumerate(units):
            if len(u) > LONG:
                out[k] = self.agenda(u)
        if not short or not self.tables:
            for k in short:
                out[k] = self.agenda(units[k])
            return out
        sizes = np.array([len(units[k]) for k in short], np.int64)
        chars = np.frombuffer("".join(units[k] for k in short).encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.flatnonzero(np.bincount(chars)) if chars.max() < 1 << 16 else np.unique(chars)
        inverse = np.searchsorted(seen, chars)
        free, numbers = {}, []
        for c in map(chr, seen.tolist()):
            known = self.ids.get(c)
            if known is None:
                known = self.first_free + len(free)
                free[known] = self.out(c)
            numbers.append(known)
        symbols = np.array(numbers, np.int32)[inverse]
        owner = np.repeat(np.arange(len(short), dtype=np.int32), sizes)
        done_symbols, done_owner = [], []
        rank = np.full(len(symbols), NONE, np.int32)
        into = np.zeros(len(symbols), np.int32)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner], into[inner] = self.lookup(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, starts)
            per = np.repeat(best, np.diff(np.append(starts, len(symbols))))
            over = per == NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_owner.append(owner[over])
                left = ~over
                symbols, owner, rank, into, per = symbols[left], owner[left], rank[left], into[left], per[left]
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == per)
            hits = hits[np.append(True, owner[hits[1:]] != owner[hits[:-1]])]
            symbols[hits] = into[hits]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            place = np.cumsum(keep) - 1
            symbols, owner, rank, into = symbols[keep], owner[keep], rank[keep], into[keep]
            at = place[hits]
            touched = np.concatenate((at, at[at > 0] - 1))
            ok = touched + 1 < len(symbols)
            rank[touched[~ok]] = NONE
            touched = touched[ok]
            same = owner[touched] == owner[touched + 1]
            rank[touched[~same]] = NONE
            touched = touched[same]
            rank[touched], into[touched] = self.lookup(symbols[touched], symbols[touched + 1])
        all_owner = np.concatenate(done_owner)
        order = np.argsort(all_owner, kind="stable")
        flat, bounds = np.concatenate(done_symbols)[order].tolist(), np.cumsum(np.bincount(all_owner, minlength=len(short)))[:-1].tolist()
        start = 0
        for k, end in zip(short, [*bounds, len(flat)], strict=True):
            ids = flat[start:end]
            start = end
            if ids and max(ids) >= self.size:
                ids = list(itertools.chain.from_iterable(free[x] if x >= self.size else (x,) for x in ids))
            out[k] = ids
        return out


def encode_pieces(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """Encode every whole text with a merge-type SentencePiece model, and decode it again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the library's decoding), exact (the decoding is the
    text), n_corrected (units in the text whose agenda the library corrected)
    and, with `with_ids`, ids and decoded.  `model` is the path of the model
    file, the same on every executor.

    A null text counts as empty: no ids, and the digests of ''.  Rows are
    encoded one by one, so repeated rows, null ids and clashing other columns
    change nothing.  No rows give no rows.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean, n_corrected long" + ", ids array<int>, decoded string" * with_ids

    def work():
        import sentencepiece

        vocabulary = Vocabulary(sentencepiece.SentencePieceProcessor(model_file=model))
        find, decode = vocabulary.unit.findall, vocabulary.processor.decode
        cache: dict[str, tuple[str, list[int]]] = {}
        bad: set[str] = set()

        def learn(units: set[str]) -> None:
            fresh = [u for u in units if u not in cache]
            for k in range(0, len(fresh), 50_000):
                part = fresh[k : k + 50_000]
                for unit, ids in zip(part, vocabulary.encode_units(part), strict=True):
                    cache[unit] = (",".join(map(str, ids)), ids)
                check(part)

        def check(part: list[str]) -> None:
            if not vocabulary.breaks:
                return
            lead = len(vocabulary.processor.encode("\n"))
            for unit, ids in zip(part, vocabulary.processor.encode(["\n" + u for u in part], num_threads=1), strict=True):
                if not unit.startswith("\n") and ids[lead:] != cache[unit][1]:
                    cache[unit] = (",".join(map(str, ids[lead:])), ids[lead:])
                    bad.add(unit)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, hashes, decoded, exact, corrected, every, back = [], [], [], [], [], [], []
            texts = as_text(batch.column("text"))
            for k in range(0, len(texts), 256):
                split = [find((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts[k : k + 256]]
                if len(cache) > CACHE:
                    cache.clear()
                learn(set().union(*split))
                for text, units in zip(texts[k : k + 256], split, strict=True):
                    found = [cache[u] for u in units]
                    ids = list(itertools.chain.from_iterable([f[1] for f in found]))
                    plain = decode(ids) if ids else ""
                    counts.append(len(ids))
                    hashes.append(hashlib.sha256(",".join([f[0] for f in found]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(plain.encode("utf-8", "surrogatepass")).hexdigest())
                    exact.append(plain == text)
                    corrected.append(sum(u in bad for u in units) if bad else 0)
                    if with_ids:
                        every.append(ids)
                        back.append(plain)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string()), pa.array(exact, pa.bool_()), pa.array(corrected, pa.int64())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact", "n_corrected"]
            if with_ids:
                columns += [pa.array(every, pa.list_(pa.int32())), pa.array(back, pa.string())]
                names += ["ids", "decoded"]
            return pa.RecordBatch.from_arrays(columns, names)

        return step

    return map_texts(docs, (), work, schema)
