"""Benchmark decontamination with a suffix automaton of the test items.

The normalised words of all items form one generalised suffix automaton.  Each
document's words are streamed through it; the automaton's state and matching
length say at every word which item windows end there.  A word outside the
items' vocabulary resets the match, so only runs of vocabulary words that are
at least as long as the shortest window need to be streamed at all.

Items are taken in blocks of at most `block_words` words, one automaton a
block, so the size of what every task holds is bounded whatever the number of
items.  Several blocks are taken one after another: each is broadcast, its hits
are written and it is released before the next; the driver holds three at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import as_bytes, document_texts, map_batches, map_texts, stored

WINDOW = 13
BLOCK_WORDS = 250_000

#: Bytes of 0x80 and above belong to characters that are word characters.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of digits, letters and non-ASCII characters."""
    return text.translate(NORMAL).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the windows of each state."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.items = [(k, w) for k, w in items if w]
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        rows = []
        for _, w in self.items:
            row = [self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w]
            rows.append(row)
            last = 0
            for c in row:
                last = self._extend(last, c)
        self.least = min((min(len(w), window) for _, w in self.items), default=0)
        # For a state: (window length, items) of the windows that end wherever it is reached.
        self.own: dict[int, dict[int, set[int]]] = {}
        for k, row in enumerate(rows):
            size = min(window, len(row))
            for end in range(size, len(row) + 1):
                state = self._find(row[end - size : end])
                self.own.setdefault(state, {}).setdefault(size, set()).add(k)
        self.hits: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(c)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is None:
            cur = self._state(length[last] + 1, {}, 0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p == -1:
                return cur
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
                return cur
            link[cur] = self._split(p, c, q)
            return cur
        return self._split(last, c, known)

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _find(self, row: list[int]) -> int:
        state = 0
        for c in row:
            state = self.next[state][c]
        return state

    def windows(self, state: int) -> list[tuple[int, tuple[int, ...]]]:
        """The windows that are suffixes of what `state` has read: its own and its links'."""
        if (found := self.hits.get(state)) is None:
            found, at = [], state
            while at > 0:
                found += [(size, tuple(items)) for size, items in self.own.get(at, {}).items()]
                at = self.link[at]
            self.hits[state] = found
        return found

    def match(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words that windows cover, and the numbers of the items they come from."""
        n, spans, found = len(text_words), [], set()
        if not self.least or n < self.least:
            return spans, found
        ids = np.fromiter(map(self.vocabulary.get, text_words, [-1] * n), np.int64, n)
        gaps = np.flatnonzero(ids < 0)
        starts = np.concatenate(([0], gaps + 1))
        ends = np.append(gaps, n)
        long = np.flatnonzero(ends - starts >= self.least)
        nxt, link, length = self.next, self.link, self.length
        for k in long:
            state = depth = 0
            begin = int(starts[k])
            for i, c in enumerate(ids[begin : ends[k]].tolist(), begin):
                while state and c not in nxt[state]:
                    state = link[state]
                    depth = length[state]
                if c in nxt[state]:
                    state, depth = nxt[state][c], depth + 1
                if depth >= self.least:
                    for size, items in self.windows(state):
                        if size <= depth:
                            found.update(items)
                            if spans and i + 1 - size <= spans[-1][1]:
                                spans[-1] = (min(spans[-1][0], i + 1 - size), i + 1)
                            else:
                                spans.append((i + 1 - size, i + 1))
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps; touching ones are joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items' words in blocks, made one at a time.

    An item longer than a block has a block of its own.
    """
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator()
    block, size = [], 0
    for item, text in rows:
        w = words((text or "").encode("utf-8", "replace"))
        if size and size + len(w) > block_words:
            yield block
            block, size = [], 0
        if w:
            block.append((item if item is not None else "", w))
            size += len(w)
    if block or not size:
        yield block


def cut(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, whose neighbours keep one space between them."""
    bounds = word_offsets(text)
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : bounds[a][0]])
        at = bounds[b - 1][1]
    out.append(text[at:])
    kept = [x.strip() for x in out]
    return b" ".join(x for x in kept if x).decode("utf-8", "replace")


def word_offsets(text: bytes) -> list[tuple[int, int]]:
    a = np.frombuffer(text.translate(NORMAL), np.uint8)
    gap = np.ones(len(a) + 2, bool)
    gap[1:-1] = a == 32
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, block_words: int = BLOCK_WORDS, with_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Mark the words of every document that occur in windows of benchmark items.

    `docs` needs doc_id and text, `benchmark` item_id and text; other columns
    are passed over, so their names can't clash.  Returns doc_id, n_words,
    n_hit, items (item ids sorted as strings), contaminated (n_hit > 0 and
    share * n_hit >= n_words) and, with `with_text`, clean_text: the text with
    its hit words cut out.  Columns named in `carry` come along, last.

    A null text or one without words has no hits.  A null item id counts as
    ''.  Equal ids of different items are named once.  Repeated rows give
    repeated rows.  Items without words are passed over; with no items at all
    nothing is contaminated.  A text of any length is one unit of work, whose
    memory is a small multiple of its own.
    """
    blocks = item_blocks(benchmark, block_words)
    block, following = next(blocks), next(blocks, None)
    schema = "doc_id long, n_words long, n_hit long, items array<string>, contaminated boolean" + ", clean_text string" * with_text
    if following is not None:
        return in_turn(docs, chain([block, following], blocks), window, share, schema, with_text, carry)
    shared = docs.sparkSession.sparkContext.broadcast(block)  # at most block_words words, or one item

    def work():
        automaton = Automaton(shared.value, window)
        return judging(lambda batch, k, w: hits(automaton, w), share, with_text)

    return map_texts(docs, carry, work, schema)


def hits(automaton: Automaton, w) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans and item ids of one block in a document's words."""
    spans, found = automaton.match(w)
    return spans, {automaton.items[k][0] for k in found}


def in_turn(docs: DataFrame, blocks: Iterable[list[tuple[str, list[bytes]]]], window: int, share: int, schema: str, with_text: bool, carry: Sequence[str]) -> DataFrame:
    """decontaminate by several blocks, one after another.

    Documents are written once, with a number for each row; each block's hits
    are written by that number, and the block is released.
    """
    sc = docs.sparkSession.sparkContext
    held = stored(document_texts(docs, carry).withColumn("row", F.monotonically_increasing_id()))
    parts: list[DataFrame] = []
    for block in blocks:
        shared = sc.broadcast(block)
        parts.append(stored(map_batches(held.select("row", "text"), matching(shared, window), "row long, starts array<int>, ends array<int>, names array<string>")))
        shared.destroy()
    every = reduce(DataFrame.unionByName, parts).groupBy("row").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "names")))
    both = held.join(every, "row", "left").withColumn("found", F.struct("starts", "ends", "names"))
    names = [f"carried_{k}" for k in range(len(carry))]

    def known(batch: pa.RecordBatch, k: int, w) -> tuple[list[tuple[int, int]], set[str]]:
        found = batch.column(f"carried_{len(names)}")[k].as_py()
        return list(zip(found["starts"] or [], found["ends"] or [], strict=True)), set(found["names"] or [])

    out = map_texts(both, [*names, "found"], lambda: judging(known, share, with_text), schema)
    return out.drop("found").withColumnsRenamed(dict(zip(names, carry, strict=True)))


def matching(shared, window: int):
    """Work that gives the rows hit by a block's items, with spans and item ids."""

    def work():
        automaton = Automaton(shared.value, window)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], []]
            for row, text in zip(batch.column("row").to_pylist(), as_bytes(batch.column("text")), strict=True):
                spans, names = hits(automaton, words(text))
                if spans:
                    for column, value in zip(out, (row, [a for a, _ in spans], [b for _, b in spans], sorted(names)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["row", "starts", "ends", "names"])

        return step

    return work


def judging(find, share: int, with_text: bool):
    """The step that turns each text's hits, from find(batch, k, words), into the contract's columns."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        texts = as_bytes(batch.column("text"))
        for k, text in enumerate(texts):
            w = words(text)
            spans, names = find(batch, k, w)
            spans = merged(spans)
            hit = sum(b - a for a, b in spans)
            for column, value in zip(out, (len(w), hit, sorted(names), hit > 0 and share * hit >= len(w), cut(text, spans) if with_text and spans else None), strict=True):
                column.append(value)
        columns = [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.string())), pa.array(out[3], pa.bool_())]
        names = ["doc_id", "n_words", "n_hit", "items", "contaminated"]
        if with_text:
            columns.append(pa.array([c if c is not None else t.decode("utf-8", "replace") for c, t in zip(out[4], texts, strict=True)], pa.string()))
            names.append("clean_text")
        return pa.RecordBatch.from_arrays(columns, names)

    return step


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of `decontaminate`."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )
