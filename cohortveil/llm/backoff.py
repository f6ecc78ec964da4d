"""Stupid-backoff language-model scores from the corpus's own n-gram counts.

Documents are dealt into blocks.  A block's distinct n-grams, with their counts
in it, go to the count tables, which are partitioned by the n-grams' hash; each
partition sums up what all blocks sent and answers every block with the totals
of its n-grams.  Joined back to the block's texts, the totals score each
document.  What is shuffled are sorted hashes, packed as differences, and the
totals alone, so nothing grows faster than the corpus's distinct n-grams.

Orders follow each other: an n-gram can only occur elsewhere if the two shorter
n-grams in it do, so a block asks for those n-grams alone.

A document is scored by all other documents' counts: its own are taken off.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import as_bytes, document_texts, map_batches
from .repeats import whole
from .rolling import Roller, word_bounds, word_values

U = np.uint64
ORDER, ALPHA = 3, 0.4
#: Bytes of text in a block, about.
BLOCK = 12_000_000


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys: the first, then differences of as few bytes as the largest needs."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return keys[:1].tobytes() + bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[8]
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(body) + 1, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8)
    steps[1:, :width] = body
    return np.cumsum(steps.view(U).ravel())


def squeeze(numbers: np.ndarray) -> bytes:
    kind = np.uint32 if not len(numbers) or numbers.max() < 2**32 else np.uint64
    return bytes([kind().itemsize]) + zlib.compress(numbers.astype(kind).tobytes(), 1)


def expand(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), np.uint32 if data[0] == 4 else np.uint64).astype(np.int64)


class Block:
    """One block's words, and what is known of its n-grams so far."""

    def __init__(self, texts: list[bytes]):
        words, hashes, sizes = Roller(), [], []
        for group in whole(np.array([len(t) for t in texts], np.int64)):
            a = np.frombuffer(b"".join(texts[d].lower() + b" " for d, _, _ in group), np.uint8)
            starts, stops = word_bounds(a)
            hashes.append(word_values(a, starts, stops))
            sizes.append(np.diff(np.searchsorted(starts, np.cumsum([0] + [n + 1 for _, _, n in group]))))
        self.sizes = np.concatenate([*sizes, np.zeros(0, np.int64)])
        self.words = words.load(np.concatenate([*hashes, np.zeros(0, U)]))
        n = int(self.sizes.sum())
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.begin = np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.place = np.arange(n)
        self.elsewhere: list[np.ndarray] = []  # by order and word: occurrences in other documents

    def asked(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the n-grams that have to be asked for, and their keys; a place is an n-gram's last word."""
        at = self.place[self.place - self.begin >= order - 1]
        if order > 1:
            below = self.elsewhere[order - 2]
            at = at[(below[at] > 0) & (below[at - 1] > 0)]
        return at, self.words.span(at - order + 1, at + 1)

    def learn(self, order: int, totals: np.ndarray) -> None:
        """Take the totals of an order's distinct keys, in order."""
        at, keys = self.asked(order)
        distinct, which = np.unique(keys, return_inverse=True)
        pair, own = np.unique(self.doc[at] * np.int64(max(len(distinct), 1)) + which, return_inverse=True)
        found = np.zeros(len(self.place), np.int64)
        if len(at):
            found[at] = totals[which] - np.bincount(own, minlength=len(pair))[own]
        self.elsewhere.append(found)

    def scores(self, corpus_words: int, order: int, alpha: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each document's summed log10 scores, and how many words each order scored; the last count is of unseen words."""
        others = np.maximum(corpus_words - self.sizes, 0)[self.doc]
        logs = np.zeros(len(self.place))
        open_ = np.ones(len(self.place), bool)
        backed = np.zeros(len(self.place))
        counts = []
        for n in range(order, 0, -1):
            can = self.place - self.begin >= n - 1
            hit = open_ & (self.elsewhere[n - 1] > 0)
            below = np.flatnonzero(hit)
            base = self.elsewhere[n - 2][below - 1] if n > 1 else others[below]
            logs[below] = np.log10(self.elsewhere[n - 1][below] / np.maximum(base, 1)) + backed[below] * np.log10(alpha)
            open_ &= ~hit
            backed[open_ & can] += 1
            counts.append(np.bincount(self.doc[below], minlength=len(self.sizes)))
        left = np.flatnonzero(open_)
        logs[left] = backed[left] * np.log10(alpha) - np.log10(others[left] + 1.0)
        counts.append(np.bincount(self.doc[left], minlength=len(self.sizes)))
        return np.bincount(self.doc, logs, minlength=len(self.sizes)), counts


def bundles(docs: DataFrame) -> DataFrame:
    """One row a task's batch and block: ids, lengths and, compressed together, the texts."""

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            block = batch.column("block").to_numpy()
            texts, ids = as_bytes(batch.column("text")), batch.column("doc_id").to_pylist()
            order = np.argsort(block, kind="stable")
            heads = np.flatnonzero(np.append(True, np.diff(block[order]) != 0))
            out: list[list] = [[], [], [], []]
            for rows in np.split(order, heads[1:]):
                own = [texts[k] for k in rows]
                for column, value in zip(out, (int(block[rows[0]]), [ids[k] for k in rows], [len(t) for t in own], zlib.compress(b"".join(own), 3)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["block", "ids", "lengths", "data"])

        return step

    return map_batches(docs, work, "block long, ids array<long>, lengths array<long>, data binary")


def unbundled(docs: pa.Table) -> list[bytes]:
    texts = []
    for lengths, data in zip(docs.column("lengths").to_pylist(), docs.column("data").to_pylist(), strict=True):
        whole, at = zlib.decompress(data), 0
        for n in lengths:
            texts.append(whole[at : at + n])
            at += n
    return texts


def block_of(docs: pa.Table, answers: pa.Table | None, orders: int) -> Block:
    """The block with the answers of its first orders taken in."""
    block = Block(unbundled(docs))
    rows = [] if answers is None else sorted(zip(*(answers.column(c).to_pylist() for c in ("order", "part", "totals")), strict=True))
    for order in range(1, orders + 1):
        own = [expand(r[2]) for r in rows if r[0] == order]
        block.learn(order, np.concatenate([*own, np.zeros(0, np.int64)]))
    return block


def lookups(dealt: DataFrame, answers: DataFrame | None, order: int, parts: int) -> DataFrame:
    """What each block asks the count tables of an order: block, order, part, keys and counts."""

    def rows(block_id: int, block: Block) -> pa.Table:
        keys, counts = np.unique(block.asked(order)[1], return_counts=True)
        part = (((keys >> U(32)) * U(parts)) >> U(32)).astype(np.int64)
        cuts = np.searchsorted(part, np.arange(parts + 1))
        out: list[list] = [[], [], [], [], []]
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            piece = slice(cuts[p], cuts[p + 1])
            for column, value in zip(out, (block_id, order, p, pack(keys[piece]), squeeze(counts[piece])), strict=True):
                column.append(value)
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "order", "part", "keys", "counts"])

    schema = "block long, order int, part int, keys binary, counts binary"
    if answers is None:
        return dealt.groupBy("block").applyInArrow(lambda docs: rows(docs.column("block")[0].as_py(), block_of(docs, None, 0)), schema)

    def both(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())], ["block", "order", "part", "keys", "counts"])
        return rows(docs.column("block")[0].as_py(), block_of(docs, found, order - 1))

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(both, schema)


def totals(asked: DataFrame) -> DataFrame:
    """The count tables' answers: for each block, the totals of the keys it asked for, in their order."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        keys = [unpack(r[3]) for r in rows]
        every, which = np.unique(np.concatenate(keys), return_inverse=True)
        summed = np.bincount(which, np.concatenate([expand(r[4]) for r in rows]), minlength=len(every)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        out = [squeeze(summed[which[e - len(k) : e]]) for k, e in zip(keys, ends.tolist(), strict=True)]
        columns = [pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], ["block", "order", "part", "totals"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "order", "part", "keys", "counts")), strict=True):
                if rows and row[2] != rows[-1][2]:
                    yield solve(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield solve(rows)

    return asked.repartition("part").sortWithinPartitions("part").mapInArrow(run, "block long, order int, part int, totals binary")


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """Stupid-backoff score of every whole text by the counts of all other documents.

    Words are the runs of bytes other than 0x20 and 0x09-0x0D, A-Z
    lower-cased.  A word's score is that of its longest n-gram of at most
    `order` words that other documents have too: the n-gram's count over its
    context's, times `alpha` for each order given up.  A single word's count is
    over the other documents' words; a word that they don't have counts as
    alpha / (their words + 1).  Returns doc_id, n_words, mean_log10 (rounded
    to 4 places, null without words) and, as n_by_order, how many words each
    order scored, longest first, unseen words last.

    A null text has no words.  Each row is a document, so rows that repeat
    score each other.  Null ids and clashing other columns change nothing; no
    rows give no rows.  `parts` is the number of count-table partitions, the
    session's number of shuffle partitions if not given; a block has one row
    for each.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = document_texts(docs)
    size = own.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    dealt = bundles(own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // block)))))).repartition("block")
    answers: DataFrame | None = None
    for n in range(1, order + 1):
        new = totals(lookups(dealt, answers, n, parts))
        answers = new if answers is None else answers.unionByName(new)
    # Words of the corpus: every block's unigram counts, summed before any document is scored.
    corpus = own.select(F.coalesce(F.sum(F.when(F.btrim("text", F.lit(" \t\n\x0b\f\r")) == "", 0).otherwise(F.size(F.split(F.btrim("text", F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")))), F.lit(0)).alias("words")).first()["words"]

    def judge(texts: pa.Table, found: pa.Table) -> pa.Table:
        names, kinds = ["doc_id", "n_words", "mean_log10", "n_by_order"], (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
        if not texts.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        own_block = block_of(texts, found, order)
        sums, counts = own_block.scores(corpus, order, alpha)
        means = [round(float(s) / int(n), 4) if n else None for s, n in zip(sums, own_block.sizes, strict=True)]
        by_order = np.stack(counts, axis=1).tolist()
        return pa.table([pa.array([k for ids in texts.column("ids").to_pylist() for k in ids], pa.int64()), pa.array(own_block.sizes), pa.array(means, pa.float64()), pa.array(by_order, pa.list_(pa.int64()))], names)

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, "doc_id long, n_words long, mean_log10 double, n_by_order array<long>")
