"""What the two exact repeat removers share: repeated windows of all documents.

A window is a fixed number of symbols (bytes or words).  A window "counts" if
it occurs elsewhere: anywhere (rule "any") or in a document with a smaller id
(rule "smaller").  Finding all of them goes from coarse to fine:

1.  Windows of a document are cut into runs that share their minimizer, the
    smallest gram of symbols in them.  Equal windows have equal minimizers, so
    only runs in one bucket (the same gram) need comparing.  One task's equal
    runs are merged before the shuffle: a run that thousands of documents share
    leaves each task once.
2.  In a bucket, equal runs settle each other at once, all their windows
    together.  A bucket that has a single run, or equal runs only, is done.
3.  What is left is where texts begin to differ.  One run of each kind in such
    buckets goes back to its text, and is compared window by window there: by
    op1 in bucket-pointer rounds, within a task or over the cluster.

Only fingerprints are shuffled in steps 1 and 2.  A bucket and a run, or a
bucket and a window, are told apart by 128 bits taken over different extents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import NO_ID, as_bytes, map_batches, stored
from .rolling import BASE, ByteRoller, Roller, eights, minimizer_runs, mix, pieces, word_bounds, word_values

U = np.uint64
#: Symbols that one call of minimizer_runs takes at most.
SLICE = 1 << 22
#: Buckets of more different runs than this aren't refined in one task but spread over the cluster, in the same rounds.
WIDE = 4000

RESOLVED, OPEN, SOURCE = 1, 2, 4  # what a compared row is, as bits
ALONE, SETTLED, TWICE = 0, 1, 2  # a row's state when it leaves its task


@dataclass(frozen=True)
class Spec:
    """Which windows are compared, and when one counts."""

    symbols: str  # "bytes" or "words"
    window: int
    gram: int
    rule: str  # "any" or "smaller"


def pack(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A run as one number: first window, and windows (255 at most)."""
    return (first.astype(np.int64) << 8) | count.astype(np.int64)


def unpack(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First windows and counts of marks."""
    return marks >> 8, marks & 0xFF


def ided(docs: DataFrame) -> DataFrame:
    """doc_id, text and did: the id to compare by, the smallest of all for a null doc_id."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.withColumn("did", F.coalesce("doc_id", F.lit(NO_ID)))


def told_apart(docs: DataFrame) -> DataFrame:
    """`ided` with tag: a hash of the text for rows that share an id, as those without one do, and 0 for the others.

    Rows that share id and tag are the same row twice, and get the same marks.
    """
    own = ided(docs)
    again = stored(own.where("doc_id IS NOT NULL").groupBy("did").agg(F.count("*").alias("times")).where("times > 1").select("did", F.lit(True).alias("again")))
    shared = F.col("doc_id").isNull() | F.coalesce("again", F.lit(False))
    return own.join(again, "did", "left").select("doc_id", "text", "did", F.when(shared, F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("tag"))


class Symbols:
    """The fingerprint arrays of texts, piece by piece."""

    def __init__(self, spec: Spec):
        self.spec = spec
        self.bytes, self.words = ByteRoller(min(8, spec.gram)), Roller()

    def one(self, text: bytes) -> Roller:
        """Prefix sums over the symbols of one text."""
        a = np.frombuffer(text, np.uint8)
        if self.spec.symbols == "bytes":
            return self.bytes.load(a)
        return self.words.load(word_values(a, *word_bounds(a)))

    def runs(self, texts: list[bytes]):
        """For each piece: document numbers, bucket, first window, windows, and run fingerprint of its runs."""
        spec = self.spec
        lengths = np.array([len(t) for t in texts], np.int64)
        by_bytes = spec.symbols == "bytes"
        for group in pieces(lengths, spec.window) if by_bytes else whole(lengths):
            doc = np.array([g[0] for g in group])
            a = np.frombuffer(b"".join(texts[d][s:e] if by_bytes else texts[d] + b" " for d, s, e in group), np.uint8)
            ends = np.cumsum([e - s + (not by_bytes) for _, s, e in group])
            if by_bytes:
                roller, begins = self.bytes.load(a), np.concatenate(([0], ends[:-1])) - np.array([g[1] for g in group])
            else:
                starts, stops = word_bounds(a)
                roller = self.words.load(word_values(a, starts, stops))
                ends = np.searchsorted(starts, ends)
                begins = np.concatenate(([0], ends[:-1]))
            sizes = np.diff(np.concatenate(([0], ends)))
            end_of, of = np.repeat(ends, sizes), np.repeat(np.arange(len(group)), sizes)
            for part in range(0, max(len(end_of) - spec.window + 1, 0), SLICE):
                stop = min(len(end_of), part + SLICE + spec.window - 1)
                view = roller if not part and stop == len(end_of) else Part(roller, part)
                bucket, _, first, last = minimizer_runs(view, np.minimum(end_of[part:stop], stop) - part, spec.gram, spec.window)
                first, last = first + part, last + part
                k = of[first]
                yield doc[k], bucket, first - begins[k], last - first + 1, roller.span(first, last + spec.window)


class Part:
    """A Roller seen from a later place."""

    def __init__(self, roller: Roller, offset: int):
        self.roller, self.offset = roller, offset

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.roller.span(start + self.offset, end + self.offset)


def whole(lengths: np.ndarray, size: int = 1 << 18):
    """Groups of whole documents of about `size` bytes."""
    group, total = [], 0
    for doc, n in enumerate(lengths.tolist()):
        group.append((doc, 0, n))
        total += n
        if total >= size:
            yield group
            group, total = [], 0
    if group:
        yield group


def settle_here(rule: str, bucket: np.ndarray, run: np.ndarray, doc: np.ndarray, tag: np.ndarray, mark: np.ndarray):
    """Merge one task's equal runs: what still has to be compared elsewhere, and what is settled.

    Returns bucket, home, run, doc, tag, mark, state and the order that they
    were brought into; home and run name a kind of run for good.  Under "any", equal runs settle each other and one of
    them goes on for all.  Under "smaller", the smallest document goes on and
    the others are settled.  Settled rows get a random bucket, so they are
    dealt evenly.
    """
    order = np.lexsort((mark, tag, doc, run, bucket))
    bucket, run, doc, tag, mark = bucket[order], run[order], doc[order], tag[order], mark[order]
    new = np.ones(len(bucket), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (run[1:] != run[:-1])
    group = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    state = np.zeros(len(bucket), np.int8)
    over = np.diff(np.append(heads, len(bucket)))[group] > 1 if rule == "any" else doc > doc[heads][group]
    state[over] = SETTLED
    several = np.zeros(len(heads), bool)
    several[group[over]] = True
    state[heads[several]] = TWICE
    over = state == SETTLED
    home = bucket.copy()
    bucket[over] = mix(doc[over].astype(U) * U(31) + mark[over].astype(U) + tag[over].view(U))
    return bucket, home, run, doc, tag, mark, state, order


def rows_of(bucket, home, run, doc, tag, mark, state, order, **more) -> pa.RecordBatch:
    longs = [pa.array(x.view(np.int64)) for x in (bucket, home, run, doc, tag, mark)]
    return pa.RecordBatch.from_arrays([*longs, pa.array(state), *(pa.array(x[order].view(np.int64)) for x in more.values())], ["bucket", "home", "run", "did", "tag", "mark", "state", *more])


def no_rows(*more: str) -> pa.RecordBatch:
    return rows_of(*(np.zeros(0, t) for t in (U, U, U, np.int64, np.int64, np.int64, np.int8, np.int64)), **{c: np.zeros(0, np.int64) for c in more})


ROWS = "bucket long, home long, run long, did long, tag long, mark long, state byte"
#: The nodes of a window: its symbols but the last, and its symbols but the first.
ENDS = ("start", "end")


def run_rows(docs: DataFrame, spec: Spec) -> DataFrame:
    """The runs of all texts, equal ones of a task merged."""

    def work():
        symbols = Symbols(spec)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = as_bytes(batch.column("text"))
            ids, tags = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("did", "tag"))
            found = [x for x in symbols.runs(texts) if len(x[0])]
            if not found:
                return no_rows()
            doc, bucket, first, count, run = (np.concatenate(x) for x in zip(*found, strict=True))
            return rows_of(*settle_here(spec.rule, bucket, run, ids[doc], tags[doc], pack(first, count)))

        return step

    return map_batches(docs.select("did", "tag", "text"), work, ROWS)


def compared(rows: DataFrame, rule: str) -> DataFrame:
    """Compare rows within buckets: home, run, did, tag, mark, what (bits) and wide.

    Rows that count nowhere and that nothing else needs are gone.  OPEN rows,
    one of a kind, have to be compared window by window.  Under "smaller", a
    kind's SOURCE is the least row that others are RESOLVED by.  Rows are dealt
    once, by bucket, and sorted once for all windows.
    """
    rows = rows.repartition("bucket")
    alive = F.col("state") != SETTLED
    in_bucket, same = Window.partitionBy("bucket"), Window.partitionBy("bucket", "run")
    nth = F.row_number().over(same.orderBy("did", "tag", "mark"))
    if rule == "any":
        seen = (
            rows.withColumn("head", alive & (nth == 1))
            .withColumn("times", F.sum(F.when(F.col("state") == TWICE, 2).when(alive, 1)).over(same))
            .withColumn("kinds", F.sum(F.when(F.col("head"), 1)).over(in_bucket))
            .withColumn("done", ~alive | (F.col("times") >= 2))
            .withColumn("open", F.col("head") & (F.col("kinds") > 1))
            .withColumn("source", F.lit(False))
        )
    else:
        seen = (
            rows.withColumn("nth", nth)
            .withColumn("least", F.min(F.when(alive, F.col("did"))).over(same))
            .withColumn("most", F.max(F.when(alive, F.when(F.col("state") == TWICE, 2**63 - 1).otherwise(F.col("did")))).over(same))
            .withColumn("low", F.min("least").over(in_bucket))
            .withColumn("high", F.max("least").over(in_bucket))
            .withColumn("kinds", F.lit(0))
            .withColumn("done", ~alive | (F.col("least") < F.col("did")))
            .withColumn("open", alive & (F.col("least") == F.col("did")) & (F.col("low") < F.col("high")))
            .withColumn("source", alive & (F.col("nth") == 1) & (F.col("most") > F.col("least")))
        )
    bit = lambda c, value: F.when(F.col(c), value).otherwise(0)
    ends = [c for c in ENDS if c in rows.columns]
    what = bit("done", RESOLVED) + bit("open", OPEN) + bit("source", SOURCE)
    return seen.select("home", "run", "did", "tag", "mark", *ends, what.cast("byte").alias("what"), (F.col("kinds") > WIDE).alias("wide")).where("what > 0")


def having(rows: DataFrame, bit: int) -> DataFrame:
    return rows.where(F.col("what").bitwiseAND(F.lit(bit).cast("byte")) != 0)


KEY = ["did", "tag"]


def with_marks(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Documents with the collected marks of their row; a document's marks are no more than its symbols."""
    return docs.join(marks.hint("shuffle_hash"), KEY, how)


def window_rows(texts: DataFrame, spec: Spec, *ends: str) -> DataFrame:
    """Each window of the open runs as a row of its own, with ENDS if wanted; texts have lists `marks` and `buckets`."""

    def work():
        symbols = Symbols(spec)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text, did, tag, marks, buckets in zip(as_bytes(batch.column("text")), batch.column("did").to_pylist(), batch.column("tag").to_pylist(), batch.column("marks"), batch.column("buckets"), strict=True):
                first, count = unpack(np.array(marks.values, np.int64))
                at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                bucket = np.repeat(np.array(buckets.values, np.int64).view(U), count)
                # The bucket's gram and the whole window: two fingerprints of different extent.
                if spec.symbols == "bytes":
                    nodes, run = [], bucket_hashes(np.frombuffer(text, np.uint8), spec.window)[at]
                else:
                    own = symbols.one(text)
                    nodes, run = [own.span(at + k, at + k + spec.window - 1) for k in range(len(ends))], own.span(at, at + spec.window)
                out.append((bucket, run, np.full(len(at), did), np.full(len(at), tag), pack(at, np.ones(len(at), np.int64)), *nodes))
            if not out:
                return no_rows(*ends)
            bucket, run, doc, tag, mark, *nodes = (np.concatenate(x) for x in zip(*out, strict=True))
            # Windows are dealt by bucket and content together, which spreads a wide bucket.
            return rows_of(*settle_here(spec.rule, mix(bucket ^ mix(run)), run, doc, tag, mark), **dict(zip(ends, nodes, strict=True)))

        return step

    return map_batches(texts.select("doc_id", "did", "tag", "text", "marks", "buckets"), work, ROWS + "".join(f", {c} long" for c in ends))


def bucket_pointers(symbols: np.ndarray, ends: np.ndarray, depth: int, q: int = 8) -> np.ndarray:
    """Bucket numbers of all suffixes by their first `depth` bytes; -1 where fewer are left.

    The first buckets are those of the q-grams.  Buckets of twice the length
    come from sorting on a suffix's bucket and the bucket of the suffix so many
    places later; each refinement uses the numbers the last one made.
    """
    n = len(symbols)
    left = ends - np.arange(n)
    padded = np.concatenate((symbols, np.zeros(q, np.uint8))).astype(U)
    key = np.zeros(n, U)
    for k in range(q):
        key = (key << U(8)) | padded[k : k + n]
    numbers, have = np.full(n, -1, np.int64), q
    good = left >= q
    numbers[good] = np.unique(key[good], return_inverse=True)[1]
    while have < depth:
        step = min(have, depth - have)
        good = np.flatnonzero(left >= have + step)
        pair = numbers[good] * np.int64(n + 1) + numbers[good + step]
        numbers = np.full(n, -1, np.int64)
        if len(good):
            numbers[good] = np.unique(pair, return_inverse=True)[1]
        have += step
    return numbers


def bucket_hashes(symbols: np.ndarray, depth: int, q: int = 8) -> np.ndarray:
    """What `bucket_pointers` numbers, for buckets that are spread over the cluster: an identifier of the first `depth` bytes from each place on.

    The rounds are the same: identifiers of q-grams, then of twice the length
    from a place's own and that of the place so many bytes later.  A number
    among all suffixes would need them in one task; so an identifier is a hash
    of the two that it is made of, and equal contents have equal ones anywhere.
    """
    have = min(q, depth)
    ids = mix((eights(symbols) & (~U(0) >> U(64 - 8 * have))) + U(BASE))[: max(len(symbols) - have + 1, 0)]
    with np.errstate(over="ignore"):
        while have < depth:
            step = min(have, depth - have)
            ids = mix(ids[: max(len(ids) - step, 0)] * U(BASE) ^ mix(ids[step:] + U(have)))
            have += step
    return ids


def contexts(texts: DataFrame, window: int) -> DataFrame:
    """The bytes that each open run's windows cover: bucket, did, tag, mark, context."""

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            for text, did, tag, marks, buckets in zip(as_bytes(batch.column("text")), batch.column("did").to_pylist(), batch.column("tag").to_pylist(), batch.column("marks"), batch.column("buckets"), strict=True):
                for mark, bucket in zip(marks.values.to_pylist(), buckets.values.to_pylist(), strict=True):
                    first, count = mark >> 8, mark & 0xFF
                    for column, value in zip(out, (bucket, did, tag, mark, text[first : first + count - 1 + window]), strict=True):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (*[pa.int64()] * 4, pa.binary()), strict=True)], ["bucket", "did", "tag", "mark", "context"])

        return step

    return map_batches(texts.select("doc_id", "did", "tag", "text", "marks", "buckets"), work, "bucket long, did long, tag long, mark long, context binary")


def sorted_buckets(rows: DataFrame, window: int, size: int = 1 << 18) -> DataFrame:
    """did, tag and mark of the windows that occur twice in their bucket.

    Buckets come whole and in order, with at most WIDE contexts each; several
    go through one bucket-pointer refinement until about `size` bytes are there.
    """

    def solve(block: list[tuple]) -> pa.RecordBatch:
        text = np.frombuffer(b"".join(r[4] for r in block), np.uint8)
        sizes = np.array([len(r[4]) for r in block], np.int64)
        ends = np.cumsum(sizes)
        numbers = bucket_pointers(text, np.repeat(ends, sizes), window)
        at = np.flatnonzero(numbers >= 0)
        twice = at[np.bincount(numbers[at], minlength=1)[numbers[at]] > 1]
        row = np.searchsorted(ends, twice, side="right")
        did, tag, mark = (np.array([r[k] for r in block], np.int64)[row] for k in (1, 2, 3))
        first = (mark >> 8) + twice - (ends - sizes)[row]
        return pa.RecordBatch.from_arrays([pa.array(did), pa.array(tag), pa.array(pack(first, np.ones(len(row), np.int64)))], ["did", "tag", "mark"])

    def run(batches):
        block, total, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("bucket", "did", "tag", "mark", "context")), strict=True):
                if total >= size and row[0] != last:
                    yield solve(block)
                    block, total = [], 0
                block.append(row)
                total += len(row[4])
                last = row[0]
        if block:
            yield solve(block)

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "did long, tag long, mark long")


def open_texts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Texts with their open runs; all columns of `docs` stay in use, so its exchange serves every join."""
    gathered = marks.groupBy(*KEY).agg(F.collect_list("mark").alias("marks"), F.collect_list("home").alias("buckets"))
    return with_marks(docs, gathered, "inner")


def covered(text_symbols: int, first: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """Which symbols lie in a window of the runs."""
    edge = np.zeros(text_symbols + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + count - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0
