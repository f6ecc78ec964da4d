"""Removal of long repeated word passages, by compaction of a De Bruijn graph.

Nodes are runs of window - 1 words, edges are windows; the graph holds the
edges that occur in more than one document.  It is built and compacted as
published for genomes: edges are dealt by their minimizers, edges in a row that
share one are a segment at once, and segments are glued across their ends.

1.  Segments are compared by minimizer (`repeats.compared`); where documents
    begin to differ, single edges are.  Each kind of segment that repeats has
    one source, its least document's coordinates, and occurrences elsewhere.
2.  Each node's in- and out-degree, by an aggregate over the ends of the kinds,
    says whether it branches.  At a node that doesn't, two segments that also
    follow each other in their source become one path.
3.  Occurrences join their kind's path; those in a row on one path, in the
    document and in the source alike, are one span.
4.  A span is removed after its words have been compared with those at its
    source's coordinates, by digests of both.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import repeats
from .batches import as_bytes, map_batches, stored
from .repeats import ENDS, KEY, OPEN, RESOLVED, SOURCE, Spec, Symbols

WINDOW, GRAM = 13, 4
PLACE = ["did", "tag", "first", "count"]
#: Marks a run that is a source and has its ends.
ENDED = 8


def placed(rows: DataFrame, *more: str) -> DataFrame:
    """home and run, a kind's name, where the row lies (did, tag, first and count), and further columns."""
    return rows.select("home", "run", *KEY, F.shiftright("mark", 8).alias("first"), F.col("mark").bitwiseAND(F.lit(0xFF)).alias("count"), *more)


def gathered(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*KEY).agg(*(F.collect_list(c).alias(c) for c in columns))


def segments(texts: DataFrame, sources: DataFrame, spec: Spec) -> DataFrame:
    """Each kind's segment: home, run, its source's place, and start and end, the nodes it leads from and to."""
    columns = ("home", "run", "first", "count")

    def work():
        symbols = Symbols(spec)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list[np.ndarray]] = [[] for _ in range(8)]
            for text, did, tag, *own in zip(as_bytes(batch.column("text")), batch.column("did").to_pylist(), batch.column("tag").to_pylist(), *(batch.column(c) for c in columns), strict=True):
                home, run, first, count = (np.array(x.values, np.int64) for x in own)
                words = symbols.one(text)
                ends = [words.span(at, at + spec.window - 1).view(np.int64) for at in (first, first + count)]
                for column, value in zip(out, (home, run, np.full(len(first), did), np.full(len(first), tag), first, count, *ends), strict=True):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*x, np.zeros(0, np.int64)])) for x in out], ["home", "run", *PLACE, "start", "end"])

        return step

    # All columns of the texts stay in use, here and in other visits, so one exchange of them serves a job.
    held = repeats.with_marks(texts, gathered(sources, *columns), "inner")
    return map_batches(held.select("doc_id", *KEY, "text", *columns), work, ", ".join(f"{c} long" for c in ("home", "run", *PLACE, "start", "end")))


def compacted(found: DataFrame) -> DataFrame:
    """The segments with path, where in the source the nonbranching path that each belongs to begins.

    An edge that a longer segment of the same source holds is no edge of its
    own: it is left out of the degrees and lies on that segment's path.
    """
    place, along = F.struct(*PLACE), Window.partitionBy(*KEY).orderBy("first", F.desc("count"))
    inside = F.max(F.col("first") + F.col("count")).over(along.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("first") + F.col("count")
    every = stored(found.withColumn("inside", F.coalesce(inside, F.lit(False))))
    found = every.where("NOT inside")
    ends = found.select(F.col("start").alias("node"), place.alias("out"), F.lit(None).cast("struct<did:long,tag:long,first:long,count:long>").alias("in"))
    ends = ends.unionByName(found.select(F.col("end").alias("node"), F.lit(None).cast("struct<did:long,tag:long,first:long,count:long>").alias("out"), place.alias("in")))
    nodes = ends.groupBy("node").agg(F.count("in").alias("comes"), F.count("out").alias("leaves"), F.max("in").alias("in"), F.max("out").alias("out"))
    follows = (F.col("in.did") == F.col("out.did")) & (F.col("in.tag") == F.col("out.tag")) & (F.col("in.first") + F.col("in.count") == F.col("out.first"))
    glued = nodes.where((F.col("comes") == 1) & (F.col("leaves") == 1) & follows).select("out.*", F.lit(True).alias("glued"))
    begins = F.when(F.col("glued").isNull() & ~F.col("inside"), F.col("first"))
    return every.join(glued, PLACE, "left").withColumn("path", F.last(begins, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))


def spans(occurrences: DataFrame, paths: DataFrame) -> DataFrame:
    """Occurrences in a row on one path as one: did, tag, first, count, and their source's s_did, s_tag and s_first."""
    source = paths.select("home", "run", F.col("did").alias("s_did"), F.col("tag").alias("s_tag"), F.col("first").alias("s_first"), "path")
    held = occurrences.join(source, ["home", "run"])
    along = Window.partitionBy(*KEY).orderBy("first", "count")
    before = lambda c: F.lag(c).over(along)
    same = (before("s_did") == F.col("s_did")) & (before("s_tag") == F.col("s_tag")) & (before("path") == F.col("path"))
    next_ = (before(F.col("first") + F.col("count")) == F.col("first")) & (before(F.col("s_first") + F.col("count")) == F.col("s_first"))
    islands = held.withColumn("new", F.when(same & next_, 0).otherwise(1)).withColumn("island", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*KEY, "island").agg(F.min("first").alias("first"), F.sum("count").alias("count"), F.first("s_did").alias("s_did"), F.first("s_tag").alias("s_tag"), F.min("s_first").alias("s_first")).drop("island")


def digest(words: list[bytes], first: int, count: int, window: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[first : first + count - 1 + window]), digest_size=16).digest()


def stated(texts: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """Spans with `words`, the digest of the words at their source's coordinates."""
    places = found.select(F.col("s_did").alias("did"), F.col("s_tag").alias("tag"), F.col("s_first").alias("first"), "count").distinct()

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            for text, did, tag, first, count in zip(as_bytes(batch.column("text")), *(batch.column(c).to_pylist() for c in PLACE), strict=True):
                words = text.split()
                for a, n in zip(first, count, strict=True):
                    for column, value in zip(out, (did, tag, a, n, digest(words, a, n, window)), strict=True):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (*[pa.int64()] * 4, pa.binary()), strict=True)], ["s_did", "s_tag", "s_first", "count", "words"])

        return step

    held = repeats.with_marks(texts, gathered(places, "first", "count"), "inner")
    told = map_batches(held.select("doc_id", *KEY, "text", "first", "count"), work, "s_did long, s_tag long, s_first long, count long, words binary")
    return found.join(told.distinct(), ["s_did", "s_tag", "s_first", "count"])


def passage_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Remove each word covered by a window whose words also start in a document with a smaller id.

    Words are the runs of bytes other than 0x20 and 0x09-0x0D, unchanged.
    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined
    by one space) and, with `with_text`, kept_text.

    A null text has no words.  A null doc_id is smaller than all others.  Rows
    that repeat an id are one document, none smaller than the other, so they
    keep what they share with each other, and each loses only what it shares
    with smaller ids itself.  Clashing other columns change nothing; no rows
    give no rows.  A span whose words aren't those of its source, which takes
    two equal 128-bit fingerprints of different words, fails the job.
    """
    if not gram <= window < gram + 255:
        raise ValueError("gram must be at most window, and window - gram below 255")
    spec = Spec("words", window, gram, "smaller")
    own = repeats.told_apart(docs)
    texts = own.repartition(*KEY)
    runs = stored(repeats.compared(repeats.run_rows(own, spec), spec.rule))
    # One job visits the texts for both, so one exchange of them serves it: edges of open runs, and ends of runs that are sources.
    edges = repeats.compared(repeats.window_rows(repeats.open_texts(texts, repeats.having(runs, OPEN)), spec, *ENDS), spec.rule).select("home", "run", *KEY, "mark", *ENDS, "what")
    ends = segments(texts, placed(repeats.having(runs, SOURCE)), spec).select("home", "run", *KEY, F.shiftleft("first", 8).bitwiseOR(F.col("count")).alias("mark"), *ENDS, F.lit(ENDED).cast("byte").alias("what"))
    cut = stored(edges.unionByName(ends))
    paths = compacted(placed(repeats.having(cut, SOURCE | ENDED), *ENDS))
    found = stored(spans(placed(repeats.having(runs, RESOLVED)).unionByName(placed(repeats.having(cut, RESOLVED))), paths))
    marks = gathered(stated(texts, found, window), "first", "count", "words")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], []]
            for text, first, count, told in zip(as_bytes(batch.column("text")), *(batch.column(c) for c in ("first", "count", "words")), strict=True):
                words, removed = text.split(), 0
                kept = words
                if first.is_valid:
                    a, n = (np.array(x.values, np.int64) for x in (first, count))
                    if any(digest(words, x, y, window) != t for x, y, t in zip(a.tolist(), n.tolist(), told.as_py(), strict=True)):
                        raise ValueError("a repeated span's words are not those of its source")
                    gone = repeats.covered(len(words), a, n, window)
                    removed = int(gone.sum())
                    kept = list(itertools.compress(words, ~gone))
                left = b" ".join(kept)
                for column, value in zip(out, (len(words), removed, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if with_text else None), strict=True):
                    column.append(value)
            columns = [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            if with_text:
                columns.append(pa.array(out[3], pa.string()))
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

        return step

    return map_batches(repeats.with_marks(texts, marks, "left").select("doc_id", "text", "first", "count", "words"), work, schema)
