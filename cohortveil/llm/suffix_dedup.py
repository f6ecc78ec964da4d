"""Exact substring removal over bytes, by bucket-pointer refinement.

Suffixes are sampled: of each run of windows only the minimizer's suffix enters
a q-gram bucket (its first 64 bytes).  Buckets are refined by the identifiers
of later offsets: first by that of everything a run's windows cover, which
settles copies together, then, where texts begin to differ, by sorting on the
bucket numbers of later offsets until suffixes are told apart at full depth
(`repeats.bucket_pointers`).  Buckets too wide for one task are compared by
shuffled window identifiers instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .batches import as_bytes, map_batches, stored
from .repeats import KEY, OPEN, RESOLVED, Spec

WINDOW, GRAM = 200, 64


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Remove each byte covered by a `window`-byte string that also starts anywhere else.

    Texts count as UTF-8; strings lie within one document and are judged on the
    input.  Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 of the remaining bytes and, with `with_text`, kept (binary).

    A null text counts as empty: 0, 0, 0 and the digest of b''.  Repeated rows
    are documents of their own, so they remove each other.  Null ids and
    clashing other columns change nothing; no rows give no rows.  Long texts
    are worked on in slices; a task's memory follows its longest text.
    """
    if not gram <= window < gram + 255:
        raise ValueError("gram must be at most window, and window - gram below 255")
    spec = Spec("bytes", window, gram, "any")
    own = repeats.told_apart(docs)
    texts = own.repartition(*KEY)
    marks = stored(repeats.compared(repeats.run_rows(own, spec), spec.rule))
    settled = repeats.having(marks, RESOLVED).select(*KEY, "mark")
    open_runs = repeats.having(marks, OPEN)
    narrow = repeats.sorted_buckets(repeats.contexts(repeats.open_texts(texts, open_runs.where("NOT wide")), window), window)
    wide = repeats.compared(repeats.window_rows(repeats.open_texts(texts, open_runs.where("wide")), spec), spec.rule)
    every = settled.union(narrow).union(repeats.having(wide, RESOLVED).select(*KEY, "mark"))
    gathered = every.groupBy(*KEY).agg(F.collect_list("mark").alias("marks"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            for text, marks in zip(as_bytes(batch.column("text")), batch.column("marks"), strict=True):
                kept, removed, spans = text, 0, 0
                if marks.is_valid:
                    gone = repeats.covered(len(text), *repeats.unpack(np.array(marks.values, np.int64)), window)
                    removed = int(gone.sum())
                    if removed:
                        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                for column, value in zip(out, (len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(value)
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())]
            if with_text:
                columns.append(pa.array(out[4], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

        return step

    return map_batches(repeats.with_marks(texts, gathered, "left").select("doc_id", "text", "marks"), work, schema)
