"""Spelling variants: words one edit apart, by neighbourhoods over a reduced alphabet.

Each letter is hashed to one of SYMBOLS symbols.  Words one edit apart have
reduced words at most one edit apart, so every word files the fingerprints of
its reduced word's whole one-edit neighbourhood (itself, each deletion,
replacement and insertion), and these meet the fingerprint of each reduced
word.  What meets is verified on the words themselves.  The fingerprints are
polynomial hashes, so a neighbour costs two look-ups in its word's prefixes and
suffixes; two different strings that share one cost a verification and nothing
else.  Words of more than LONG letters travel as a digest, not as themselves,
until they meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import stored
from .rolling import BASE, U, mix, powers

SYMBOLS = 8
LONG = 64
#: Fingerprints made at a time.
FILED = 1 << 20
LETTERS = "a-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """word: each run of letters of the texts, as the contract damages it, that could still have `least` letters.

    A null id counts as an empty one.
    """
    runs = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = own.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"), F.length("run").alias("n"))
    at = (F.col("h") % F.col("n")).cast("int")
    return h.select(F.when(F.col("h") % 199 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("n")))).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, letters: int = 6, times: int = 5) -> DataFrame:
    """word and n, of words with so many letters that occur so often."""
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def reduced(points: np.ndarray) -> np.ndarray:
    """Symbols 1..SYMBOLS of code points."""
    with np.errstate(over="ignore"):
        return (mix(points.astype(U) * U(BASE)) % U(SYMBOLS)) + U(1)


def fingerprints(points: np.ndarray) -> np.ndarray:
    """Of the reduced words; one row of code points each."""
    return mix(reduced(points) @ powers(BASE, points.shape[1])[::-1])


def neighbourhoods(points: np.ndarray) -> np.ndarray:
    """Fingerprints of all strings at most one edit from each reduced word, a row each."""
    symbols = reduced(points)
    m, n = symbols.shape
    up = powers(BASE, n + 2)
    with np.errstate(over="ignore"):
        terms = symbols * up[n - 1 :: -1][:n]
        suffix = np.zeros((m, n + 1), U)
        suffix[:, :n] = np.cumsum(terms[:, ::-1], axis=1)[:, ::-1]
        head = suffix[:, :1] - suffix  # a prefix, at the place where it stands in the whole word
        inverse = U(pow(BASE, -1, 2**64))
        every = np.arange(1, SYMBOLS + 1, dtype=U)
        gone = head[:, :n] * inverse + suffix[:, 1:]
        other = (head[:, :n] + suffix[:, 1:])[:, :, None] + every * up[n - 1 :: -1][:n, None]
        more = (head * U(BASE) + suffix)[:, :, None] + every * up[n::-1][: n + 1, None]
    return mix(np.concatenate((suffix[:, :1], gone, other.reshape(m, -1), more.reshape(m, -1)), axis=1))


def filed(words: DataFrame, whole: bool) -> DataFrame:
    """fp and the columns of `words`: each neighbourhood, or (whole) only the reduced word's own fingerprint.

    The first column holds the letters; it is given out as `word` only if it is
    short, or else as its digest, the last column.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column("word").to_pylist()
            by: dict[int, list[int]] = {}
            for k, w in enumerate(texts):
                by.setdefault(len(w), []).append(k)
            rest = [c for c in batch.schema.names if c != "word"]
            for n, own in by.items():
                step = max(1, FILED // (1 if whole else n * (2 * SYMBOLS + 1) + SYMBOLS + 1))
                for a in range(0, len(own), step):
                    at = np.array(own[a : a + step])
                    points = np.frombuffer("".join(texts[k] for k in at).encode("utf-32-le"), "<u4").reshape(len(at), n)
                    if whole:
                        rows, fp = at, fingerprints(points)
                    else:
                        all_ = np.sort(neighbourhoods(points), axis=1)
                        new = np.ones(all_.shape, bool)
                        new[:, 1:] = all_[:, 1:] != all_[:, :-1]
                        rows, fp = np.repeat(at, new.sum(1)), all_[new]
                    for z in range(0, len(rows), FILED):
                        taken = pa.array(rows[z : z + FILED])
                        yield pa.RecordBatch.from_arrays([pa.array(fp[z : z + FILED].view(np.int64)), *(batch.column(c).take(taken) for c in rest)], ["fp", *rest])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema if f.name != "word")
    return words.mapInArrow(run, f"fp long, {kinds}")


def one_edit(a: Column, b: Column) -> Column:
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b, 1) == 1)


def near_words(known: DataFrame) -> DataFrame:
    """word, near and near_n for all ordered pairs of words one edit apart; `known` is a stored vocabulary.

    All joins sort and merge: Spark takes neighbourhoods, of some 140 rows a
    word, and texts that the vocabulary's file holds compressed for as small as
    that file, and would broadcast them.
    """
    x = known.select("word", F.col("word").alias("own"), "n")
    y = known.select("word", F.col("word").alias("near"), F.col("n").alias("near_n"))
    short, met = F.length("word") <= LONG + 1, F.col("a.fp") == F.col("b.fp")
    brief = filed(x.where(short), False).hint("merge").alias("a").join(filed(y.where(short), True).alias("b"), met & (F.col("own") != F.col("near")) & one_edit(F.col("own"), F.col("near")))
    # Of two words one edit apart, the longer one has over LONG + 1 letters, or else the pair is above.
    long = F.length("word") > LONG
    digest = F.unhex(F.md5("word"))
    far = filed(known.where(long).select("word", digest.alias("own")), False).hint("merge").alias("a").join(filed(known.where(long).select("word", digest.alias("near")), True).alias("b"), met & (F.col("own") != F.col("near"))).select("own", "near").distinct()
    text = known.where(long).select(digest.alias("digest"), "word", "n").hint("merge")
    full = far.join(text.select(F.col("digest").alias("own"), F.col("word").alias("x")), "own").join(text.select(F.col("digest").alias("near"), F.col("word").alias("y"), F.col("n").alias("near_n")), "near")
    full = full.where((F.greatest(F.length("x"), F.length("y")) > LONG + 1) & one_edit(F.col("x"), F.col("y")))
    return brief.select(F.col("own").alias("word"), "near", "near_n").unionByName(full.select(F.col("x").alias("word"), F.col("y").alias("near"), "near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the end of its chain of forms; by doubling, so in few rounds: counts grow fivefold along a chain."""
    hops = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("far"))
        if hops.join(on, "root", "left_semi").isEmpty():
            return hops
        hops = stored(hops.join(on, "root", "left").select("word", F.coalesce("far", "root").alias("root")))


def variants(known: DataFrame, factor: int = 5) -> DataFrame:
    """Which more frequent word each word may be a variant of.

    known: word and n, words distinct, n at least 1 and never null.  Returns
    word, form, root, n, n_near and form_n: near words differ by one code point
    put in, taken out or replaced; the form is the near word of largest n (ties:
    the smallest in code-point order) if that is at least `factor` times the
    word's own (which must be over 1), else null; the root is where forms lead.
    No words give no rows.
    """
    if factor < 2:
        raise ValueError("chains of forms must rise")
    known = stored(known.select("word", "n"))
    best = near_words(known).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    own = known.join(best, "word", "left")
    good = -F.col("best.less") >= factor * F.col("n")
    found = stored(own.select("word", F.when(good, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, -F.col("best.less")).alias("form_n")))
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """`variants` of the words of all texts: doc_id and text are read, other columns don't matter.

    A null text has no words; a null doc_id counts as an empty one in the
    contract's damage; repeated rows count each.  Texts of any length are taken
    whole, and so are words of any length.
    """
    return variants(vocabulary(occurrences(docs, 6)))
