"""Quality rules: fixed limits, then robust multivariate outliers.

Every text becomes a few counts.  Texts within the fixed limits are compared
with their own kind: for each language and source, a minimum-covariance-
determinant estimate gives a centre and a scatter that up to a quarter of
rejectable texts can't shift, and texts far from the centre by Mahalanobis
distance are rejected.  Only DataFrame functions are used.

The estimate has several robust starts, as published for deterministic
estimates, and takes concentration steps from each: the three quarters nearest
to the last estimate give the next one, until no determinant falls any more.
The start that ends with the least determinant counts.  The scatter always has
the granted deviations added, a regularised determinant, since clean texts have
statistics that don't scatter at all.  A step is two aggregates with partial
sums, and estimates are joined by group and salt, so a source that holds a
third of all rows is no more than many partial rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import stored

WS = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
#: Window numbers take this many of a packed number's bits; longer texts take another path.
INDEX_BITS = 24
CORE, FEWEST = 0.75, 40
#: Steps end when no determinant falls by more than this share, and after MOST_STEPS in any case.
FALL, MOST_STEPS = 1e-3, 40
#: A group's rows are dealt to this many tasks where they meet its estimate.
SALTS = 32
#: Squared distance that four normal statistics exceed once in 100,000.
LIMIT = 28.5
#: Standard deviation that each statistic is granted in any case, in order of `vector`.
GRANTED = (0.12, 0.25, 0.1, 0.08)
P = len(GRANTED)


def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def neighbours_equal(items: Column, key) -> Column:
    """The items of a sorted array whose key also belongs to the one before or after."""
    same = lambda x, other: F.coalesce(key(x) == key(other), F.lit(False))
    return F.filter(items, lambda x, j: same(x, F.get(items, j - 1)) | same(x, F.get(items, j + 1)))


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows found twice or more."""
    starts = lambda w: F.sequence(F.lit(0), F.size(w) - 3)
    hashed = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    low = (1 << INDEX_BITS) - 1
    packed = lambda w: F.sort_array(F.transform(starts(w), lambda i: hashed(w, i).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    short = lambda w: let(packed(w), lambda s: F.transform(neighbours_equal(s, lambda x: F.shiftright(x, INDEX_BITS)), lambda x: x.bitwiseAND(F.lit(low)).cast("int")))
    pairs = lambda w: F.array_sort(F.transform(starts(w), lambda i: F.struct(hashed(w, i).alias("h"), i.alias("i"))))
    long = lambda w: let(pairs(w), lambda s: F.transform(neighbours_equal(s, lambda x: x["h"]), lambda x: x["i"]))
    maybe = lambda w: F.when(F.size(w) - 2 <= low, short(w)).otherwise(long(w))
    # Windows with equal hashes are few, and compared as they are.
    grams = lambda w: F.array_sort(F.transform(maybe(w), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))))
    at = lambda w: let(grams(w), lambda s: F.array_sort(F.transform(neighbours_equal(s, lambda x: x["g"]), lambda x: x["i"])))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("words"))
    count = lambda w: F.aggregate(at(w), start, lambda a, x: F.struct(x.alias("last"), (a["words"] + F.least(F.lit(3), x - a["last"])).alias("words")), lambda a: a["words"])
    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(count(w))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (with a word)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = isinstance(docs.schema["doc_id"].dataType, (T.StringType, T.BinaryType))
    own = docs.select((F.col("doc_id") if named else F.col("doc_id").cast("long")).alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text.alias("text"))
    trimmed = F.btrim("text", F.lit(WS))
    split = own.select(
        "doc_id", "lang", "source", F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES)).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(WS)) != "").alias("lines"),
    )
    return split.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"),
    )


def vector() -> list[Column]:
    """The transformed statistics: word length, symbols, repeated lines and repeated words."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [F.log(chars / words), F.log1p(100 * F.col("n_symbols") / chars), F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), F.col("n_repeat_words") / words]


def pooled(rows: DataFrame) -> DataFrame:
    """Give each row its group: language and source, or a pool of what has too few rows for an estimate."""
    by_source = rows.groupBy("lang", "source").agg(F.count("*").alias("of_source"))
    small = by_source.where(F.col("of_source") < FEWEST).groupBy("lang").agg(F.sum("of_source").alias("of_rest"))
    groups = by_source.join(small, "lang", "left").select(
        "lang", "source",
        F.when(F.col("of_source") >= FEWEST, F.struct(F.lit(0).alias("pool"), F.col("lang").alias("a"), F.col("source").alias("b")))
        .when(F.col("of_rest") >= FEWEST, F.struct(F.lit(1).alias("pool"), F.col("lang").alias("a"), F.lit("").alias("b")))
        .otherwise(F.struct(F.lit(2).alias("pool"), F.lit("").alias("a"), F.lit("").alias("b"))).alias("group"),
    )
    # Groups are few and go to every salt, so that a source with a third of all rows is dealt out like others.
    dealt = rows.withColumn("deal", (F.monotonically_increasing_id() % SALTS).cast("int"))
    return dealt.join(groups.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lang", "source", "deal"]).drop("deal")


def squared_distance() -> Column:
    """Mahalanobis distance of x0.. from m0.. with the Cholesky factor l00.. of the scatter."""
    z: list[Column] = []
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"z{j}")
        z.append((rest / F.col(f"l{i}{i}")).alias(f"z{i}"))
    return z


def measured(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """rows, once for each estimate of their group, with d2, their squared distance in it.

    rows have a salt, by which they and copies of the small estimates are dealt.
    """
    extra = [c for c in ("start", "det") if c in estimate.columns]
    names = [*rows.columns, *extra]
    copies = estimate.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.join(copies, ["group", "salt"])
    for i, z in enumerate(squared_distance()):
        out = out.withColumn(f"z{i}", z)
    return out.select(*names, sum(F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)).alias("d2"))


def salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(*(f"x{i}" for i in range(P)), F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))


def factored(moments: DataFrame) -> DataFrame:
    """group, start, m0.., the Cholesky factor l00.. of the scatter s00.. with the granted deviations added, and det, its determinant."""
    out = moments
    for i in range(P):
        for j in range(i + 1):
            value = F.col(f"s{i}{j}") + (GRANTED[i] ** 2 if i == j else 0.0)
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(1e-6))) if i == j else value / F.col(f"l{j}{j}"))
    det = F.lit(1.0)
    for i in range(P):
        det = det * F.col(f"l{i}{i}") * F.col(f"l{i}{i}")
    return out.select("group", "start", *(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i in range(P) for j in range(i + 1)), det.alias("det"))


def moments(values: list[Column]) -> list[Column]:
    """Aggregates: the means m0.. and covariances s00.. of columns."""
    return [*(F.avg(v).alias(f"m{i}") for i, v in enumerate(values)), *(F.covar_pop(values[i], values[j]).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1))]


def consistency(core: float) -> float:
    """What the scatter of the nearest `core` of normal vectors has to be multiplied by (four statistics)."""
    cdf = lambda x: 1 - math.exp(-x / 2) * (1 + x / 2)
    low, high = 0.0, 100.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < core else (low, mid)
    return core / (1 - math.exp(-low / 2) * (1 + low / 2 + low * low / 8))


def starts(rows: DataFrame) -> DataFrame:
    """Three first estimates of each group: medians and median deviations, mean and covariance, and those of values drawn in.

    Drawn in are values beyond two robust deviations from the median, to there.
    """
    xs = [F.col(f"x{i}") for i in range(P)]
    middle = rows.groupBy("group").agg(*(F.percentile_approx(x, 0.5, 2000).alias(f"c{i}") for i, x in enumerate(xs)))
    copies = lambda table: table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    off = [F.abs(x - F.col(f"c{i}")) for i, x in enumerate(xs)]
    spread = rows.join(copies(middle), ["group", "salt"]).groupBy("group").agg(*(F.first(f"c{i}").alias(f"c{i}") for i in range(P)), *((1.4826 * F.percentile_approx(v, 0.5, 2000)).alias(f"d{i}") for i, v in enumerate(off)))
    spread = stored(spread)
    plain = spread.select("group", F.lit(0).alias("start"), *(F.col(f"c{i}").alias(f"m{i}") for i in range(P)), *((F.col(f"d{i}") ** 2 if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)))
    whole = rows.groupBy("group").agg(*moments(xs)).withColumn("start", F.lit(1))
    reach = [2 * F.sqrt(F.col(f"d{i}") ** 2 + GRANTED[i] ** 2) for i in range(P)]
    inside = [F.greatest(F.col(f"c{i}") - reach[i], F.least(F.col(f"c{i}") + reach[i], x)) for i, x in enumerate(xs)]
    drawn = rows.join(copies(spread), ["group", "salt"]).groupBy("group").agg(*moments(inside)).withColumn("start", F.lit(2))
    return factored(plain.unionByName(whole).unionByName(drawn))


def estimates(rows: DataFrame, core: float = CORE) -> DataFrame:
    """Centre and factored scatter of each group: the least determinant that concentration steps reach from several starts.

    Every step is a job; the driver sees whether any determinant fell.
    """
    key = ["group", "start"]
    scale = consistency(core)
    estimate = best = stored(starts(rows))
    for _ in range(MOST_STEPS):
        near = measured(rows, estimate.drop("det"))
        cut = near.groupBy(*key).agg(F.percentile_approx("d2", core, 2000).alias("cut")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        kept = near.join(cut, [*key, "salt"]).where(F.col("d2") <= F.col("cut"))
        sums = kept.groupBy(*key).agg(*moments([F.col(f"x{i}") for i in range(P)]))
        estimate = stored(factored(sums.select(*key, *(f"m{i}" for i in range(P)), *((scale * F.col(f"s{i}{j}")).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)))))
        before = best
        rest = [c for c in best.columns if c not in key]
        best = stored(best.unionByName(estimate).groupBy(*key).agg(F.min_by(F.struct(*rest), "det").alias("least")).select(*key, "least.*"))
        fell = best.join(before.select(*key, F.col("det").alias("was")), key).where(F.col("det") < (1 - FALL) * F.col("was"))
        if fell.isEmpty():
            break
    rest = [c for c in best.columns if c not in (*key, "det")]
    return best.groupBy("group").agg(F.min_by(F.struct(*rest), F.struct("det", "start")).alias("least")).select("group", "least.*")


def judge(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Which documents the quality rules keep.

    `docs` needs doc_id (a number, text or bytes), text, lang and source; other
    columns are passed over.
    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed (fewer than 50 words, or more than half of them
    in repeated windows), kept and distance (squared; null if base_failed).

    A null text has no words and fails.  Null languages and sources count as
    ''.  Groups of fewer than 40 passing documents are pooled by language, and
    languages with fewer with each other; only where fewer than 40 pass in all
    does an estimate rest on less.  An estimate follows the bulk of its group,
    so a source whose texts are nearly all alike in their junk is kept.
    Repeated rows are judged each; null ids change nothing; no rows give none.
    """
    rows = stored(statistics(docs).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))
    passed = pooled(rows.where("NOT base_failed"))
    named = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    vectors = stored(salted(passed.select(*named, "group", *(x.alias(f"x{i}") for i, x in enumerate(vector())))))
    distances = measured(vectors, estimates(vectors.select("group", "salt", *(f"x{i}" for i in range(P)))))
    failed = rows.where("base_failed").select(*named, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return distances.select(*named, (F.col("d2") <= limit).alias("kept"), F.col("d2").alias("distance")).unionByName(failed)
