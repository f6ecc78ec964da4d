import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortveil.llm import debruijn, repeats, suffix_dedup

from . import brute


def corpus(seed, n=120):
    r = random.Random(seed)
    pool = ["".join(r.choice("abc de\n") for _ in range(60)) for _ in range(6)] + ["é" * 50, "x" * 90, "ab" * 40]
    rows = [(i, "".join(r.choice(pool)[r.randrange(20) :] if r.random() < 0.6 else "".join(r.choice("abcdefgh ") for _ in range(r.randrange(30))) for _ in range(r.randrange(6)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (None, rows[3][1]), (None, rows[5][1]), (3, rows[3][1]), (7, "another text under the same id " * 3)]


@pytest.mark.parametrize(("window", "gram", "wide"), [(20, 8, 4000), (20, 20, 4000), (33, 8, 2)])
def test_bytes_match_brute_force(spark, monkeypatch, window, gram, wide):
    monkeypatch.setattr(repeats, "WIDE", wide)
    rows = corpus(window)
    df = spark.createDataFrame([(d, t, "m") for d, t in rows], "doc_id long, text string, marks string").repartition(5)
    got = [tuple(r) for r in suffix_dedup.suffix_dedup(df, window, gram).collect()]
    assert sorted(got, key=repr) == sorted(brute.suffix_dedup(rows, window), key=repr)


@pytest.mark.parametrize(("window", "gram"), [(5, 2), (13, 4), (3, 3)])
def test_words_match_brute_force(spark, window, gram):
    r = random.Random(window)
    pool = [" ".join(r.choice("the of a to in it") for _ in range(25)) for _ in range(4)] + ["x " * 40, "a b " * 20]
    rows = [(i, "\t".join(r.choice(pool)[r.randrange(9) :] if r.random() < 0.7 else " ".join(r.choice("abcdefgh") for _ in range(r.randrange(9))) for _ in range(r.randrange(5)))) for i in range(100)]
    rows += [(100, None), (101, ""), (None, rows[4][1]), (4, rows[4][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, did int").repartition(3)
    got = [tuple(x) for x in debruijn.passage_dedup(df, window, gram).collect()]
    assert sorted(got, key=repr) == sorted(brute.passage_dedup(rows, window), key=repr)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.suffix_dedup(df).collect() == [] and debruijn.passage_dedup(df).collect() == []


def test_bucket_pointers_sort_by_whole_depth():
    text = np.frombuffer(b"abracadabraabracadabraxyz", np.uint8)
    numbers = repeats.bucket_pointers(text, np.full(len(text), len(text)), 11, q=2)
    same = {}
    for i in range(len(text) - 10):
        same.setdefault(bytes(text[i : i + 11]), set()).add(numbers[i])
    assert all(len(v) == 1 for v in same.values()) and len({v for s in same.values() for v in s}) == len(same)
    assert (numbers[len(text) - 10 :] == -1).all()


def judged(spark, op, rows, *args):
    return sorted((tuple(x) for x in op(spark.createDataFrame(rows, "doc_id long, text string"), *args).collect()), key=repr)


@pytest.mark.parametrize("ids", [(5, 5, 9), (None, None, 9)])
def test_rows_that_share_an_id_keep_their_own_marks(spark, ids):
    """Many texts under one id: each loses what it shares itself, whatever its length."""
    r = random.Random(1)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    shared, other = say(80), say(80)
    rows = [(ids[0], "x" + shared), (ids[1], other), (ids[1], other[:107]), (ids[2], shared)]
    assert judged(spark, suffix_dedup.suffix_dedup, rows) == sorted(brute.suffix_dedup(rows, 200), key=repr)
    rows = [(1, shared), (ids[0] or 3, "x " + shared), (ids[1] or 3, other), (ids[1] or 3, "short one"), (ids[2], shared)]
    assert judged(spark, debruijn.passage_dedup, rows) == sorted(brute.passage_dedup(rows, 13), key=repr)


def test_two_thousand_rows_without_an_id(spark):
    r = random.Random(2)
    say = lambda: " ".join(r.choice(["ab", "cd", "ef", "gh", "ij"]) + str(r.randrange(99)) for _ in range(r.randrange(40)))
    pool = [" ".join(f"p{r.randrange(999)}" for _ in range(50)) for _ in range(5)]
    rows = [(None, say() + (" " + r.choice(pool) if k % 5 == 0 else "")) for k in range(2000)] + [(k, r.choice(pool)[9:]) for k in range(9)]
    assert judged(spark, suffix_dedup.suffix_dedup, rows) == sorted(brute.suffix_dedup(rows, 200), key=repr)
    assert judged(spark, debruijn.passage_dedup, rows) == sorted(brute.passage_dedup(rows, 13), key=repr)


def test_nonbranching_paths_become_one_span(spark):
    """Three documents share 40 words; a fourth leaves in the middle, so the path ends there."""
    words = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(words)), (2, "a " + " ".join(words) + " b"), (3, "c " + " ".join(words))]
    spec = repeats.Spec("words", 5, 2, "smaller")

    def found(rows):
        own = repeats.told_apart(spark.createDataFrame(rows, "doc_id long, text string"))
        runs = repeats.compared(repeats.run_rows(own, spec), spec.rule)
        edges = repeats.compared(repeats.window_rows(repeats.open_texts(own, repeats.having(runs, repeats.OPEN)), spec, *repeats.ENDS), spec.rule)
        whole = debruijn.segments(own, debruijn.placed(repeats.having(runs, repeats.SOURCE)), spec)
        paths = debruijn.compacted(whole.unionByName(debruijn.placed(repeats.having(edges, repeats.SOURCE), *repeats.ENDS)))
        both = runs.select("home", "run", "did", "tag", "mark", "what").unionByName(edges.select("home", "run", "did", "tag", "mark", "what"))
        spans = debruijn.spans(debruijn.placed(repeats.having(both, repeats.RESOLVED)), paths)
        return sorted((x["did"], x["first"], x["count"], x["s_did"], x["s_first"]) for x in spans.collect())

    assert found(rows) == [(2, 1, 36, 1, 0), (3, 1, 36, 1, 0)]
    more = found(rows + [(4, " ".join(words[:20]) + " z")])
    assert all(sum(n for d, _, n, _, _ in more if d == k) == 36 for k in (2, 3)) and (4, 0) == [x[:2] for x in more if x[0] == 4][0]


def test_a_span_unlike_its_source_fails(spark, monkeypatch):
    plain = debruijn.stated
    monkeypatch.setattr(debruijn, "stated", lambda *a: plain(*a).withColumn("words", F.lit(b"other")))
    with pytest.raises(Exception, match="not those of its source"):
        debruijn.passage_dedup(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string"), 5, 2).collect()


def thue_morse(letters="ab", n=2048):
    """A word and its complement, whose plain polynomial fingerprints modulo 2**64 are equal whatever the base."""
    word = "".join(letters[bin(k).count("1") % 2] for k in range(n))
    return word, word.translate(str.maketrans(letters, letters[::-1]))


def test_long_words_that_plain_polynomials_confuse(spark):
    from cohortveil.llm import backoff, near_dedup

    one, other = thue_morse()
    common = [f"w{k}" for k in range(20)]
    rows = [(1, " ".join([*common[:10], one, *common[10:]])), (2, " ".join([*common[:10], other, *common[10:]])), (3, " ".join([one] * 6)), (4, " ".join([other] * 6)), (5, one), (6, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in debruijn.passage_dedup(df).collect()) == sorted(brute.passage_dedup(rows, 13))
    assert sorted(tuple(r) for r in near_dedup.near_groups(df).collect()) == sorted(brute.near_groups(rows))
    alone = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert [r["n_by_order"][-1] for r in backoff.score(alone).collect()] == [1, 1]
    longer = [(k, x * 3) for k, x in enumerate((one, other, thue_morse("xy")[0], one))]
    assert sorted(tuple(r) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(longer, "doc_id long, text string")).collect()) == sorted(brute.suffix_dedup(longer, 200))


def test_pointer_rounds_agree_within_a_task_and_over_the_cluster():
    """Numbers of one task's suffixes and hashed identifiers tell the same places apart."""
    r = random.Random(11)
    for depth in (3, 8, 20, 33, 200):
        text = np.frombuffer("".join(r.choice(["abab", "b", "aab" * 30]) for _ in range(60)).encode(), np.uint8)
        numbers = repeats.bucket_pointers(text, np.full(len(text), len(text)), depth, min(8, depth))
        hashes = repeats.bucket_hashes(text, depth)
        assert len(hashes) == max(len(text) - depth + 1, 0) and (numbers[: len(hashes)] >= 0).all()
        pairs = set(zip(numbers[: len(hashes)].tolist(), hashes.tolist()))
        assert len(pairs) == len(set(numbers[: len(hashes)].tolist())) == len(set(hashes.tolist()))
