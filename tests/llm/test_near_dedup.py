import random

import pytest

from cohortveil.llm import near_dedup

from . import brute


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    bases = [[word() for _ in range(60)] for _ in range(6)]
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(160):
        kind = r.random()
        if kind < 0.5:
            w = list(r.choice(bases))
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = word()
        elif kind < 0.8:
            w = passage + [word() for _ in range(r.randrange(20))]
        else:
            w = [word() for _ in range(r.randrange(9))]
        rows.append((i * 3, " ".join(x.upper() if r.random() < 0.1 else x for x in w)))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE two")]


@pytest.mark.parametrize(("seed", "cell", "members"), [(1, (512, 4096), 400), (2, (2, 3), 3)])
def test_groups_match_brute_force(spark, monkeypatch, seed, cell, members):
    monkeypatch.setattr(near_dedup, "CELL", cell)
    monkeypatch.setattr(near_dedup, "MEMBERS", members)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n int").repartition(3)
    got = [tuple(r) for r in near_dedup.near_groups(df).collect()]
    assert sorted(got) == sorted(brute.near_groups(rows))


def test_null_and_repeated_ids(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(None, text), (5, text), (5, "w x y z v u t s"), (7, "w x y z v u t s"), (9, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_dedup.near_groups(df).collect()), key=repr)
    assert got == sorted([(None, 4, None, True), (5, 4, None, False), (5, 4, None, False), (7, 4, None, False), (9, 0, 9, True)], key=repr)


def test_no_rows(spark):
    assert near_dedup.near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rows_without_an_id_are_told_apart_by_their_texts(spark):
    one, two, three = "a b c d e f g h", "m n o p q r s t", "w x y z v u t s"
    df = spark.createDataFrame([(None, one), (None, one), (None, two), (None, three), (4, two), (6, three), (None, None), (None, "")], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_dedup.near_groups(df).collect()), key=repr)
    want = [(None, 4, None, True), (None, 4, None, True), (None, 4, None, True), (None, 4, None, True), (4, 4, None, False), (6, 4, None, False), (None, 0, None, True), (None, 0, None, True)]
    assert got == sorted(want, key=repr)


def test_ids_may_be_any_longs(spark):
    """Ids as hashes are: spread over all longs, the lowest too."""
    r = random.Random(6)
    rows = [(r.randrange(-(2**63), 2**63), t) for _ in range(60) for t in [" ".join(str(r.randrange(10**6)) for _ in range(9))]]
    rows += [(-(2**63) + k, rows[k][1]) for k in range(5)]
    got = [tuple(x) for x in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(brute.near_groups(rows))
