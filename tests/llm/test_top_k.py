import random

import pytest
from pyspark.sql import functions as F

from cohortveil.llm import top_k as t

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k=5):
    """Query, rank, candidate and score of every query row, by all inner products."""
    own = [(d, [max(min(int(256 * x // 1), t.MOST), t.NONE) for x in v]) for d, v in rows if v is not None and all(x is not None and abs(256 * x) < float("inf") for x in v)]
    out = []
    for d, v in own:
        if d is not None and d % 50 == 0:
            all_ = sorted((-max(min(sum(a * b for a, b in zip(v, w)), t.MOST), t.NONE + 1), e is None, e or 0, e) for e, w in own if e != d)
            out += [(d, n + 1, e, -s) for n, (s, _, _, e) in enumerate(all_[:k])]
    return sorted(out, key=repr)


def got(df, k=5):
    return sorted((tuple(r) for r in t.top_k(df, F.col("vec_id") % 50 == 0, k).collect()), key=repr)


def vectors(seed, n=700, dim=8):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    return [(d, [c + r.gauss(0, 0.3) for c in r.choice(centres)]) for d in range(n)]


@pytest.mark.parametrize(("seed", "block", "shard", "slot"), [(1, 64, 16384, 65536), (2, 7, 50, 3), (3, 1, 9, 1)])
def test_results_are_those_of_all_products(spark, monkeypatch, seed, block, shard, slot):
    for name, value in (("BLOCK", block), ("SHARD", shard), ("SLOT", slot)):
        monkeypatch.setattr(t, name, value)
    rows = vectors(seed, 700 if shard > 9 else 260)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_odd_rows(spark, monkeypatch):
    """Nulls, what isn't finite, other lengths, empty vectors, huge numbers, ties, repeats and clashing names."""
    monkeypatch.setattr(t, "BLOCK", 4)
    rows = vectors(4, 120, 3) + [(0, [1.0, None, 2.0]), (150, None), (200, [float("nan")] * 3), (250, [float("inf"), 0.0, 0.0]), (300, []), (None, [3.0, 3.0, 3.0]), (None, None), (350, [1e12, -1e12, 5.0]), (351, [1e13, 1e12, 5.0]), (352, [1e306, 0.0, 0.0]), (353, [1e30, -1e30, 1.0]), (400, [0.5]), (401, [1.0] * 5000), (450, [1.0] * 5000)]
    rows += [rows[7], rows[50], rows[50], (50, [9.0, 9.0, 9.0]), *[(500 + k, [2.0, 2.0, 2.0]) for k in range(9)]]
    want = plain(rows)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == want
    names = "part, seq, asked, v, dim, up, down, row, n, slot, score, rank, query_id".split(", ")
    assert got(spark.createDataFrame([(*r, *[0] * len(names)) for r in rows], SCHEMA + "".join(f", {x} int" for x in names))) == want


def test_few_rows(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(0, [1.0])], SCHEMA)) == []
    assert got(spark.createDataFrame([(0, [1.0]), (3, [-1.0]), (4, [2.0])], SCHEMA)) == [(0, 1, 4, 131072), (0, 2, 3, -65536)]


def test_blocks_are_left_out_when_bounds_allow(spark, monkeypatch):
    """In well parted data most blocks are never scored, and results stay the same."""
    np, r = t.np, t.np.random.default_rng(5)
    sides = np.eye(32, dtype=np.int64) * 256
    blocks = [t.Block(sides[[k] * 20] + r.integers(0, 20, (20, 32)), np.arange(20) + 100 * k, np.ones(20, bool)) for k in range(32)]
    seen = []
    monkeypatch.setattr(t, "scores", lambda a, b, full=t.scores: seen.append(1) or full(a, b))
    best = t.search(sides[:1], np.array([-1]), blocks, 5, np.full(1, t.NONE))
    every = np.concatenate([b.values for b in blocks]) @ sides[0]
    assert best.scores[0].tolist() == sorted(every.tolist())[::-1][:5] and len(seen) < 5
