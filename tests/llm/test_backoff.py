import math
import random
from collections import Counter

import numpy as np
import pytest

from cohortveil.llm import backoff


def plain(rows, order, alpha=0.4):
    texts = [(d, (t or "").encode().lower().split()) for d, t in rows]
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    all_ = [Counter(g for _, w in texts for g in grams(w, n)) for n in range(1, order + 1)]
    size = sum(len(w) for _, w in texts)
    out = []
    for d, w in texts:
        own = [Counter(grams(w, n)) for n in range(1, order + 1)]
        left = lambda g: all_[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: E731, B023
        total, used = 0.0, [0] * (order + 1)
        for i in range(len(w)):
            factor = 1.0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if left(g) > 0:
                    total += math.log10(factor * left(g) / (left(g[:-1]) if n > 1 else size - len(w)))
                    used[order - n] += 1
                    break
                factor *= alpha
            else:
                total += math.log10(factor / (size - len(w) + 1))
                used[order] += 1
        out.append((d, len(w), total / len(w) if w else None, used))
    return out


@pytest.mark.parametrize(("order", "block", "parts"), [(3, 400, 5), (2, 10**6, 1), (1, 300, 3), (4, 500, 4)])
def test_scores_match_plain(spark, order, block, parts):
    r = random.Random(order)
    rows = [(i, " ".join(r.choice(["the", "The", "a", "of", "cat", "é", f"w{r.randrange(40)}"]) for _ in range(r.randrange(25)))) for i in range(60)]
    rows += [(100, None), (101, " \n"), (None, "the cat of the cat"), (7, "the cat of the cat"), (7, rows[7][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, block int").repartition(3)
    key = lambda x: repr((x[0], x[1], x[3]))
    got = sorted((tuple(x) for x in backoff.score(df, order, block=block, parts=parts).collect()), key=key)
    for a, b in zip(got, sorted(plain(rows, order), key=key), strict=True):
        assert a[:2] == b[:2] and a[3] == b[3] and (a[2] is b[2] or abs(a[2] - b[2]) < 1e-4)


def test_no_rows_and_packing(spark):
    assert backoff.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (backoff.unpack(backoff.pack(keys)) == keys).all() and (backoff.unpack(backoff.pack(keys[:1])) == keys[:1]).all()
