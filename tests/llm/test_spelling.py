import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from cohortveil.llm import spelling as s

SCHEMA = "doc_id long, text string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, factor=5):
    by, out, form = {}, [], {}
    for w in counts:
        by[w] = [x for x in counts if near(w, x)]
        best = min(by[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(by[w]), counts.get(form[w])))
    return sorted(out, key=repr)


def words_of(rows):
    found = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
            h = crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "symbols", "long"), [(1, 8, 64), (2, 2, 64), (3, 3, 9), (4, 1, 7)])
def test_variants_match_brute_force(spark, monkeypatch, seed, symbols, long):
    monkeypatch.setattr(s, "SYMBOLS", symbols)
    monkeypatch.setattr(s, "LONG", long)
    r = random.Random(seed)
    counts = {}
    for _ in range(60):
        word = "".join(r.choice("abcdéÿ") for _ in range(r.randrange(6, 12)))
        n = r.choice([5, 30, 200, 2000])
        for _ in range(r.randrange(8)):
            counts.setdefault(word, n)
            i = r.randrange(len(word))
            word = r.choice([word[:i] + word[i + 1 :], word[:i] + r.choice("abcdé") + word[i:], word[:i] + r.choice("abcdé") + word[i + 1 :]])
            n = max(5, n // r.choice([1, 5, 6]))
    want = plain(counts)
    assert sum(x[1] is not None for x in want) > 20
    assert got(s.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4))) == want


def test_query_from_texts(spark, tmp_path):
    """Whole texts with null, empty and very long ones, null and repeated ids, repeated rows and clashing names."""
    from cohortveil.llm.queries import op12_spelling_variants

    r = random.Random(9)
    say = lambda n: "".join(r.choice(["Example", "EXAMPLES", "exemple", "colour", "color", "Größer", "größere", "éxample", "x1", "colours", "×÷" * 4, "longlonglong" * 8, "longlonglong" * 8 + "s"]) + r.choice([" ", "-", "\n", "1"]) for _ in range(n))
    rows = [(k, say(60)) for k in range(300)] + [(400, say(40_000)), (401, None), (402, ""), (None, say(50)), (None, None)]
    rows += rows[:4] + [(3, say(9))]
    names = "id, run, h, n, word, fp, own, near, form, root".split(", ")
    spark.createDataFrame([(*x, *[0] * len(names)) for x in rows], SCHEMA + "".join(f", {c} int" for c in names)).repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain(words_of(rows))
    assert any(len(x[0]) > s.LONG + 1 and x[4] for x in want)
    assert got(op12_spelling_variants(spark, str(tmp_path))) == want


def test_no_words(spark):
    assert s.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert s.spelling_variants(spark.createDataFrame([(1, "few"), (2, None)], SCHEMA)).collect() == []


def test_neighbourhoods_are_never_broadcast(spark):
    """They are some hundred times the vocabulary, for whose size Spark takes them."""
    known = s.stored(spark.createDataFrame([("letter", 9), ("letters", 50), ("longlonglong" * 8, 5), ("longlonglong" * 8 + "s", 30)], "word string, n long"))
    pairs = s.near_words(known)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert got(pairs) == got(spark.createDataFrame([("letter", "letters", 50), ("letters", "letter", 9), ("longlonglong" * 8, "longlonglong" * 8 + "s", 30), ("longlonglong" * 8 + "s", "longlonglong" * 8, 5)], pairs.schema))


def test_neighbourhoods_are_whole(monkeypatch):
    """The fingerprints of a neighbourhood are those of its strings, built one by one."""
    monkeypatch.setattr(s, "SYMBOLS", 4)
    base = lambda word: s.mix(np.array([sum(x * pow(s.BASE, len(word) - 1 - i, 2**64) for i, x in enumerate(word)) % 2**64], np.uint64))[0]
    for text in ("letter", "aaaaaaa", "éÿabcde"):
        points = np.array([[ord(c) for c in text]], np.uint32)
        w = tuple(int(x) for x in s.reduced(points)[0])
        want = {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + (c,) + w[i + 1 :] for i in range(len(w)) for c in range(1, 5)} | {w[:i] + (c,) + w[i:] for i in range(len(w) + 1) for c in range(1, 5)}
        assert set(s.neighbourhoods(points)[0].tolist()) == {int(base(x)) for x in want}
        assert s.fingerprints(points)[0] == base(w)
