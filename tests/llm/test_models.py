"""Whole runs of the two learnt operators against plain versions of what they learn and say."""

import math
import random
from zlib import crc32

import numpy as np
import pytest

from cohortveil.llm import language, quality_model

SCHEMA = "doc_id long, text string, lang string"


def plain_languages(rows, dimensions=language.DIMENSIONS, gram=language.GRAM):
    """id, language and cosine of every row, letter by letter and n-gram by n-gram."""
    letters = language.Profiles(dimensions, gram)

    def vector(text):
        symbols = [0]
        for c in (text or "").lower():
            symbols.append(ord(c) if c.isalpha() else 0)
        symbols = [s for k, s in enumerate([*symbols, 0]) if s or not k or symbols[k - 1]]
        total = np.zeros(dimensions)
        for k in range(len(symbols) - gram + 1):
            one = np.ones(dimensions)
            for j in range(gram):
                one = one * np.roll(letters.letter(symbols[k + j]).astype(float), gram - 1 - j)
            total += one
        return total if any(symbols) else np.zeros(dimensions)

    prototypes = {}
    for d, text, lang in rows:
        if lang is not None and text is not None and (d is None or crc32(str(d).encode()) % 5):
            prototypes[lang] = prototypes.get(lang, 0) + vector(text)
    out = []
    for d, text, _ in rows:
        v = vector(text)
        cosines = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in sorted(prototypes.items())} if v.any() else {}
        best = max(cosines, key=lambda k: (cosines[k], -sorted(cosines).index(k)), default="und")
        out.append((d, best, min(max(cosines.get(best, 0.0), 0.0), 1.0)))
    return out


def test_languages_are_those_of_plain_bundles(spark):
    r = random.Random(31)
    pools = {"aa": ["stone", "river", "THE", "and"], "bb": ["être", "où", "la", "ciel"], "cc": ["größe", "und", "der", "weg"]}
    rows = [(k, " ".join(r.choice(pools[x] + ["x1"]) for _ in range(r.randrange(1, 30))), x if r.random() < 0.8 else None) for k in range(60) for x in [r.choice(sorted(pools))]]
    rows += [(None, "the stone and", "aa"), (100, None, "bb"), (101, "12 -", "cc"), (102, "\U0001f600 är", None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    for d, lang, cosine in plain_languages(rows):
        assert got[d][0] == lang and got[d][1] == pytest.approx(cosine, abs=1e-5), d


def test_quality_scores_are_those_of_the_rules(spark):
    """Every score is the logistic sum of the rules that hold, fitted on the rows that may be learnt from and nothing else."""
    r = random.Random(32)
    good = lambda: " ".join(r.choice(["quiet", "morning", "letters", "arrive,", "slowly.", "And"]) for _ in range(r.randrange(40, 90)))
    bad = lambda: " ".join(r.choice(["BUY", "###", "now!!!", "$$$", "12"]) for _ in range(r.randrange(5, 40)))
    kinds = [r.random() < 0.5 for _ in range(160)]
    docs = spark.createDataFrame([(k, good() if x else bad()) for k, x in enumerate(kinds)] + [(500, None), (None, "")], "doc_id long, text string").repartition(3)
    held = lambda k: crc32(str(k).encode()) % 3 == 1
    labels = [(k, int(x)) for k, x in enumerate(kinds) if k % 4] + [(3, None), (999, 1)]
    got = {x["doc_id"]: x for x in quality_model.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    stats = {x["doc_id"]: [float(x[s]) for s in quality_model.STATISTICS] for x in quality_model.statistics(docs).collect()}
    learnt = [(stats[k], y) for k, y in labels if y is not None and k in stats and not held(k)]
    order = sorted(range(len(learnt)), key=lambda i: learnt[i])
    x, y = np.array([learnt[i][0] for i in order]), np.array([float(learnt[i][1]) for i in order])
    intercept, weighted = quality_model.fit(x, y)
    for k, row in stats.items():
        margin = intercept + sum(w * bool(rule.holds(np.array([row]))[0]) for w, rule in weighted)
        assert got[k]["score"] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-3) and got[k]["predicted"] == (got[k]["score"] >= 0.5)
        assert got[k]["held_out"] == (k is not None and held(k))
    # Labels of held-out rows change nothing.
    turned = [(k, q if q is None or not held(k) else 1 - q) for k, q in labels]
    again = {x["doc_id"]: x["score"] for x in quality_model.classify(docs, spark.createDataFrame(turned, "doc_id long, quality int")).collect()}
    assert all(again[k] == pytest.approx(got[k]["score"], abs=1e-9) for k in got)
    assert np.mean([got[k]["predicted"] == kinds[k] for k in range(160) if held(k)]) > 0.95
