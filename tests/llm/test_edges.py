"""Odd rows through every operator that judges texts one by one, and the quality model's parts."""

import random

import numpy as np
import pytest

from cohortveil.llm import backoff, debruijn, decontaminate, language, near_dedup, pieces, quality_model, quality_rules, secrets, spelling, suffix_dedup
from cohortveil.llm.queries import piece_model

PLAIN = "doc_id long, text string, lang string, source string"
#: Names that the operators use inside.
CLASHES = "did, tag, row, n, node, spans, words, found, carried_0, block, group, salt, x0, score, held_out, quality, marks, starts, count, first".split(", ")


def items(spark):
    return spark.createDataFrame([("1", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")], "item_id string, text string")


def labels(spark):
    return spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")


OPERATORS = {
    "suffix": lambda spark, docs: suffix_dedup.suffix_dedup(docs),
    "language": lambda spark, docs: language.identify(docs),
    "quality": lambda spark, docs: quality_model.classify(docs, labels(spark)),
    "pieces": lambda spark, docs: pieces.encode_pieces(docs, piece_model()),
    "secrets": lambda spark, docs: secrets.scan_secrets(docs),
    "rules": lambda spark, docs: quality_rules.judge(docs),
    "benchmark": lambda spark, docs: decontaminate.digest(decontaminate.decontaminate(docs, items(spark))),
    "near": lambda spark, docs: near_dedup.near_groups(docs),
    "passages": lambda spark, docs: debruijn.passage_dedup(docs),
    "scores": lambda spark, docs: backoff.score(docs),
    "spelling": lambda spark, docs: spelling.spelling_variants(docs),
}


def corpus():
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(["one", "two", "three", "Vier", "fünf", "password: x9K!q", "\n", "#"]) for _ in range(n))
    rows = [(k, say(r.randrange(90)), r.choice(["a", "b", None]), r.choice(["s", "t", None])) for k in range(40)]
    long = say(30_000)
    odd = [(50, None, None, None), (51, "", "a", "s"), (52, " \n\t", "b", "t"), (53, long, "a", "s"), (None, "one two", "a", None), (None, None, None, None), (54, "\x00\U0001f600 é" * 9, "b", "s")]
    return rows + odd + [rows[3], rows[3], odd[0], odd[4]]


def results(frame):
    return sorted((repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in frame.collect()))


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows_clashes_and_repeats(spark, name):
    rows = corpus()
    plain = OPERATORS[name](spark, spark.createDataFrame(rows, PLAIN))
    wide = spark.createDataFrame([(*x, *[k] * len(CLASHES)) for k, x in enumerate(rows)], PLAIN + "".join(f", {c} int" for c in CLASHES)).repartition(3)
    got = results(plain)
    assert results(OPERATORS[name](spark, wide)) == got
    if name == "spelling":  # a row a word, not a document
        return
    assert len(got) == len(rows)
    by_id = [x for x in plain.collect() if x["doc_id"] == 3]
    assert len(by_id) == 3 and len({repr(tuple(x)) for x in by_id}) == 1


@pytest.mark.parametrize("name", list(OPERATORS))
def test_no_rows(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], PLAIN)).collect() == []


def test_lasso_is_at_its_optimum():
    """Where a weight is zero the slope is within the penalty; elsewhere it balances it."""
    r = np.random.default_rng(3)
    z = (r.random((400, 12)) < 0.4).astype(float)
    y = (r.random(400) < 1 / (1 + np.exp(-(2 * z[:, 0] - 2 * z[:, 1])))).astype(float)
    b, w = quality_model.lasso(z, y, 0.02, 4000)
    slope = z.T @ (1 / (1 + np.exp(-(z @ w + b))) - y) / len(y)
    assert np.abs(slope[w == 0]).max() <= 0.02 + 1e-4 and np.allclose(slope[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-4)
    assert w[0] > 0 > w[1] and (w == 0).sum() >= 4


def test_compiled_rules_are_the_rules(spark):
    r = np.random.default_rng(4)
    x = r.random((300, len(quality_model.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.6)).astype(float)
    intercept, weighted = quality_model.fit(x, y)
    assert 0 < len(weighted) < len(quality_model.propose(x, y))
    margin = intercept + sum(w * rule.holds(x) for w, rule in weighted)
    rows = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "k int, " + ", ".join(f"{s} double" for s in quality_model.STATISTICS))
    got = [v["p"] for v in rows.select("k", quality_model.compiled(intercept, weighted).alias("p")).orderBy("k").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-margin))) and np.mean((np.array(got) >= 0.5) == y) > 0.95


def test_paths_of_a_tree_are_conjunctions():
    x = np.array([[a, b] + [0.0] * 13 for a in (0, 1) for b in (0, 1)] * 20, float)
    y = ((x[:, 0] == 1) & (x[:, 1] == 1)).astype(float)
    rules = quality_model.propose(x, y, trees=1, depth=2)
    assert any((r.holds(x) == (y == 1)).all() and len(r.terms) == 2 for r in rules)
