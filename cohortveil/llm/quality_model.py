"""A quality classifier made of sparse rules.

Small trees, boosted on labelled documents' statistics, propose rules: every
path from a root to a node is a conjunction of comparisons.  A lasso logistic
regression keeps few of them, with weights.  The kept rules become one Spark
column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import as_bytes, document_texts, map_batches, stored
from .language import held_out
from .rolling import word_bounds

#: Labelled rows to fit on at most; of more, those whose ids' hashes are small enough.
MOST_LABELLED = 20_000
TREES, DEPTH, BINS, LASSO = 40, 3, 32, 2e-3
STATISTICS = ("log_words", "word_length", "long_words", "distinct_words", "top_word", "repeated_pairs", "repeated_lines", "line_length", "upper", "digits", "symbols", "bars", "marks", "ends", "foreign")


def text_statistics(text: bytes) -> list[float]:
    """The statistics of one text, in the order of STATISTICS; all 0 for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    a = np.frombuffer(text, np.uint8)
    of = np.bincount(a, minlength=256)
    starts, stops = word_bounds(a)
    sizes = stops - starts
    n, chars = len(words), int(sizes.sum())
    times: dict[bytes, int] = {}
    for w in words:
        times[w] = times.get(w, 0) + 1
    pairs = set(zip(words, words[1:], strict=False))
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = int(np.isin(a[stops - 1], np.frombuffer(b".!?", np.uint8)).sum())
    count = lambda x: int(of[list(x)].sum())
    return [
        float(np.log1p(n)), chars / n, float((sizes > 12).mean()), len(times) / n, max(times.values()) / n, 1 - len(pairs) / max(n - 1, 1),
        1 - len(set(lines)) / len(lines), chars / len(lines), count(range(65, 91)) / chars, count(range(48, 58)) / chars,
        count(b"#*$%&<>@^~=+_{}[]\\") / chars, count(b"|") / n, count(b"!") / n, ends / n, int(of[128:].sum()) / chars,
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text."""

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            table = np.array([text_statistics(t) for t in as_bytes(batch.column("text"))], np.float64).reshape(batch.num_rows, len(STATISTICS))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(table[:, k]) for k in range(len(STATISTICS)))], ["doc_id", *STATISTICS])

        return step

    return map_batches(document_texts(docs), work, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A conjunction: statistic number, whether above, threshold."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, cut in self.terms:
            out &= x[:, k] > cut if above else x[:, k] <= cut
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, above, cut in self.terms:
            out = out & (F.col(STATISTICS[k]) > cut if above else F.col(STATISTICS[k]) <= cut)
        return out


def grow(x: np.ndarray, target: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray], depth: int, terms=(), rules=None, rows=None):
    """A least-squares tree on `target`; adds each node's rule, returns the fitted values."""
    rows = np.arange(len(x)) if rows is None else rows
    total, mass = target[rows].sum(), weight[rows].sum()
    fitted = np.zeros(len(x))
    best = (1e-9, None, None)
    if depth and len(rows) >= 20:
        base = total * total / max(mass, 1e-9)
        for k, edges in enumerate(cuts):
            if not len(edges):
                continue
            place = np.searchsorted(edges, x[rows, k], side="left")
            t = np.cumsum(np.bincount(place, target[rows], len(edges) + 1))[:-1]
            m = np.cumsum(np.bincount(place, weight[rows], len(edges) + 1))[:-1]
            c = np.cumsum(np.bincount(place, minlength=len(edges) + 1))[:-1]
            gain = t * t / np.maximum(m, 1e-9) + (total - t) ** 2 / np.maximum(mass - m, 1e-9) - base
            gain[(c < 8) | (len(rows) - c < 8)] = 0
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], k, float(edges[at]))
    if best[1] is None:
        fitted[rows] = total / max(mass, 1e-9)
        return fitted
    _, k, cut = best
    below = x[rows, k] <= cut
    for above, part in ((False, rows[below]), (True, rows[~below])):
        rule = (*terms, (k, above, cut))
        rules[Rule(tuple(sorted(rule)))] = None
        fitted += grow(x, target, weight, cuts, depth - 1, rule, rules, part)
    return fitted


def propose(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """The rules of all nodes of boosted trees."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    rules: dict[Rule, None] = {}
    margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        margin = margin + 0.3 * np.clip(grow(x, y - p, np.maximum(p * (1 - p), 1e-3), cuts, depth, (), rules), -4, 4)
    return list(rules)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    n, k = z.shape
    full = np.concatenate((np.ones((n, 1)), z), axis=1)
    v = np.random.default_rng(0).normal(size=k + 1)
    for _ in range(30):
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 4 * n / max(float(np.linalg.norm(full.T @ (full @ v))), 1e-9) / 1.05
    w = look = np.zeros(k + 1)
    w[0] = look[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    t = 1.0
    for _ in range(steps):
        slope = full.T @ (1 / (1 + np.exp(-(full @ look))) - y) / n
        new = look - rate * slope
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / after * (new - w), new, after
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and the weighted rules; without both labels the intercept alone."""
    if not len(y):
        return 0.0, []
    if y.min() == y.max():
        return (4.0 if y[0] else -4.0), []
    rules = propose(x, y)
    intercept, weights = lasso(np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64), y)
    return intercept, [(float(w), r) for w, r in zip(weights, rules, strict=True) if abs(w) > 1e-6]


def compiled(intercept: float, weighted: list[tuple[float, Rule]]) -> Column:
    """The rules as one expression over the statistics: the probability of label 1."""
    margin = F.lit(intercept)
    for w, rule in weighted:
        margin = margin + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-margin))


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """The quality of every whole text, as labels.quality marks it.

    Fits on at most `most` labelled rows that aren't held out (where there are
    more, those with small hashes of their ids, so the choice doesn't depend on
    the order of rows), and scores from text alone.  Returns doc_id, held_out, score (how
    likely label 1 is) and predicted (1 from 0.5 on).

    Null texts and texts without words have statistics of 0 and are scored
    like any other.  A null label is no label; several labels of one id count
    each; a null id is not held out and has no label.  Without labels every
    score is 0.5.  Repeated rows are scored each.  Clashing other columns
    change nothing; no rows give no rows.
    """
    table = stored(statistics(docs))
    marked = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = table.join(marked, "doc_id").where(~held_out(F.col("doc_id"), 3, 1))
    labelled = known.count()
    if labelled > most:
        # A share of the hashes that leaves five standard deviations below the bound, so no task sends more than its part.
        share = max(most - 5 * most**0.5, 1) / labelled
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(most)
    sample = known.select(*STATISTICS, "quality").toPandas()
    intercept, weighted = fit(sample[list(STATISTICS)].to_numpy(np.float64), sample["quality"].to_numpy(np.float64))
    scored = table.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), compiled(intercept, weighted).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
