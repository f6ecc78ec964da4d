"""The pipeline's stages on a small folder, against plain versions."""

import random

import pytest

import corpus_pipeline as pipeline
from cohortveil.llm import secrets

from . import brute
from .test_texts import plain_contamination, plain_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def corpus():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8)))
    say = lambda n: [word() for _ in range(n)]
    items = [(str(k), " ".join(say(30))) for k in range(4)]
    base = [say(90) for _ in range(5)]
    rows = []
    for k in range(130):
        kind = k % 10
        if kind < 3:
            w = list(r.choice(base))
            w[r.randrange(90)] = word()
        elif kind == 3:
            w = say(60) + r.choice(items)[1].split()
        elif kind == 4:
            w = say(80) + ["password", "=", "Zx9qL2vTw8"]
        elif kind == 5:
            w = [x + "###" for x in say(70)]
        elif kind == 6:
            w = say(20)
        else:
            w = say(70)
        text = " ".join(w)
        rows.append((k, text, "en" if k % 4 else None, f"s{k % 2}", len(text), "x"))
    rows += [(500, None, None, None, None, None), (501, "", "en", "s0", 0, "x"), rows[7], (7, " ".join(say(60)), "en", "s1", 5, "x"), (None, " ".join(say(66)), "en", "s1", 5, "x")]
    return rows, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = corpus()
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def ids(rows):
    return sorted((r[0] for r in rows), key=repr)


def test_each_stage_on_what_the_last_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    _, items = corpus()
    assert len(pipeline.STAGES) == 5
    for k, (_, stage) in enumerate(pipeline.STAGES):
        before = [(r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()]
        out = stage(spark, docs, folder)
        if k < 4:
            assert tuple(out.columns) == pipeline.COLUMNS
        after = [tuple(r) for r in out.collect()]
        if k == 0:
            passed = [d for d, t, _ in before for n in [plain_rules(t)] if n[0] >= 50 and 100 * n[4] <= 50 * n[0] and n[2] == 0]
            assert ids(after) == sorted(passed, key=repr)
        if k == 1:
            own = sorted({(d, t) for d, t, _ in before}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
            label = {n: c for n, _, c, _ in brute.near_groups(list(enumerate(t for _, t in own)))}
            kept = sorted(own.index((a[0], a[1])) for a in after)
            assert sorted(label[n] for n in kept) == sorted(set(label.values()))
            assert all(own[n][0] == own[label[n]][0] for n in kept)
        if k == 2:
            bad = {d for d, _, _, _, flag in plain_contamination([b[:2] for b in before], items) if flag}
            assert bad and ids(after) == ids([b for b in before if b[0] not in bad])
        if k == 3:
            assert ids(after) == ids(before) and sum("[SECRET]" in a[1] for a in after) == sum(bool(secrets.base_spans(b[1])) for b in before) > 0
            assert all(a[4] == len(a[1]) for a in after if "[SECRET]" in a[1])
        if k == 4:
            assert ids(after) == ids(before) and all(r["exact"] for r in out.collect())
        docs = out
    assert ids(pipeline.run(spark, folder).collect()) == ids(docs.collect())


def test_no_rows(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_copies_judge_rows_by_id_and_text(spark):
    r = random.Random(2)
    say = lambda: [str(r.randrange(10**6)) for _ in range(60)]
    a, b, c, d, e, f = (say() for _ in range(6))
    near = lambda w: " ".join([*w, "more"])
    a, b, c, d, e, f, *like = (*map(" ".join, (a, b, c, d, e, f)), *map(near, (a, b, d)))
    low, high = sorted((e, f))
    rows = [(None, a), (None, b), (None, c), (None, c), (None, None), (1, like[0]), (2, like[1]), (3, d), (4, like[2]), (5, low), (5, high), (6, high + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(x["doc_id"], x["text"]) for x in pipeline.near_copies(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted([(None, a), (None, b), (None, c), (None, None), (3, d), (5, low), (5, high)], key=repr)


def test_quality_judges_rows_by_language_and_source(spark):
    """One id and text in two sources, of which one makes it an outlier: only the other row stays."""
    r = random.Random(5)
    say = lambda n, size: " ".join("".join(r.choice("abcdefghij") for _ in range(size)) for _ in range(n))
    both = say(80, 5)
    rows = [(k, say(80, 5), "en", "s", 1) for k in range(80)] + [(100 + k, say(80, 12), "en", "t", 1) for k in range(80)] + [(7000, both, "en", x, 1) for x in "st"]
    docs = spark.createDataFrame(rows, SCHEMA.rsplit(",", 1)[0])
    kept = [(x["doc_id"], x["source"]) for x in pipeline.quality(spark, docs, "").collect()]
    assert (7000, "s") in kept and (7000, "t") not in kept and len(kept) > 150


def test_documents_that_share_a_key_by_chance(spark, monkeypatch):
    monkeypatch.setattr(pipeline, "row_key", lambda: pipeline.F.lit(5).cast("long"))
    r = random.Random(3)
    rows = [(k, " ".join(str(r.randrange(10**6)) for _ in range(60)), "en", "s", 1) for k in range(6)]
    docs = spark.createDataFrame([*rows, rows[2], (9, rows[4][1], "en", "s", 1)], SCHEMA.rsplit(",", 1)[0])
    assert sorted(tuple(x) for x in pipeline.near_copies(spark, docs, "").collect()) == rows


def test_very_long_texts_and_clashing_names(spark, folder, tmp_path):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8)))
    long = " ".join(word() for _ in range(40_000))
    rows = [(k, " ".join(word() for _ in range(70)), "en", "s", 1) for k in range(50)] + [(60, long, "en", "s", 1), (61, long + " end", "en", "s", 1)]
    names = "row_key, other, nth, least, times, component_id, kept, group, spans, words".split(", ")
    wide = spark.createDataFrame([(*x, *[k] * len(names)) for k, x in enumerate(rows)], SCHEMA.rsplit(",", 1)[0] + "".join(f", {c} int" for c in names))
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x["doc_id"]: x["exact"] for x in pipeline.run(spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys([*range(50), 60], True)
