import random
from zlib import crc32

import pytest

from cohortveil.llm import conversations as c
from cohortveil.llm.queries import op11_conversation_repair

from . import brute

NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def made(seed, convs=60, length=9):
    r = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \t", "So!", "one two", "a.\n"]
    return [(k, t, r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "Umber"]), r.choice(texts)) for k in range(convs) for t in r.sample(range(length * 2), r.randrange(length))]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], r[3]))


def got(df):
    return {r["conv_id"]: tuple(r[n] for n in NAMES[1:]) for r in df.collect()}


@pytest.mark.parametrize(("seed", "chunk", "size"), [(1, 4096, 1 << 22), (2, 3, 1 << 22), (3, 5, 9)])
def test_repairs_are_the_cheapest_and_ascii_least(spark, monkeypatch, seed, chunk, size):
    monkeypatch.setattr(c, "CHUNK", chunk)
    monkeypatch.setattr(c, "CHUNK_BYTES", size)
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(c.repair(df)) == brute.repair(ordered(rows))


def test_a_long_conversation_is_cut_anywhere(spark, monkeypatch):
    r = random.Random(8)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", f"No {t}", f"{t}!", ""])) for t in range(900)]
    want = brute.repair(rows)
    df = spark.createDataFrame(rows + [(8, 1, "user", "Hm.")], SCHEMA).repartition(7)
    for chunk in (4096, 64, 1):
        monkeypatch.setattr(c, "CHUNK", chunk)
        found = got(c.repair(df))
        assert found[7] == want[7] and found[8][5:7] == (3, "KI")


def test_edits_as_rows(spark, monkeypatch):
    monkeypatch.setattr(c, "CHUNK", 4)
    rows = made(4, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    lines = {}
    for r in sorted(c.repaired_rows(df).collect(), key=lambda r: (r["part"], r["seq"], r["pos"])):
        lines.setdefault(r["conv_id"], []).append((r["edit"], r["role"], r["text"]))
    want = brute.repair(ordered(rows))
    for conv, (*_, audit, digest) in want.items():
        own = lines.get(conv, [])
        assert "".join(e for e, _, _ in own) == audit
        assert brute.sha256("\n".join(f"{role}:{text}" for _, role, text in own if role is not None).encode()).hexdigest() == digest


def test_odd_rows(spark):
    """Null ids, turns, roles and texts, ties, repeated rows, clashing names and very long texts."""
    long = "word " * 300_000 + "end."
    rows = [(None, 1, "user", "Hi."), (None, None, "user", long), (1, None, None, "Hi."), (1, 2, "user", None), (2, 5, "user", "b."), (2, 5, "user", "a."), (2, 5, "assistant", "c."), (3, 9, "user", "Hi."), (3, 9, "user", "Hi."), (3, 9, "user", "Hi.")]
    plain = got(c.repair(spark.createDataFrame(rows, SCHEMA)))
    wide = spark.createDataFrame([(*r, *[k] * 5) for k, r in enumerate(rows)], SCHEMA + ", conv int, part int, copies int, same int, whole int")
    assert got(c.repair(wide)) == plain
    spaced = [(a, t, " " if x is None else x, " " if y is None else y) for a, t, x, y in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3])
    assert plain == brute.repair(sorted(spaced, key=key))
    assert plain[1][0] == 0 and plain[3][:6] == (0, 0, 2, 0, 2, 11)


def test_no_rows(spark):
    assert c.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_against_plain_damage(spark, tmp_path):
    """The registered query on a table of its own; a conversation may lose all its rows."""
    rows = [(k, t, r, x) for k, t, r, x in made(6, 120)] + [(k, 0, "user", "Alone.") for k in range(1000, 1060)] + [(None, None, None, None), (5, None, "user", None)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    after = []
    for conv, turn, role, text in rows:
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        own = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text)
        after += [own] * {0: 0, 3: 2}.get(kind, 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3])
    want = dict.fromkeys([r[0] for r in rows], (0, 0, 0, 0, 0, 0, "", brute.sha256(b"").hexdigest())) | brute.repair(sorted(after, key=key))
    assert got(op11_conversation_repair(spark, str(tmp_path))) == want
    assert any(v[6] == "" for v in want.values())


def test_block_tables_are_their_symbols(spark):
    t = c.tables()
    r = random.Random(3)
    for _ in range(200):
        symbols = c.np.array([r.randrange(c.SYMBOLS) for _ in range(r.randrange(30))], int)
        at, leads = t.through(symbols)
        for v in range(len(t.vectors)):
            assert t.backward(symbols, v)[0] == at[v]
            assert [t.trace(symbols, v, s)[1] for s in range(4)] == leads[v].tolist()
