"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


FAST = [k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline"]


@pytest.mark.parametrize("name", FAST)
def test_query(spark, duck, name):
    result = duck.sql(entry.oracle_sql()[name])
    columns = sorted(result.columns)
    at = [result.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    frame = entry.queries()[name](spark, SF)
    assert sorted(frame.columns) == columns
    assert sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
