"""Every query with an SQL twin gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from scenequarry.plans import oracles, registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _canon(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(oracles.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = duck.execute(oracles.oracle_sql()[name])
    have = [d[0] for d in cursor.description]
    assert sorted(have) == columns
    at = [have.index(c) for c in columns]
    theirs = sorted(tuple(_canon(r[i]) for i in at) for r in cursor.fetchall())
    assert sorted(tuple(_canon(r[c]) for c in columns) for r in df.collect()) == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
