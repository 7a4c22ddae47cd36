"""The driver's entry: every query runs, and agrees with its oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from colloquy.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "events documents embeddings conversations orders".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(frame, columns):
    plain = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else str(x)
    return sorted(str(tuple(map(plain, r))) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR).toPandas()
    assert len(got)
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
