"""Every query with SQL against DuckDB on the smallest tables; every other query for rows and columns."""

import math

import duckdb
import pytest

from panelrisk.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def same(v):
    if v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (bool, int, float)):
        return f"{float(v):.7g}"
    return str(v)[:19]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    rows = sorted(tuple(same(r[c]) for c in sorted(df.columns)) for r in df.collect())
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    order = [want.columns.index(c) for c in sorted(df.columns)]
    assert rows == sorted(tuple(same(r[k]) for k in order) for r in want.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
