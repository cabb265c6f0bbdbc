"""Every query with SQL against DuckDB on the smallest data directory; every other query runs."""

import os
from collections import Counter

import duckdb
import pytest

from cairn.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def shown(v):
    return f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    got = Counter(tuple(shown(r[c]) for c in names) for r in df.collect())
    assert got == Counter(tuple(map(shown, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
