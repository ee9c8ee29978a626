"""Every core query with SQL gives the rows that the SQL gives in another engine, on the smallest tables."""

import math
import os
from decimal import Decimal

import pytest

from lexloom import registry

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def engine():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, Decimal):
        v = float(v)
    return round(v, 6) if isinstance(v, float) else v


def rows(data):
    return sorted((tuple(map(value, r)) for r in data), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, engine, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = rows(tuple(r[c] for c in cols) for r in df.collect())
    r = engine.sql(SQL[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert got == rows(tuple(x[i] for i in at) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_queries_without_sql_run(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0
