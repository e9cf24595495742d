"""Every registered query of the engine against DuckDB, over the smallest tables."""

import decimal
import math

import duckdb
import pytest

from sparkloom import suite

DATA = "/root/testdata/sf0.001"
#: Queries that this comparison leaves out.
SKIP: set[str] = set()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize() + 0)
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in suite.TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in suite.oracle_sql() if n not in SKIP])
def test_query(spark, oracle, name):
    df = suite.queries()[name](spark, DATA)
    want = oracle.execute(suite.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(range(len(names)), key=lambda k: names[k])
    key = lambda r: tuple("" if v is None else v for v in r)
    expected = sorted((tuple(plain(r[k]) for k in order) for r in want.fetchall()), key=key)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{names[k]}`" for k in order]).collect()), key=key)
    assert got == expected
