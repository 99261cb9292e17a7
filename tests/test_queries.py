"""Every engine query that has SQL, against DuckDB on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from millrace import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    """A value in a form that both engines share."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.5g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.5g}" if abs(v) < 10**5 else str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(v) for v in r) for r in got.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() >= 0
