import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import queries

SF = "/root/testdata/sf0.001"
NAMES = sorted(queries.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in queries.TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(queries.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_against_duckdb(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    text = queries.oracle_sql().get(name)
    if text is None:
        assert df.count() > 0
        return
    want = duck.sql(text)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)
