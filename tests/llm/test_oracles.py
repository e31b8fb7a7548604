"""Queries of the corpus operators on whole tables against their SQL in DuckDB."""

import duckdb
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
