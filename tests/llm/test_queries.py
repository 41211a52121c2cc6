"""Registered queries against their SQL in DuckDB, on whole tables."""

import duckdb
import pytest

from hopframe.llm import queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = queries.QUERIES[name](spark, D)
    want = con.execute(f"select {', '.join(df.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.collect()) and want
