"""Every registered traversal against its SQL in DuckDB."""

import decimal

import duckdb
import pytest

from hopframe.plans import catalog, warehouse

D = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def plain(rows):
    fix = lambda v: float(v) if isinstance(v, decimal.Decimal) else v
    return sorted(str(tuple(map(fix, r))) for r in rows)


@pytest.mark.parametrize("name", catalog.TRAVERSALS)
def test_same_rows(spark, sql, name):
    df = catalog.QUERIES[name](spark, D)
    names = [d[0] for d in sql.execute(catalog.ORACLE_SQL[name]).description]
    assert sorted(names) == sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in df.columns)
    assert plain(df.collect()) == plain(sql.execute(f"select {quoted} from ({catalog.ORACLE_SQL[name]})").fetchall())


def test_lead_over_buckets(spark):
    df = spark.createDataFrame([(k, k * 7 % 13) for k in range(0, 400, 3)], "k long, v long").repartition(5)
    want = [(k, k * 7 % 13, (k + 3) * 7 % 13 if k + 3 < 400 else None) for k in range(0, 400, 3)]
    for bucket in (1, 10, 64, 1000):
        assert sorted(map(tuple, warehouse.following(df, "k", "v", "n", bucket).collect())) == want
