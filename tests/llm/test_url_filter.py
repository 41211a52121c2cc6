import datetime as dt

from hopframe.llm import url_filter

CAPTURES = "page_id long, link string, on_day date, host string, action string"


def test_entries_active_at_fetch_time(spark):
    day = lambda m, d: dt.date(2024, m, d)
    entries = [("bad.org", "2024-02-01", "block"), ("bad.org", "2024-03-01", "allow"), ("a.bad.org", "2024-01-05", "allow"), ("tie.org", "2024-01-01", "allow"), ("tie.org", "2024-01-01", "block"), (None, "2024-01-01", "block"), ("null.org", None, "block")]
    cases = [
        (1, "http://bad.org/x", day(1, 31), False, None),
        (2, "https://WWW.Bad.org:80/x?y#z", day(2, 1), True, "bad.org"),
        (3, "http://bad.org", day(2, 29), True, "bad.org"),
        (4, "http://bad.org", day(3, 1), False, "bad.org"),
        (5, "http://x.a.bad.org", day(2, 10), False, "a.bad.org"),
        (6, "http://notbad.org", day(2, 10), False, None),
        (7, "http://user:pw@tie.org/", day(1, 1), True, "tie.org"),
        (8, None, day(1, 1), False, None),
        (9, "no url", day(1, 1), False, None),
        (10, "http://bad.org", None, False, None),
        (11, "http://null.org", day(5, 5), False, None),
        (None, "http://tie.org", day(5, 5), True, "tie.org"),
        (3, "http://bad.org", day(2, 29), True, "bad.org"),
    ]
    df = spark.createDataFrame([(*c[:3], "clash", "clash") for c in cases], CAPTURES)
    lists = spark.createDataFrame(entries, "pattern string, listed_on string, action string")
    out = url_filter.blocked(df, lists, "page_id", "link", "on_day")
    key = lambda x: (x[0] or 0, x[1:])
    assert sorted(((r.page_id, r.blocked, r.pattern) for r in out.collect()), key=lambda x: str(x)) == sorted(((c[0], c[3], c[4]) for c in cases), key=lambda x: str(x)), key
    assert url_filter.blocked(df, lists.limit(0), "page_id", "link", "on_day").where("blocked").count() == 0
    assert url_filter.blocked(df.limit(0), lists, "page_id", "link", "on_day").count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_its_sql(spark):
    import duckdb

    from hopframe.llm import queries

    d = "/root/testdata/sf0.001"
    got = queries.op7_temporal_list_join(spark, d)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{d}/pages.parquet'")
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.OP7_SQL})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect()) and len(want) > 0
