import sys

import __spark_entry__ as entry
from hopframe.plans import catalog


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 15 and set(rows[0].asDict()) == {"custkey", "orders"}
    assert [r.orders for r in rows] == sorted((r.orders for r in rows), reverse=True)


def test_every_traversal_has_sql():
    assert set(catalog.TRAVERSALS) <= set(entry.queries()) and set(catalog.TRAVERSALS) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_llm_folders(monkeypatch):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("hopframe.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "hopframe.llm", None)
    assert set(entry.queries()) == set(catalog.TRAVERSALS) == set(entry.oracle_sql())
