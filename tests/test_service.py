"""Parser, mappings, sources, store, cached tables and the HTTP service."""

import http.client
import json
import threading
import urllib.error
import urllib.request

import pytest

from hopframe.engine import Engine
from hopframe.errors import QueryError
from hopframe.plans.mapping import GraphMapping
from hopframe.plans.parser import Literal, Name, Step, Traversal, parse, render
from hopframe.plans.steps import ordered
from hopframe.server import serve
from hopframe.sources.registry import Registry
from hopframe.sources.store import MappingStore
from hopframe.streaming.refresh import FreshTables


def test_parse_and_render():
    t = parse(" g.V( 5 ).has('n', gt(-2.5)) .order().by(select(\"x\"), Order.desc).where(__.not(out('A','B'))) ")
    assert t.steps[0] == Step("V", (Literal(5),))
    assert t.steps[1].args[1] == Traversal((Step("gt", (Literal(-2.5),)),))
    assert t.steps[3].args[1] == Name("Order.desc")
    assert parse(render(t)) == t
    assert parse("g.V().has('a',P.gt(3))").steps[1].args[1].steps[0].name == "gt"
    assert parse(r"g.V('it\'s')").steps[0].args[0].value == r"it\'s"


@pytest.mark.parametrize("text", ["g.V()x", "g.V().has('a", "g.V().has(,)", "g.V().has('a',)", "g.V()..count()", "g.V().has({})", "h.V()", "g"])
def test_parse_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_repeats_unroll():
    assert [p.name for p in ordered(parse("g.V().repeat(out('A').simplePath()).times(2).count()"))] == ["V", "out", "simplePath", "out", "simplePath", "count"]
    assert [p.args[0].value for p in ordered(parse("g.V().repeat(out('A','B')).times(2)"))[1:]] == ["A", "B"]


def test_endpoint_labels_are_told_from_names():
    props = {"properties": {}}
    m = GraphMapping.parse(
        {
            "vertices": {"Person": {"table": "db.sn_persons", **props}, "Company": {"table": "db.sn_companies", **props}, "City": {"table": "sn_cities", "idColumn": "city_key", **props}},
            "edges": {
                "WORKS_AT": {"table": "sn_works_at", "outColumn": "person_id", "inColumn": "company_id", **props},
                "IN": {"table": "x", "outColumn": "a", "inColumn": "city_key", "sourceLabel": "Company", **props},
                "ODD": {"table": "x", "outColumn": "a", "inColumn": "b", **props},
            },
        }
    )
    assert m.endpoint(m.edge("WORKS_AT"), True) == "Person"
    assert m.endpoint(m.edge("WORKS_AT"), False, "Company") == "Company"
    assert (m.endpoint(m.edge("IN"), True), m.endpoint(m.edge("IN"), False)) == ("Company", "City")
    assert m.endpoint(m.edge("ODD"), True, "Person") == "Person"
    with pytest.raises(QueryError):
        m.endpoint(m.edge("ODD"), True)


@pytest.mark.parametrize("told", ["{", "[]", {}, {"vertices": {" ": {"table": "t"}}}, {"vertices": {"A": {"table": " "}}}, {"vertices": {"A": {"table": "t"}}, "edges": {"E": {"table": "e", "outVertexLabel": "Z"}}}])
def test_mappings_that_are_refused(told):
    with pytest.raises(QueryError):
        GraphMapping.parse(told)


def test_store_keeps_files(tmp_path):
    one = {"vertices": {"A": {"table": "a", "properties": {"x": "x"}}}}
    s = MappingStore(tmp_path)
    a, b = s.put(one, id="a"), s.put(one, id="b", activate=False)
    assert s.active_id == "a" and MappingStore(tmp_path).active_id == "a"
    s.set_active(b)
    s.delete(b)
    assert s.active_id == a and [m["id"] for m in MappingStore(tmp_path).list()] == ["a"]
    s.delete(a)
    assert s.status() == {"active": None, "stored": 0}
    for bad in (lambda: s.get(), lambda: s.delete("zz"), lambda: s.set_active("zz"), lambda: s.put(one, id="../x")):
        with pytest.raises(QueryError):
            bad()


def test_sources(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    spark.range(4).write.option("header", True).csv(f"{tmp_path}/t.csv")
    spark.range(5).createOrReplaceTempView("source_view")
    r = Registry(spark, json.dumps([{"id": "lake", "path": str(tmp_path)}]))
    assert r.default == "lake" and r.read("t").count() == 3
    assert r.read("source_view", "catalog").count() == 5
    assert r.read(f"csv:{tmp_path}/t.csv").count() == 4 and r.read(f"parquet:{tmp_path}/t.parquet").count() == 3
    r.register({"id": "db", "url": "jdbc:h2:mem:x", "password": "p"})
    assert r.backends["db"]["driver"] == "org.h2.Driver" and all("password" not in b for b in r.described())
    for bad in (lambda: r.read("t", "nowhere"), lambda: r.register({"path": "x"}), lambda: r.register({"id": "x", "type": "odd"})):
        with pytest.raises(QueryError):
            bad()


def test_cached_tables_are_read_again():
    class Frame:
        cached = 0

        def __getattr__(self, name):
            return lambda *a, **k: self

        def __str__(self):
            return "10"

        _jdf = property(lambda self: self)

        def cache(self):
            Frame.cached += 1
            return self

    now, reads = [0.0], []
    tables = FreshTables(lambda t, d: reads.append(t) or Frame(), seconds=30, clock=lambda: now[0])
    first = tables.read("a")
    assert tables.read("a") is first and reads == ["a"] and Frame.cached == 1
    now[0] = 31
    assert tables.read("a") is not first and reads == ["a", "a"]
    assert FreshTables(lambda t, d: Frame(), most_bytes=5).read("a") and Frame.cached == 2


def test_http(spark):
    spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string").createOrReplaceTempView("http_nodes")
    mapping = {"vertices": {"N": {"table": "http_nodes", "properties": {"name": "name"}}}}
    server = serve(Engine(spark), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(method, path, body=None, **headers):
        data = body if isinstance(body, bytes) else None if body is None else json.dumps(body).encode()
        q = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data, headers, method=method)
        try:
            with urllib.request.urlopen(q) as a:
                return a.status, json.load(a)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    try:
        assert call("GET", "/health")[0] == 200 and call("GET", "/nowhere")[0] == 404
        assert call("POST", "/gremlin/query", {"gremlin": "g.V().count()"})[0] == 400
        assert call("POST", "/mapping/upload", {"mapping": mapping, "id": "m1"}) == (201, {"id": "m1", "active": "m1"})
        part = b'--B\r\nContent-Disposition: form-data; name="file"; filename="m.json"\r\n\r\n' + json.dumps(mapping).encode() + b'\r\n--B\r\nContent-Disposition: form-data; name="id"\r\n\r\nm2\r\n--B--\r\n'
        assert call("POST", "/mapping/upload?activate=false", part, **{"Content-Type": "multipart/form-data; boundary=B"}) == (201, {"id": "m2", "active": "m1"})
        status, answer = call("POST", "/gremlin/query", {"gremlin": "g.V().order().by('name').values('name')"})
        assert status == 200 and answer["results"] == ["x", "y"] and answer["resultCount"] == 2
        assert call("POST", "/gremlin/query", {"gremlin": "g.V().count()"}, **{"X-Mapping-Id": "m2"})[1]["results"] == [2]
        assert call("POST", "/gremlin/query", {"gremlin": "g.V().drop()"})[0] == 400
        for bad in (b"[]", b"null", b'{"gremlin": 5}', b"\xff\xfe", b"{", b'{"gremlin": "g.V().count()", "limit": "x"}'):
            for path in ("/gremlin/query", "/query/explain", "/mapping/upload", "/mapping/active", "/backends/register"):
                if b"limit" not in bad or path == "/gremlin/query":
                    assert call("POST", path, bad)[0] == 400, (path, bad)
        spark.range(150_001).selectExpr("id", "'n' as name").createOrReplaceTempView("http_many")
        many = {"vertices": {"M": {"table": "http_many", "properties": {"name": "name"}}}}
        assert call("POST", "/mapping/upload?activate=false", {"mapping": many, "id": "many"})[0] == 201
        ask = lambda **more: call("POST", "/gremlin/query?mappingId=many", {"gremlin": "g.V().values('id')", **more})[1]
        answer = ask()
        assert answer["resultCount"] == len(set(answer["results"])) == 150_001 and "truncated" not in answer
        assert ask(limit=3)["truncated"] and len(ask(limit=3)["results"]) == 3 and not ask(limit=150_001)["truncated"]
        assert call("DELETE", "/mapping?id=many")[0] == 200
        moved = http.client.HTTPConnection("127.0.0.1", server.server_port)
        moved.request("POST", "/query?mappingId=m1", b"{}")
        moved = moved.getresponse()
        assert moved.status == 307 and moved.getheader("Location") == "/gremlin/query?mappingId=m1"
        assert "steps" in call("POST", "/gremlin/query?sql_log=true", {"gremlin": "g.V().count()"})[1]["trace"]
        assert call("POST", "/gremlin/query", {"gremlin": "g.V().count()"}, **{"X-Backend-Id": "catalog"})[1]["results"] == [2]
        assert call("POST", "/gremlin/query", {"gremlin": "g.V().count()"}, **{"X-Backend-Id": "nowhere"})[0] == 400
        assert "Scan" in call("POST", "/query/explain", {"gremlin": "g.V().count()"})[1]["physical"]
        assert [m["id"] for m in call("GET", "/mappings")[1]] == ["m1", "m2"] and call("GET", "/mapping")[1] == mapping
        assert call("POST", "/mapping/active", {"id": "m2"})[1]["active"] == "m2"
        assert call("DELETE", "/mapping?id=m2")[1] == {"active": "m1", "stored": 1}
        assert call("POST", "/backends/register", {"id": "lake", "path": "/x"}) == (201, {"id": "lake"}) and len(call("GET", "/backends")[1]) == 2
        assert call("POST", "/backends/register", {"id": "gone", "url": "jdbc:trino://nowhere/x"})[0] == 201
        status, answer = call("POST", "/gremlin/query", {"gremlin": "g.V().count()"}, **{"X-Backend-Id": "gone"})
        assert status == 500 and answer["error"]
    finally:
        server.shutdown()


def test_hops_over_several_labels_and_dangling_edges(spark):
    spark.createDataFrame([(1, "p"), (2, "q")], "id long, name string").createOrReplaceTempView("ml_a")
    spark.createDataFrame([(1, "r", 5)], "id int, name string, size int").createOrReplaceTempView("ml_b")
    spark.createDataFrame([(1, 1, 2), (2, 1, 99), (3, 2, 2)], "id long, s long, t long").createOrReplaceTempView("ml_ab1")
    spark.createDataFrame([(1, 1, 1)], "id long, s long, t long").createOrReplaceTempView("ml_ab2")
    prop = {"properties": {"name": "name"}}
    e = Engine(
        spark,
        {
            "vertices": {"A": {"table": "ml_a", **prop}, "B": {"table": "ml_b", "properties": {"name": "name", "size": "size"}}},
            "edges": {
                "AA": {"table": "ml_ab1", "outColumn": "s", "inColumn": "t", "outVertexLabel": "A", "inVertexLabel": "A"},
                "AB": {"table": "ml_ab2", "outColumn": "s", "inColumn": "t", "outVertexLabel": "A", "inVertexLabel": "B"},
            },
        },
    )
    assert sorted(e.results("g.V(1).hasLabel('A').out('AA','AB').values('name')")) == ["q", "r"]
    assert e.results("g.V(1).hasLabel('A').out('AA','AB').hasLabel('B').values('size')") == [5]
    assert e.results("g.V(1).hasLabel('A').out('AA').count()") == [1]
    assert e.results("g.V(1).hasLabel('A').outE('AA').count()") == [2]
    assert e.results("g.V(2).hasLabel('A').bothE('AA').count()") == [2]
    assert e.results("g.V(2).hasLabel('A').both('AA').count()") == [3]
    assert e.results("g.V().hasLabel('A').out('AA','AB').in('AA','AB').dedup().count()") == [2]
    assert sorted(e.results("g.V().hasLabel('A').where(out('AA')).values('name')")) == ["p", "q"]
    assert e.results("g.V().hasLabel('A').project('n','k').by('name').by(out('AA').count()).order().by('n')") == [{"n": "p", "k": 1}, {"n": "q", "k": 1}]
