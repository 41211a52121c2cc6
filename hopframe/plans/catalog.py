"""Registered traversals over the warehouse graph, each with the SQL that gives the same rows.

``money`` columns are rounded on both sides. Results are complete, or a limit follows an order
whose ties the engine breaks by id, as the SQL does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.plans.warehouse import engine

_NEXT = "(SELECT * FROM (SELECT o_orderkey, o_custkey AS s, o_orderstatus, o_totalprice, lead(o_custkey) OVER (ORDER BY o_orderkey) AS t FROM orders) WHERE t IS NOT NULL)"

_CREDIT = "(SELECT c_custkey, c_name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS credit FROM customer)"


def _reach(n: int, start: str) -> str:
    steps = "".join(f", f{i} AS (SELECT DISTINCT e.t AS v FROM f{i - 1} JOIN e ON e.s = f{i - 1}.v)" for i in range(1, n + 1))
    return f"WITH e AS (SELECT s, t FROM {_NEXT}), f0 AS (SELECT c_custkey AS v FROM customer WHERE {start}){steps} SELECT count(*) AS count FROM f{n}"


#: name: (traversal, SQL, columns to round to two digits)
TRAVERSALS: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "v_count": ("g.V().hasLabel('Customer').count()", "SELECT count(*) AS count FROM customer", ()),
    "e_count": ("g.E().hasLabel('CONTAINS').count()", "SELECT count(*) AS count FROM lineitem", ()),
    "v_rows": ("g.V().hasLabel('Nation')", "SELECT * FROM nation", ()),
    "e_rows": ("g.E().hasLabel('IN_REGION')", "SELECT * FROM nation", ()),
    "v_by_id": ("g.V(5).hasLabel('Customer').valueMap('custkey','name','mktsegment')", "SELECT c_custkey AS custkey, c_name AS name, c_mktsegment AS mktsegment FROM customer WHERE c_custkey = 5", ()),
    "e_by_id": ("g.E(7).hasLabel('PLACED').values('orderstatus')", "SELECT o_orderstatus AS orderstatus FROM orders WHERE o_orderkey = 7", ()),
    "has_eq": ("g.V().hasLabel('Customer').has('mktsegment','BUILDING').values('name')", "SELECT c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'", ()),
    "has_neq": ("g.V().hasLabel('Customer').has('mktsegment',neq('BUILDING')).count()", "SELECT count(*) AS count FROM customer WHERE c_mktsegment <> 'BUILDING'", ()),
    "has_gt": ("g.V().hasLabel('Part').has('size',gt(40)).values('name')", "SELECT p_name AS name FROM part WHERE p_size > 40", ()),
    "has_range": ("g.V().hasLabel('Part').has('size',gte(10)).has('size',lt(20)).count()", "SELECT count(*) AS count FROM part WHERE p_size >= 10 AND p_size < 20", ()),
    "has_lte": ("g.E().hasLabel('CONTAINS').has('quantity',lte(3)).count()", "SELECT count(*) AS count FROM lineitem WHERE l_quantity <= 3", ()),
    "has_id": ("g.V().hasLabel('Order').hasId(33).values('orderstatus')", "SELECT o_orderstatus AS orderstatus FROM orders WHERE o_orderkey = 33", ()),
    "has_not": ("g.V().hasLabel('Customer').hasNot('name').count()", "SELECT count(*) AS count FROM customer WHERE c_name IS NULL", ()),
    "values_is": ("g.V().hasLabel('Part').values('size').is(gt(45))", "SELECT p_size AS size FROM part WHERE p_size > 45", ()),
    "edge_keys": ("g.E().hasLabel('PLACED').has('outV','10').count()", "SELECT count(*) AS count FROM orders WHERE o_custkey = 10", ()),
    "e_sum": ("g.E().hasLabel('CONTAINS').values('quantity').sum()", "SELECT round(sum(l_quantity), 2) AS sum FROM lineitem", ("sum",)),
    "e_mean": ("g.E().hasLabel('CONTAINS').values('quantity').mean()", "SELECT round(avg(l_quantity), 2) AS mean FROM lineitem", ("mean",)),
    "v_max": ("g.V().hasLabel('Customer').values('acctbal').max()", "SELECT max(c_acctbal) AS max FROM customer", ()),
    "v_min": ("g.V().hasLabel('Customer').values('acctbal').min()", "SELECT min(c_acctbal) AS min FROM customer", ()),
    "hop_sum": ("g.V().hasLabel('Customer').has('mktsegment','BUILDING').outE('PLACED').values('totalprice').sum()", "SELECT round(sum(o_totalprice), 2) AS sum FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'", ("sum",)),
    "group_count": ("g.V().hasLabel('Customer').groupCount().by('mktsegment')", "SELECT c_mktsegment AS mktsegment, count(*) AS count FROM customer GROUP BY 1", ()),
    "group_count_edges": ("g.E().hasLabel('CONTAINS').groupCount().by('returnflag')", "SELECT l_returnflag AS returnflag, count(*) AS count FROM lineitem GROUP BY 1", ()),
    "group_count_alias": ("g.V().hasLabel('Nation').as('n').in('CUSTOMER_IN').groupCount().by(select('n').by('name'))", "SELECT n_name AS name, count(*) AS count FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1", ()),
    "group_count_top": ("g.V().hasLabel('Customer').groupCount().by('nationkey').order().by(values,Order.desc).limit(5)", "SELECT c_nationkey AS nationkey, count(*) AS count FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", ()),
    "value_map": ("g.V().hasLabel('Region').valueMap()", "SELECT r_regionkey AS regionkey, r_name AS name FROM region", ()),
    "two_hop_path": ("g.V().hasLabel('Customer').out('CUSTOMER_IN').out('IN_REGION').path().by('name')", "SELECT c_name AS name0, n_name AS name1, r_name AS name2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", ()),
    "path_ids": ("g.V().hasLabel('Nation').out('IN_REGION').path()", "SELECT CAST(n_nationkey AS BIGINT) AS id0, CAST(n_regionkey AS BIGINT) AS id1 FROM nation", ()),
    "edge_path": ("g.V(5).hasLabel('Customer').outE('PLACED').inV().path().by('name').by('totalprice').by('orderstatus')", "SELECT c_name AS name0, o_totalprice AS totalprice1, o_orderstatus AS orderstatus2 FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey = 5", ()),
    "in_hop": ("g.V().hasLabel('Region').in('IN_REGION').in('CUSTOMER_IN').count()", "SELECT count(*) AS count FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey", ()),
    "both_hop": ("g.V(5).hasLabel('Customer').both('NEXT_ORDER').dedup().values('custkey')", f"SELECT DISTINCT v AS custkey FROM (SELECT t AS v FROM {_NEXT} WHERE s = 5 UNION ALL SELECT s FROM {_NEXT} WHERE t = 5)", ()),
    "both_count": ("g.V(5).hasLabel('Customer').both('NEXT_ORDER').count()", f"SELECT count(*) AS count FROM (SELECT t AS v FROM {_NEXT} WHERE s = 5 UNION ALL SELECT s FROM {_NEXT} WHERE t = 5)", ()),
    "both_e": ("g.V().hasLabel('Customer').has('custkey',lte(50)).bothE('NEXT_ORDER').count()", f"SELECT count(*) AS count FROM customer JOIN {_NEXT} ON s = c_custkey OR t = c_custkey WHERE c_custkey <= 50", ()),
    "multi_label": ("g.V().hasLabel('Nation').in('CUSTOMER_IN','SUPPLIER_IN').values('name')", "SELECT c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", ()),
    "edge_filter_hop": ("g.V().hasLabel('Customer').outE('PLACED').has('orderstatus','F').inV().count()", "SELECT count(*) AS count FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'", ()),
    "other_v": ("g.V(3).hasLabel('Nation').inE('CUSTOMER_IN').otherV().values('custkey')", "SELECT c_custkey AS custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey = 3", ()),
    "back_to_source": ("g.V(3).hasLabel('Customer').outE('PLACED').outV().dedup().values('name')", "SELECT DISTINCT c_name AS name FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey = 3", ()),
    "e_endpoints": ("g.E().hasLabel('CUSTOMER_IN').inV().values('name')", "SELECT DISTINCT n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey", ()),
    "e_both_v": ("g.E().hasLabel('NEXT_ORDER').has('orderstatus','F').bothV().count()", f"SELECT count(DISTINCT v) AS count FROM (SELECT s AS v FROM {_NEXT} WHERE o_orderstatus = 'F' UNION ALL SELECT t FROM {_NEXT} WHERE o_orderstatus = 'F') JOIN customer ON c_custkey = v", ()),
    "e_project": ("g.E().hasLabel('PLACED').project('c','total').by(outV().values('name')).by('totalprice')", "SELECT c_name AS c, o_totalprice AS total FROM orders JOIN customer ON c_custkey = o_custkey", ()),
    "e_project_both": ("g.E().hasLabel('IN_REGION').project('n','r').by(outV().values('name')).by(inV().values('name'))", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey", ()),
    "where_semi": ("g.V().hasLabel('Customer').where(outE('PLACED').has('orderstatus','F')).count()", "SELECT count(*) AS count FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", ()),
    "where_anti": ("g.V().hasLabel('Customer').where(not(outE('PLACED').has('orderstatus','F'))).values('custkey')", "SELECT c_custkey AS custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", ()),
    "where_count": ("g.V().hasLabel('Customer').where(outE('PLACED').count().is(gt(12))).count()", "SELECT count(*) AS count FROM (SELECT o_custkey FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) > 12)", ()),
    "where_zero": ("g.V().hasLabel('Customer').where(outE('PLACED').has('orderstatus','F').count().is(0)).count()", "SELECT count(*) AS count FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", ()),
    "where_neighbour": ("g.V().hasLabel('Customer').where(out('CUSTOMER_IN').has('name','NATION_3')).count()", "SELECT count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'", ()),
    "where_and": ("g.V().hasLabel('Customer').where(and(outE('PLACED').has('orderstatus','F'),outE('PLACED').has('orderstatus','P'))).count()", "SELECT count(*) AS count FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", ()),
    "where_or": ("g.V().hasLabel('Customer').where(or(outE('PLACED').has('totalprice',gt(400000)),out('CUSTOMER_IN').has('name','NATION_3'))).count()", "SELECT count(*) AS count FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3')", ()),
    "where_after_hop": ("g.V().hasLabel('Region').in('IN_REGION').where(inE('SUPPLIER_IN').count().is(gt(3))).values('name')", "SELECT n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) > 3", ()),
    "degree": ("g.V().hasLabel('Customer').project('custkey','orders').by('custkey').by(outE('PLACED').count())", "SELECT c_custkey AS custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer", ()),
    "neighbour_count": ("g.V().hasLabel('Nation').project('name','rich').by('name').by(in('CUSTOMER_IN').has('acctbal',gt(5000)).count())", "SELECT n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 5000) AS rich FROM nation", ()),
    "top_hubs": ("g.V().hasLabel('Customer').project('custkey','orders').by('custkey').by(outE('PLACED').count()).order().by(select('orders'),Order.desc).limit(15)", "SELECT c_custkey AS custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15", ()),
    "alias_filter": ("g.V().hasLabel('Customer').project('custkey','f','all').by('custkey').by(outE('PLACED').has('orderstatus','F').count()).by(outE('PLACED').count()).where(select('f').is(gt(6))).order().by(select('f'),Order.desc)", "SELECT * FROM (SELECT c_custkey AS custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(o_orderkey) AS \"all\" FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) WHERE f > 6", ()),
    "fold": ("g.V().hasLabel('Region').project('name','nations').by('name').by(in('IN_REGION').values('name').fold())", "SELECT r_name AS name, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) AS nations FROM region", ()),
    "choose": ("g.V().hasLabel('Customer').project('k','bucket').by('custkey').by(choose(values('acctbal').is(gt(0)),constant('POS'),constant('NEG')))", "SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN 'POS' ELSE 'NEG' END AS bucket FROM customer", ()),
    "order_property": ("g.V().hasLabel('Customer').order().by('acctbal',desc).limit(20).values('custkey')", "SELECT c_custkey AS custkey FROM (SELECT * FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20)", ()),
    "dedup_values": ("g.V().hasLabel('Part').values('brand').dedup()", "SELECT DISTINCT p_brand AS brand FROM part", ()),
    "dedup_hop": ("g.V().hasLabel('Customer').out('CUSTOMER_IN').dedup().count()", "SELECT count(DISTINCT n_nationkey) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey", ()),
    "select_aliases": ("g.V().hasLabel('Nation').as('n').out('IN_REGION').as('r').select('n','r').by('name')", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey", ()),
    "select_mean": ("g.V().hasLabel('Customer').as('c').outE('PLACED').as('o').inV().select('o').by('totalprice').mean()", "SELECT round(avg(o_totalprice), 2) AS mean FROM orders JOIN customer ON c_custkey = o_custkey", ("mean",)),
    "alias_property": ("g.V().hasLabel('Customer').as('a').out('NEXT_ORDER').as('b').where('a',eq('b')).by('mktsegment').count()", f"SELECT count(*) AS count FROM {_NEXT} JOIN customer a ON a.c_custkey = s JOIN customer b ON b.c_custkey = t WHERE a.c_mktsegment = b.c_mktsegment", ()),
    "simple_3": ("g.V(5).hasLabel('Customer').repeat(out('NEXT_ORDER').simplePath()).times(3).path().by('custkey')", f"WITH e AS (SELECT s, t FROM {_NEXT}) SELECT a.s AS custkey0, a.t AS custkey1, b.t AS custkey2, c.t AS custkey3 FROM e a JOIN e b ON b.s = a.t JOIN e c ON c.s = b.t WHERE a.s = 5 AND a.t <> a.s AND b.t NOT IN (a.s, a.t) AND c.t NOT IN (a.s, a.t, b.t)", ()),
    "cycle_2": ("g.V().hasLabel('Customer').as('a').out('NEXT_ORDER').out('NEXT_ORDER').where(eq('a')).count()", f"WITH e AS (SELECT s, t FROM {_NEXT}) SELECT count(*) AS count FROM e a JOIN e b ON b.s = a.t AND b.t = a.s", ()),
    "reach_10": ("g.V(5).hasLabel('Customer').repeat(out('NEXT_ORDER')).times(10).dedup().count()", _reach(10, "c_custkey = 5"), ()),
    "reach_4_values": ("g.V(5).hasLabel('Customer').repeat(out('NEXT_ORDER')).times(2).dedup().values('name')", f"WITH e AS (SELECT s, t FROM {_NEXT}) SELECT DISTINCT c_name AS name FROM e a JOIN e b ON b.s = a.t JOIN customer ON c_custkey = b.t WHERE a.s = 5", ()),
    "walks_3": ("g.V().hasLabel('Customer').repeat(out('NEXT_ORDER')).times(3).count()", f"WITH e AS (SELECT s, t FROM {_NEXT}) SELECT count(*) AS count FROM e a JOIN e b ON b.s = a.t JOIN e c ON c.s = b.t", ()),
    "label_sequence": ("g.V().hasLabel('Customer').repeat(out('CUSTOMER_IN','IN_REGION')).times(2).groupCount().by('name')", "SELECT r_name AS name, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1", ()),
    "chain_neq": ("g.E().hasLabel('NEXT_ORDER').has('orderstatus','F').has('totalprice',gt(300000)).outV().as('a').outE('NEXT_ORDER').has('orderstatus','F').inV().as('b').where('a',neq('b')).select('a','b').by('custkey')", f"WITH e AS (SELECT * FROM {_NEXT} WHERE o_orderstatus = 'F') SELECT DISTINCT x.s AS a, y.t AS b FROM e x JOIN e y ON y.s = x.s WHERE x.o_totalprice > 300000 AND x.s <> y.t", ()),
    "order_parts": ("g.V().hasLabel('Customer').has('mktsegment','MACHINERY').out('PLACED').out('CONTAINS').dedup().count()", "SELECT count(DISTINCT l_partkey) AS count FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'MACHINERY'", ()),
    "supply_walks": ("g.V().hasLabel('Customer').out('PLACED').out('CONTAINS').out('SUPPLIED_BY').out('SUPPLIER_IN').count()", "SELECT CAST(sum(a.n * b.n) AS BIGINT) AS count FROM (SELECT l_partkey AS p, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey GROUP BY 1) a JOIN (SELECT l_partkey AS p, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1) b ON a.p = b.p", ()),
    "limit_count": ("g.V().hasLabel('Customer').limit(7).count()", "SELECT least(7, count(*)) AS count FROM customer", ()),
    "labels_two_hops": ("g.V().hasLabel('Nation').in('CUSTOMER_IN','SUPPLIER_IN').out('CUSTOMER_IN','SUPPLIER_IN').count()", "SELECT (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey) AS count", ()),
    "project_after_hop": ("g.V().hasLabel('Region').in('IN_REGION').project('n','i').by('name').by(identity())", "SELECT n_name AS n, CAST(n_nationkey AS BIGINT) AS i FROM nation JOIN region ON n_regionkey = r_regionkey", ()),
    "project_edge_after_hop": ("g.V(5).hasLabel('Customer').outE('PLACED').project('t','s').by('totalprice').by('orderstatus')", "SELECT o_totalprice AS t, o_orderstatus AS s FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey = 5", ()),
    "order_ascending": ("g.V().hasLabel('Customer').order().by('acctbal').limit(20).values('custkey')", "SELECT c_custkey AS custkey FROM (SELECT * FROM customer ORDER BY c_acctbal NULLS LAST, c_custkey LIMIT 20)", ()),
    "order_after_hop": ("g.V().hasLabel('Region').in('IN_REGION').order().by('name',desc).limit(7).values('name')", "SELECT n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY n_name DESC, n_nationkey LIMIT 7", ()),
    "limit_before_hop": ("g.V().hasLabel('Customer').order().by('acctbal',desc).limit(5).out('PLACED').values('totalprice')", "SELECT o_totalprice AS totalprice FROM orders JOIN (SELECT * FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 5) ON c_custkey = o_custkey", ()),
    "has_not_nulls": ("g.V().hasLabel('Credit').hasNot('credit').values('custkey')", "SELECT c_custkey AS custkey FROM customer WHERE c_acctbal < 0", ()),
    "order_nulls_last": ("g.V().hasLabel('Credit').order().by('credit',desc).limit(1400).values('custkey')", f"SELECT c_custkey AS custkey FROM (SELECT * FROM {_CREDIT} ORDER BY credit DESC NULLS LAST, c_custkey LIMIT 1400)", ()),
    "order_nulls_last_ascending": ("g.V().hasLabel('Credit').order().by('credit').limit(1400).values('custkey')", f"SELECT c_custkey AS custkey FROM (SELECT * FROM {_CREDIT} ORDER BY credit NULLS LAST, c_custkey LIMIT 1400)", ()),
    "identity": ("g.V().hasLabel('Region').identity().project('id').by(identity())", "SELECT CAST(r_regionkey AS BIGINT) AS id FROM region", ()),
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, _, money = TRAVERSALS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = engine(spark, sf_dir).query(text)
        return df.withColumns({c: F.round(c, 2) for c in money}) if money else df

    run.__name__, run.__doc__ = name, text
    return run


QUERIES = {name: _query(name) for name in TRAVERSALS}
ORACLE_SQL = {name: sql for name, (_, sql, _) in TRAVERSALS.items()}
FLAGSHIP = "top_hubs"
