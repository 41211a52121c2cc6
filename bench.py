"""Headline traversals at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then three times; its time is the median, with the result
fully computed by a no-op sink. ``value`` is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from hopframe.plans import catalog

#: The workload's eight shapes over the warehouse graph, and registered traversals.
SHAPES = {
    "s1_count_vertices": "g.V().hasLabel('Order').count()",
    "s3_filtered_edge_count": "g.E().hasLabel('CONTAINS').has('returnflag','R').count()",
    "c1_top_hubs": "g.V().hasLabel('Customer').project('custkey','segment','orders').by('custkey').by('mktsegment').by(outE('PLACED').count()).order().by(select('orders'),Order.desc).limit(15)",
    "c2_filtered_hubs": "g.V().hasLabel('Customer').project('custkey','f','all').by('custkey').by(outE('PLACED').has('orderstatus','F').count()).by(outE('PLACED').count()).where(select('f').is(gt(0))).order().by(select('f'),Order.desc).limit(15)",
    "c4_two_hop_chain": "g.E().hasLabel('NEXT_ORDER').has('orderstatus','F').outV().as('a').outE('NEXT_ORDER').has('orderstatus','F').inV().as('b').where('a',neq('b')).select('a','b').by('custkey').limit(20)",
    "c8_ten_hop_path": "g.V().hasLabel('Customer').where(outE('NEXT_ORDER').has('orderstatus','F')).limit(1).repeat(out('NEXT_ORDER').simplePath()).times(10).path().by('custkey').limit(5)",
    "c11_reach_10": "g.V().hasLabel('Customer').where(outE('NEXT_ORDER').has('orderstatus','F')).limit(1).repeat(out('NEXT_ORDER')).times(10).dedup().count()",
    "c10_edge_count": "g.E().hasLabel('PLACED').has('orderstatus','F').count()",
}
CATALOG = ("two_hop_path", "walks_3", "order_parts", "supply_walks", "where_or", "fold", "group_count_alias", "hop_sum")


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from hopframe.plans.warehouse import engine

    runs = {n: (lambda q=q: engine(spark, sf).query(q)) for n, q in SHAPES.items()}
    runs |= {n: (lambda n=n: catalog.QUERIES[n](spark, sf)) for n in CATALOG}
    times: dict[str, float] = {}
    for name, make in runs.items():
        took = []
        for _ in range(4):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(statistics.median(took[1:]), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "traversals_total_median", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
