"""Connected components of links by large stars and small stars; no links reach the driver.

Every link points from its larger node to its smaller one. A large star moves a node's larger
neighbours to its smallest neighbour, a small star its smaller neighbours and itself; both in
turn leave one star for each component. Their number grows with the logarithm of the nodes, or
its square at worst, whatever order the nodes are in. Each turn is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm.common import drop_written, written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("c").agg(F.min("p").alias("m"), F.count("*").alias("parents"))


def _are_stars(edges: DataFrame) -> bool:
    low = _least(edges)
    if low.where("parents > 1").limit(1).count():
        return False
    return not edges.join(low.select(F.col("c").alias("p")), "p", "left_semi").limit(1).count()


def turn(edges: DataFrame) -> DataFrame:
    """The links (c, p), each c > p, after a large star and a small star."""
    up = _least(edges).select(F.col("c").alias("p"), "m")
    large = edges.join(up, "p", "left").select("c", F.coalesce("m", "p").alias("p")).distinct()
    both = large.join(_least(large).select("c", "m"), "c")
    ends = F.when(F.col("p") == F.col("m"), F.array(F.struct("c", F.col("m").alias("p")))).otherwise(F.array(F.struct("c", F.col("m").alias("p")), F.struct(F.col("p").alias("c"), F.col("m").alias("p"))))
    return both.select(F.explode(ends).alias("e")).select("e.*").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each node of ``links``; component is its smallest reachable node."""
    edges = written(links.select(F.greatest(a, b).alias("c"), F.least(a, b).alias("p")).where("c <> p").distinct())
    while not _are_stars(edges):
        after = written(turn(edges))
        drop_written(edges)
        edges = after
    roots = edges.select(F.col("p").alias("node"), F.col("p").alias("component")).distinct()
    out = written(edges.select(F.col("c").alias("node"), F.col("p").alias("component")).unionByName(roots))
    drop_written(edges)
    return out
