"""A property graph over the warehouse tables, for the registered queries and the benchmark."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopframe.engine import Engine
from hopframe.streaming.refresh import FreshTables

#: Order keys in a bucket of the two-level lead().
LEAD_BUCKET = 1 << 16


def _props(prefix: str, names: str) -> dict[str, str]:
    return {n: f"{prefix}_{n}" for n in names.split()}


_LINE = _props("l", "quantity extendedprice discount tax returnflag linestatus shipdate linenumber")
_ORDER = _props("o", "orderkey custkey orderstatus totalprice orderdate orderpriority")

MAPPING = {
    "vertices": {
        "Region": {"table": "region", "idColumn": "r_regionkey", "properties": _props("r", "regionkey name")},
        "Nation": {"table": "nation", "idColumn": "n_nationkey", "properties": _props("n", "nationkey name regionkey")},
        "Customer": {"table": "customer", "idColumn": "c_custkey", "properties": _props("c", "custkey name nationkey acctbal mktsegment")},
        "Supplier": {"table": "supplier", "idColumn": "s_suppkey", "properties": _props("s", "suppkey name nationkey acctbal")},
        "Part": {"table": "part", "idColumn": "p_partkey", "properties": _props("p", "partkey name brand type size retailprice")},
        "Credit": {"table": "customer_credit", "idColumn": "c_custkey", "properties": _props("c", "custkey name") | {"credit": "credit"}},
        "Order": {"table": "orders", "idColumn": "o_orderkey", "properties": _ORDER},
    },
    "edges": {
        "IN_REGION": {"table": "nation", "idColumn": "n_nationkey", "outColumn": "n_nationkey", "inColumn": "n_regionkey", "outVertexLabel": "Nation", "inVertexLabel": "Region", "properties": {}},
        "CUSTOMER_IN": {"table": "customer", "idColumn": "c_custkey", "outColumn": "c_custkey", "inColumn": "c_nationkey", "outVertexLabel": "Customer", "inVertexLabel": "Nation", "properties": {}},
        "SUPPLIER_IN": {"table": "supplier", "idColumn": "s_suppkey", "outColumn": "s_suppkey", "inColumn": "s_nationkey", "outVertexLabel": "Supplier", "inVertexLabel": "Nation", "properties": {}},
        "PLACED": {"table": "orders", "idColumn": "o_orderkey", "outColumn": "o_custkey", "inColumn": "o_orderkey", "outVertexLabel": "Customer", "inVertexLabel": "Order", "properties": _ORDER},
        "CONTAINS": {"table": "lineitem", "outColumn": "l_orderkey", "inColumn": "l_partkey", "outVertexLabel": "Order", "inVertexLabel": "Part", "properties": _LINE},
        "SUPPLIED_BY": {"table": "lineitem", "outColumn": "l_partkey", "inColumn": "l_suppkey", "outVertexLabel": "Part", "inVertexLabel": "Supplier", "properties": _LINE},
        "NEXT_ORDER": {"table": "next_order", "idColumn": "o_orderkey", "outColumn": "o_custkey", "inColumn": "next_custkey", "outVertexLabel": "Customer", "inVertexLabel": "Customer", "properties": _props("o", "orderstatus totalprice")},
    },
}


def following(df: DataFrame, key: str, value: str, name: str, bucket: int = LEAD_BUCKET) -> DataFrame:
    """``lead(value) over (order by key)`` for whole-number unique keys, without sorting all rows in one task.

    Rows are ordered within buckets of keys; only each bucket's first row is ordered globally.
    """
    rows = df.withColumn("_b", F.floor(F.col(key) / bucket))
    heads = rows.groupBy("_b").agg(F.min_by(value, key).alias("_head"))
    after = heads.select("_b", F.lead("_head").over(Window.orderBy("_b")).alias("_after"))
    inner = rows.withColumn("_next", F.lead(value).over(Window.partitionBy("_b").orderBy(key)))
    last = Window.partitionBy("_b").orderBy(F.col(key).desc())
    inner = inner.withColumn("_last", F.row_number().over(last) == 1)
    return inner.join(after, "_b").withColumn(name, F.when(F.col("_last"), F.col("_after")).otherwise(F.col("_next"))).drop("_b", "_next", "_after", "_last")


#: The derived table by application and folder: hops read it again and again.
_DERIVED: dict[tuple[str, str], FreshTables] = {}


def reader(spark: SparkSession, sf_dir: str):
    """Tables of a folder, and the derived table of consecutive orders, which is cached for a while."""

    def derived(table: str, datasource: str | None = None) -> DataFrame:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
        return following(orders, "o_orderkey", "o_custkey", "next_custkey").where("next_custkey is not null")

    def read(table: str, datasource: str | None = None) -> DataFrame:
        if table == "next_order":
            key = (spark.sparkContext.applicationId, sf_dir)
            return _DERIVED.setdefault(key, FreshTables(derived, seconds=600)).read(table)
        if table == "customer_credit":  # a column with nulls
            return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", "c_name", "if(c_acctbal >= 0, c_acctbal, null) as credit")
        return spark.read.parquet(f"{sf_dir}/{table}.parquet")

    return read


def engine(spark: SparkSession, sf_dir: str, mapping: Mapping = MAPPING) -> Engine:
    return Engine(spark, dict(mapping), read=reader(spark, sf_dir))
