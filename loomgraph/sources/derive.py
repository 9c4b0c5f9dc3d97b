"""Graphs derived from relational order tables; ``part`` keys 0..N-1 are the vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import Graph


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").cast("long").alias("id"))


def co_order_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive lines of an order link their parts; the smaller quantity is the weight. A bag join."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    a = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"), F.col("l_quantity").alias("q"))
    joined = a.join(lines, ["l_orderkey", "l_linenumber"]).where(F.col("src") != F.col("l_partkey"))
    weight = F.least("q", "l_quantity").cast("long")
    return joined.select(F.col("src").cast("long"), F.col("l_partkey").cast("long").alias("dst"), weight.alias("weight"))


def co_order(spark: SparkSession, folder: str) -> Graph:
    return Graph(parts(spark, folder), co_order_edges(spark, folder))


def sparse(spark: SparkSession, folder: str, least: int = 35) -> Graph:
    """The co-order edges of weight ``least`` or more: dangling and isolated vertices, many components."""
    return Graph(parts(spark, folder), co_order_edges(spark, folder).where(F.col("weight") >= least))


def bipartite(spark: SparkSession, folder: str) -> Graph:
    """Customers 0..C-1 to suppliers C.. by the lines of their orders."""
    customers = table(spark, folder, "customer").count()
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    e = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    dst = (F.col("l_suppkey") + F.lit(customers)).cast("long")
    e = e.select(F.col("o_custkey").cast("long").alias("src"), dst.alias("dst"), F.lit(0).cast("long").alias("weight"))
    return Graph.dense(spark, customers + table(spark, folder, "supplier").count(), e)
