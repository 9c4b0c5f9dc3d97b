"""Insertions: bag unions. Edge counts are always derived from the edges, never stored."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import log2_up
from loomgraph.graph import EDGE_SCHEMA, Graph, endpoints
from loomgraph.operators.numbering import numbered
from loomgraph.runtime import written
from loomgraph.sources.edge_text import read_lines
from loomgraph.sources.rmat import rmat_edges


def insert_edges(graph: Graph, batch: DataFrame) -> Graph:
    """The graph with the batch added; a batch without weights gets 0, and unknown endpoints become vertices."""
    weight = F.col("weight") if "weight" in batch.columns else F.lit(0)
    rows = batch.where("src IS NOT NULL AND dst IS NOT NULL").select(
        F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.cast("long").alias("weight")
    )
    vertices = graph.vertices.union(endpoints(rows)).distinct()
    return Graph(vertices, graph.edges.unionByName(rows))


def insert_edge(graph: Graph, src: int, dst: int, weight: int = 0) -> Graph:
    return insert_edges(graph, graph.edges.sparkSession.createDataFrame([(src, dst, weight)], EDGE_SCHEMA))


def insert_lines(graph: Graph, path: str, start: int, end: int) -> Graph:
    """The graph with the edges on lines [start, end) of a text file added, see ``read_lines``; their weight is 0."""
    return insert_edges(graph, read_lines(graph.edges.sparkSession, path, start, end).select("src", "dst"))


def split_edges(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n edges in (src, dst, weight) order, and the rest; together they are the edges as a bag."""
    rows = numbered(edges.select("src", "dst", "weight"), ["src", "dst", "weight"], "place")
    return rows.where(F.col("place") < n).drop("place"), rows.where(F.col("place") >= n).drop("place")


def unit_weights(edges: DataFrame) -> DataFrame:
    """The edges, all with weight 1."""
    return edges.select("src", "dst", F.lit(1).cast("long").alias("weight"))


def insert_trials(graph: Graph, batch_size: int, trials: int = 20, seed: int = 0) -> tuple[Graph, DataFrame]:
    """The graph after ``trials`` batches of recursive-matrix edges, and per batch trial, edges (of the graph so far), seconds, edges_per_second.

    Batches accumulate in a table of one folder each, so a batch costs what it has. Ids are below the least power of 2 that all vertices are below.
    """
    spark = graph.edges.sparkSession
    n = 1 << log2_up(int(graph.vertices.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) + 1)
    grown, total, rows = graph, graph.edges.count(), []
    for trial in range(trials):
        began = time.perf_counter()
        batch = rmat_edges(spark, batch_size, n, seed + trial).sort("src", "dst")
        batch = written(batch.withColumn("weight", F.lit(0).cast("long")), "batch")
        took = time.perf_counter() - began
        total += batch_size
        grown = Graph(grown.vertices, grown.edges.unionByName(batch))
        rows.append((trial, total, took, batch_size / took))
    vertices = grown.vertices.union(spark.range(n)).distinct() if trials else grown.vertices
    return Graph(vertices, grown.edges), spark.createDataFrame(rows, "trial int, edges long, seconds double, edges_per_second double")


def delete_edges(graph: Graph, batch: DataFrame) -> Graph:
    """The graph without any edge whose (src, dst) is in the batch."""
    return Graph(graph.vertices, graph.edges.join(batch.select("src", "dst").distinct(), ["src", "dst"], "left_anti"))
