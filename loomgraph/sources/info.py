"""Dataset descriptors: three lines ``V E``, a data path, and ``1`` if the data is binary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from loomgraph.graph import Graph
from loomgraph.operators.updates import unit_weights
from loomgraph.sources import edge_binary, edge_text


@dataclass(frozen=True)
class Info:
    vertices: int
    edges: int
    path: str | None = None
    binary: bool = False


def read_info(spark: SparkSession, path: str) -> Info:
    """One line gives the counts only."""
    lines = [x.value.strip() for x in spark.read.text(path).collect() if x.value.strip()]
    v, e = map(int, lines[0].split()[:2])
    return Info(v, e, lines[1] if len(lines) > 1 else None, lines[2:3] == ["1"])


def load_graph(spark: SparkSession, path: str, mode: str | None = None, unit: bool = False) -> Graph:
    """The graph that a descriptor names; vertices are 0..V-1. The edge count is never trusted, only V is.

    ``mode`` ("out", "in" or "both") stores the edges by these directions at once, see ``Graph.store``; ``unit`` gives all the weight 1.
    """
    info = read_info(spark, path)
    read = edge_binary.read_triples if info.binary else edge_text.read_weighted
    edges = read(spark, info.path)
    graph = Graph.dense(spark, info.vertices, unit_weights(edges) if unit else edges)
    return graph.store(mode) if mode else graph
