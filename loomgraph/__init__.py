"""Loomgraph: analytics on dynamic directed weighted multigraphs, as Spark DataFrames."""

from loomgraph.graph import EDGE_SCHEMA, Graph

__all__ = ["EDGE_SCHEMA", "Graph"]
