"""Synchronous label propagation over 15 labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.runtime import Rounds

LABELS = 15


def label_propagation(graph: Graph, rounds: int = 2, votes_from: str = "out") -> DataFrame:
    """id, label after ``rounds``.

    Labels start at id % 15 + 1. In a round each vertex takes the commonest label among its out-neighbours
    (in-neighbours with ``votes_from="in"``), counted with multiplicity; ties go to the smallest label, a vertex without votes
    takes label 1, and vertex 0 keeps its own.
    """
    voter, teller = ("src", "dst") if votes_from == "out" else ("dst", "src")
    pairs = graph.edges.groupBy(F.col(voter).alias("id"), F.col(teller).alias("told")).agg(F.count("*").alias("n"))
    pairs = pairs.repartition("told").persist()
    state = graph.vertices.select("id", (F.col("id") % LABELS + 1).cast("int").alias("label"))
    kept = Rounds()
    for _ in range(rounds):
        votes = pairs.join(state.withColumnRenamed("id", "told"), "told").groupBy("id", "label").agg(F.sum("n").alias("n"))
        best = votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))
        state = graph.vertices.join(best, "id", "left").select("id", F.when(F.col("id") == 0, F.lit(1)).otherwise(F.coalesce("label", F.lit(1))).cast("int").alias("label"))
        state = kept.keep(state)
    pairs.unpersist()
    kept.release(state)
    return state
