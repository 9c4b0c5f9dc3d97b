"""Vertex maps, edge messages and the loop over them, all with Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.runtime import Rounds


def process_vertices(state: DataFrame, value: Column, active: DataFrame | None = None) -> DataFrame:
    """One row, total: the sum of ``value`` over ``state(id, ...)``, or over its rows that ``active(id)`` names."""
    rows = state if active is None else state.join(active.select("id"), "id", "left_semi")
    return rows.agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("total"))


def aggregate_messages(graph: Graph, state: DataFrame, message: Column, combine: Callable[[Column], Column], to: str = "dst", active: DataFrame | None = None) -> DataFrame:
    """id, value: messages along the edges, combined at the receiver.

    ``message`` may use src, dst, weight and the sender's columns of ``state(id, ...)``; senders without a
    state row send nothing, nor do those that ``active(id)``, where given, doesn't name, and null messages. Stored edges stay where they are.
    """
    sender = "src" if to == "dst" else "dst"
    senders = state if active is None else state.join(active.select("id").distinct(), "id", "left_semi")
    sent = graph.by(sender).join(senders.withColumnRenamed("id", sender), sender).select(F.col(to).alias("id"), message.alias("m"))
    return sent.where("m IS NOT NULL").groupBy("id").agg(combine(F.col("m")).alias("value"))


def pregel(graph: Graph, state: DataFrame, message: Column, combine: Callable[[Column], Column], update: Callable[[Column], dict[str, Column]], rounds: int, until: Column | None = None, to: str = "dst", sends: Column | None = None) -> DataFrame:
    """Repeats: send, combine, update.

    ``update`` gets the combined value (null without messages) and returns the new state columns. Ends
    after ``rounds``, or once no row satisfies ``until``, a condition on the new state. Where ``sends`` is given, only rows that satisfy it send.
    """
    kept = Rounds()
    for _ in range(rounds):
        got = aggregate_messages(graph, state if sends is None else state.where(sends), message, combine, to).withColumnRenamed("value", "_value")
        joined = state.join(got, "id", "left")
        new = joined.select("id", *[c.alias(n) for n, c in update(F.col("_value")).items()])
        state, live = kept.keep_counting(new, F.lit(True) if until is None else until)
        if not live:
            break
    return state


class VertexSet:
    """A set of vertex ids, and the operations on it; every result is a set again."""

    def __init__(self, ids: DataFrame):
        self.ids = ids.select("id").where("id IS NOT NULL").distinct()

    @staticmethod
    def none(graph: Graph) -> "VertexSet":
        return VertexSet(graph.vertices.limit(0))

    @staticmethod
    def all(graph: Graph) -> "VertexSet":
        return VertexSet(graph.vertices)

    def with_ids(self, ids: DataFrame) -> "VertexSet":
        return VertexSet(self.ids.unionByName(ids.select("id")))

    def without_ids(self, ids: DataFrame) -> "VertexSet":
        return VertexSet(self.ids.join(ids.select("id").distinct(), "id", "left_anti"))

    def both(self, other: "VertexSet") -> "VertexSet":
        return VertexSet(self.ids.join(other.ids, "id", "left_semi"))

    def has(self, asked: DataFrame) -> DataFrame:
        """Each row of ``asked(id)`` with found; null is in no set."""
        marked = self.ids.withColumn("found", F.lit(True))
        return asked.select("id").join(marked, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))
