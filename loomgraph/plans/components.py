"""Weakly connected components by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.runtime import Rounds


def component_labels(links: DataFrame) -> DataFrame:
    """id, label for every endpoint of ``links(a, b)``: the least id of its component.

    A round hooks each vertex to its least neighbour if that is smaller, follows these pointers to
    their roots by doubling, and replaces endpoints by roots. What stays are links between roots, at most half
    as many vertices, so there are few rounds; each is joins and grouped minima, and no task needs a whole
    component. Tables between rounds are written to the shared folder.
    """
    ends, labelled, pointers = Rounds(), Rounds(), Rounds()
    live = links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    live, n = ends.keep_counting(live, F.col("a") != F.col("b"))
    labels = live.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id"))
    live = live.where("a <> b")
    if not n:
        return labels
    while n:
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("up"))
        hooks, moved = pointers.keep(hooks), 1
        while moved:  # two doublings to a written table
            nxt, moved = pointers.keep_counting(_doubled(_doubled(hooks)), F.col("moved"))
            hooks = nxt.select("id", "up")
        labels = labels.join(hooks.withColumnRenamed("id", "label"), "label", "left").select("id", F.coalesce("up", "label").alias("label"))
        labels = labelled.keep(labels)
        a = hooks.select(F.col("id").alias("a"), F.col("up").alias("ra"))
        b = hooks.select(F.col("id").alias("b"), F.col("up").alias("rb"))
        live = live.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        live, n = ends.keep_counting(live.distinct(), F.lit(True))
    for rounds in (ends, pointers, labelled):
        rounds.release(labels)
    return labels


def _doubled(hooks: DataFrame) -> DataFrame:
    """id, up, moved: each pointer replaced by its target's."""
    over = hooks.select(F.col("id").alias("up"), F.col("up").alias("over"))
    return hooks.join(over, "up").select("id", F.col("over").alias("up"), (F.col("over") != F.col("up")).alias("moved"))


def weak_components(graph: Graph) -> DataFrame:
    """id, label of every vertex; an isolated vertex is its own."""
    found = component_labels(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return graph.vertices.join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def components_after_insert(graph: Graph, labels: DataFrame, batch: DataFrame) -> DataFrame:
    """``weak_components`` of ``graph`` (which has the batch already) from the labels before: only the batch's edges, between old components, are contracted."""
    old = labels.select("id", "label")
    of = lambda c, name: old.select(F.col("id").alias(c), F.col("label").alias(name))
    links = batch.select("src", "dst").join(of("src", "a"), "src", "left").join(of("dst", "b"), "dst", "left")
    found = component_labels(links.select(F.coalesce("a", "src").alias("a"), F.coalesce("b", "dst").alias("b")).distinct())
    placed = graph.vertices.join(old, "id", "left").select("id", F.coalesce("label", "id").alias("old"))
    return placed.join(found.select(F.col("id").alias("old"), "label"), "old", "left").select("id", F.coalesce("label", "old").alias("label"))


def component_sizes(labels: DataFrame) -> DataFrame:
    """label, n."""
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def component_count(labels: DataFrame) -> DataFrame:
    """One row, components."""
    return labels.agg(F.countDistinct("label").alias("components"))
