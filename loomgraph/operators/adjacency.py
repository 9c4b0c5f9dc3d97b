"""Degrees, neighbours, edge existence and k-hop: joins of vertices with edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph


def degrees(graph: Graph, direction: str = "out") -> DataFrame:
    """id, degree of every vertex; duplicates and self-loops count."""
    key = {"out": "src", "in": "dst"}[direction]
    counted = graph.edges.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("degree"))
    return graph.vertices.join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def neighbors(graph: Graph, vertex: int, direction: str = "out") -> DataFrame:
    """neighbor: the bag of ids next to one vertex; the filter reaches the edge scan."""
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    return graph.edges.where(F.col(here) == vertex).select(F.col(there).alias("neighbor"))


def neighbor_lists(graph: Graph, direction: str = "out", most: int = 100_000) -> DataFrame:
    """id, part, neighbors: sorted arrays, for vertices that have any. A list that is longer than ``most`` is in several rows, by a hash of the neighbour, so that no
    row holds a whole hub; ``most`` bounds them up to the chance of hashes and to repeated neighbours."""
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    e = graph.edges.select(F.col(here).alias("id"), F.col(there).alias("near"))
    large = e.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("id", F.ceil(F.col("n") / most).alias("parts"))
    e = e.join(large, "id", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("near"), F.col("parts")), F.lit(0)).cast("int"))
    return e.groupBy("id", "part").agg(F.sort_array(F.collect_list("near")).alias("neighbors"))


def edges_exist(graph: Graph, queries: DataFrame) -> DataFrame:
    """Each query row (src, dst) with found; repeated queries stay, and a null id is never found."""
    there = graph.edges.select("src", "dst").distinct().withColumn("found", F.lit(True))
    return queries.select("src", "dst").join(there, ["src", "dst"], "left").select("src", "dst", F.coalesce("found", F.lit(False)).alias("found"))


def random_sources(graph: Graph, one_in: int = 20, seed: int = 0) -> DataFrame:
    """id of about one vertex in ``one_in``, by a hash of id and seed, so reruns agree."""
    return graph.vertices.where(F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(one_in)) == 0).select("id")


def k_hop(graph: Graph, sources: DataFrame, k: int, distinct: bool = False) -> DataFrame:
    """vertex: ends of the k-step walks from ``sources(id)``. A bag unless ``distinct``, which dedupes each step."""
    walk = sources.select(F.col("id").alias("vertex"))
    steps = graph.edges.select(F.col("src").alias("vertex"), F.col("dst").alias("next"))
    for _ in range(k):
        walk = walk.join(steps, "vertex").select(F.col("next").alias("vertex"))
        walk = walk.distinct() if distinct else walk
    return walk


def active_edges(graph: Graph, frontier: DataFrame) -> DataFrame:
    """One row: active_edges (sum of the frontier's out-degrees) and sparse (fewer than a twentieth of all edges)."""
    marked = graph.edges.join(frontier.select(F.col("id").alias("src")).distinct().withColumn("on", F.lit(True)), "src", "left")
    active = F.count_if("on")
    return marked.agg(active.alias("active_edges"), (active * 20 < F.count("*")).alias("sparse"))


def common_neighbors(graph: Graph, pairs: DataFrame, direction: str = "out") -> DataFrame:
    """a, b, common per distinct row of ``pairs(a, b)``: how many vertices are next to both; 0 included."""
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    near = graph.edges.select(F.col(here).alias("id"), F.col(there).alias("near")).distinct()
    asked = pairs.select("a", "b").distinct()
    of = lambda c: near.withColumnRenamed("id", c)
    found = asked.join(of("a"), "a").join(of("b"), ["b", "near"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    return asked.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("common", F.lit(0).cast("long")).alias("common"))
