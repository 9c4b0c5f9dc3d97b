"""Triangle counting by closing wedges over degree-oriented edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph


def _triangles(graph: Graph) -> DataFrame:
    """x, y, z and xy, xz, yz: each triangle of the undirected simple graph once, and of each of its sides which directions exist.

    Sides point to the end of higher (degree, id), which bounds the out-degree by the root of twice the edge count,
    so a hub makes no wedges of its own. Directions are from the lower id to the higher one (up) and back (down).
    """
    e = _sides(graph)
    d = e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    e = e.join(d.select(F.col("id").alias("src"), F.col("d").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("d").alias("dd")), "dst")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    e = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("y"), F.col("way").alias("xy"))
    wedges = e.join(e.withColumnsRenamed({"y": "z", "xy": "xz"}), "x").where("y <> z")
    return wedges.join(e.withColumnsRenamed({"y": "z", "x": "y", "xy": "yz"}), ["y", "z"])


def triangle_count(graph: Graph) -> DataFrame:
    """One row, triangles."""
    return _triangles(graph).agg(F.count("*").alias("triangles"))


def triangles_per_vertex(graph: Graph) -> DataFrame:
    """id, n: how many triangles each vertex is part of, 0 included."""
    counted = _triangles(graph).select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return graph.vertices.join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def directed_triangle_count(graph: Graph) -> DataFrame:
    """One row, triangles: distinct p3 < p1 < p2 with edges p1 to p2, p1 to p3 and p2 to p3.

    So of the triangles of the undirected graph those count of which the side without the least id goes up and the others go down.
    """

    def side(way: str, a: str, b: str, other: str):
        return F.when((F.col(other) < F.col(a)) & (F.col(other) < F.col(b)), F.col(f"{way}.up")).otherwise(F.col(f"{way}.down"))

    counted = _triangles(graph).where(side("xy", "x", "y", "z") & side("xz", "x", "z", "y") & side("yz", "y", "z", "x"))
    return counted.agg(F.count("*").alias("triangles"))


def _sides(graph: Graph) -> DataFrame:
    """src < dst, way: the undirected simple edges and which directions of each exist."""
    ways = graph.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("rises"))
    return ways.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.struct(F.bool_or("rises").alias("up"), F.bool_or(~F.col("rises")).alias("down")).alias("way"))
