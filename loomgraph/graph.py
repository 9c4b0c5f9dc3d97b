"""The graph: an implicit vertex set and a bag of directed weighted edges."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE_SCHEMA = T.StructType(
    [T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("weight", T.LongType())]
)
#: Columns that a stored direction is partitioned by.
MODES = {"out": ("src",), "in": ("dst",), "both": ("src", "dst")}
VERTEX_SCHEMA = T.StructType([T.StructField("id", T.LongType())])


def _long(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


@dataclass(frozen=True)
class Graph:
    """``vertices(id)`` and ``edges(src, dst, weight)``.

    The edges are a bag: duplicates and self-loops stay, and degrees count them. Vertices without
    an edge exist as rows of ``vertices`` only.
    """

    vertices: DataFrame
    edges: DataFrame
    _adjacency: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)

    @staticmethod
    def of(edges: DataFrame, vertices: DataFrame | None = None) -> "Graph":
        """A graph from any frame with src and dst (and weight, else 0).

        Rows whose src or dst is null are no edges. Without ``vertices`` the endpoints are the vertex set.
        """
        weight = F.col("weight") if "weight" in edges.columns else F.lit(0)
        e = edges.select(*_long(edges, "src", "dst"), weight.cast("long").alias("weight")).where("src IS NOT NULL AND dst IS NOT NULL")
        v = endpoints(e) if vertices is None else vertices.select(*_long(vertices, "id")).where("id IS NOT NULL").distinct()
        return Graph(v, e)

    @staticmethod
    def dense(spark: SparkSession, n: int, edges: DataFrame) -> "Graph":
        """Vertices 0..n-1, isolated ones included."""
        return Graph.of(edges, spark.range(n))

    def store(self, mode: str = "out") -> "Graph":
        """Keeps the edges by source ("out"), by target ("in") or both, partitioned and sorted, in executors' memory and disk.

        What runs on the graph from then on joins these without moving an edge. They are rebuilt from the source where an executor is lost.
        """
        for key in MODES[mode]:
            if key not in self._adjacency:
                self._adjacency[key] = partitioned(self.edges, key).persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def release(self, mode: str = "both") -> None:
        """Gives up what ``store`` keeps."""
        for key in MODES[mode]:
            if kept := self._adjacency.pop(key, None):
                kept.unpersist()

    def by(self, key: str) -> DataFrame:
        """The edges, stored by this key if they are, else as they are."""
        return self._adjacency.get(key, self.edges)

    def stores(self, mode: str) -> bool:
        return all(key in self._adjacency for key in MODES[mode])

    def reverse(self) -> "Graph":
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))

    def symmetric(self) -> "Graph":
        """Distinct (src, dst) of the edges and their reverses, weight 0."""
        both = self.edges.select("src", "dst").union(self.edges.select("dst", "src"))
        return Graph(self.vertices, both.distinct().withColumn("weight", F.lit(0).cast("long")))

    def simple(self) -> DataFrame:
        """Undirected simple edges: src < dst, no duplicates or self-loops."""
        return self.edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()

    def unknown_endpoints(self) -> DataFrame:
        """Ids that an edge names and the vertex set lacks."""
        return endpoints(self.edges).join(self.vertices, "id", "left_anti")


def partitioned(df: DataFrame, key: str) -> DataFrame:
    """By a column, in a number of partitions that stays as it is, and sorted in each. Joins on the column of two such frames need no shuffle."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key)


def fresh_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it no column's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct ids that occur in an edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
