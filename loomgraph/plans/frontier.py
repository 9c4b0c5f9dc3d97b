"""Least-value propagation along edges: shortest paths, breadth-first search, directed labels.

One loop serves all three. A row of the state is a vertex, its value and whether the value
fell in the last round; only such rows send. Values are least upper bounds throughout, so inserting edges
can restart from an old state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph, endpoints, partitioned
from loomgraph.runtime import checkpointed, discard, written

def propagate_least(graph: Graph, state: DataFrame, message: Column, rounds: int | None = None) -> DataFrame:
    """id, value at the fixpoint of value[dst] = least(value[dst], message over edges), or after ``rounds``.

    ``state`` has id, value, changed, and lacks what is unreached; ``message`` may use src, dst, weight and value. Structs compare field by field.

    Edges are kept by source, and the state by id, both partitioned alike and sorted. So a round merges them where they are and
    shuffles only the least messages of each partition. It ends with a checkpoint in the shared folder, which keeps that partitioning and costs no earlier round where an executor is lost. Without ``rounds``, values that still fall after as many rounds as there are ids raise an error: then a cycle lowers them for ever.
    """
    passing = not graph.stores("out")
    edges = graph.store("out").by("src")
    ids = graph.vertices.select("id").union(endpoints(edges)).distinct()
    start = ids.join(state.select("id", "value", "changed"), "id", "left").select("id", "value", F.coalesce("changed", F.lit(False)).alias("changed"))
    now, _ = checkpointed(partitioned(start, "id"))
    changed, n = now.where("changed").count(), 0
    most = now.count() if rounds is None else rounds
    while changed and n < most:
        active = now.where("changed").select(F.col("id").alias("src"), "value").hint("merge")
        sent = edges.join(active, "src").groupBy(F.col("dst").alias("id")).agg(F.min(message).alias("new"))
        better = F.col("new").isNotNull() & (F.col("value").isNull() | (F.col("new") < F.col("value")))
        joined = now.join(sent.hint("merge"), "id", "left")
        after = joined.select("id", F.when(better, F.col("new")).otherwise(F.col("value")).alias("value"), better.alias("changed"))
        before, (now, changed) = now, checkpointed(after, F.col("changed"))
        discard(before)
        n += 1
    if changed and rounds is None:
        raise ValueError("values fall for ever: the graph has a cycle that lowers them")
    out = written(now.where("value IS NOT NULL").select("id", "value"), "reached")
    discard(now)
    if passing:
        graph.release("out")
    return out


def _from_root(graph: Graph, root: int, value: Column) -> DataFrame:
    return graph.vertices.where(F.col("id") == root).select("id", value.alias("value"), F.lit(True).alias("changed"))


def sssp(graph: Graph, root: int, sentinel: int | None = None, rounds: int | None = None) -> DataFrame:
    """id, distance along out-edges from root; unreached vertices have null, or ``sentinel``. ``rounds`` bounds the number of edges of a path."""
    found = propagate_least(graph, _from_root(graph, root, F.lit(0).cast("long")), F.col("value") + F.col("weight"), rounds)
    distance = F.col("value") if sentinel is None else F.coalesce("value", F.lit(sentinel).cast("long"))
    return graph.vertices.join(found, "id", "left").select("id", distance.alias("distance"))


def _touched(batch: DataFrame) -> DataFrame:
    return batch.select(F.col("src").alias("id")).distinct().withColumn("changed", F.lit(True))


def sssp_after_insert(graph: Graph, distances: DataFrame, batch: DataFrame) -> DataFrame:
    """Distances of ``graph`` (which has the batch already) from those before it: only sources of new edges send first."""
    start = distances.where("distance IS NOT NULL").join(_touched(batch), "id", "left")
    start = start.select("id", F.col("distance").alias("value"), F.coalesce("changed", F.lit(False)).alias("changed"))
    found = propagate_least(graph, start, F.col("value") + F.col("weight"))
    return graph.vertices.join(found, "id", "left").select("id", F.col("value").alias("distance"))


def bfs(graph: Graph, root: int) -> DataFrame:
    """id, depth, parent: the least id among in-neighbours one level up; the root is its own parent; null if unreached."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(root).cast("long").alias("parent"))
    found = propagate_least(graph, _from_root(graph, root, start), _step())
    return graph.vertices.join(found, "id", "left").select("id", "value.depth", "value.parent")


def bfs_after_insert(graph: Graph, levels: DataFrame, batch: DataFrame) -> DataFrame:
    """``bfs`` of ``graph`` (which has the batch already) from its result before the batch."""
    start = levels.where("depth IS NOT NULL").join(_touched(batch), "id", "left")
    start = start.select("id", F.struct("depth", "parent").alias("value"), F.coalesce("changed", F.lit(False)).alias("changed"))
    found = propagate_least(graph, start, _step())
    return graph.vertices.join(found, "id", "left").select("id", "value.depth", "value.parent")


def _step() -> Column:
    return F.struct((F.col("value.depth") + 1).alias("depth"), F.col("src").alias("parent"))


def directed_labels(graph: Graph) -> DataFrame:
    """id, label: the least id that reaches the vertex along out-edges, itself included."""
    start = graph.vertices.select("id", F.col("id").alias("value"), F.lit(True).alias("changed"))
    found = propagate_least(graph, start, F.col("value"))
    return graph.vertices.join(found, "id").select("id", F.col("value").alias("label"))
