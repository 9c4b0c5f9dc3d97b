"""Un-normalised PageRank over a fixed number of iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.runtime import Rounds

DAMPING = 0.85
#: Iterations that one plan unrolls before the state is kept.
UNROLL = 5


def shares(graph: Graph, by: str = "out") -> DataFrame:
    """src, dst, share: the part of src's rank that goes to dst, duplicates summed.

    ``by`` names the degree that divides a rank. With "out" a vertex hands out all it has; "in" divides by its
    in-degree, and a vertex without in-edges hands out nothing.
    """
    key = {"out": "src", "in": "dst"}[by]
    degree = graph.edges.groupBy(F.col(key).alias("src")).agg(F.count("*").alias("degree"))
    pairs = graph.edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return pairs.join(degree, "src").select("src", "dst", (F.col("n") / F.col("degree")).alias("share"))


def _step(vertices: DataFrame, share: DataFrame, state: DataFrame) -> DataFrame:
    """The columns of ``vertices`` and the new rank."""
    got = share.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
    rank = (1 - DAMPING) + DAMPING * F.coalesce("got", F.lit(0.0))
    return vertices.join(got, "id", "left").select(*vertices.columns, rank.alias("rank"))


def _stored(graph: Graph, by: str, degree: bool = False) -> tuple[DataFrame, DataFrame]:
    """Shares and vertices, kept by the key that they join on."""
    vertices = graph.vertices.select("id")
    if degree:
        counted = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        vertices = vertices.join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))
    return shares(graph, by).repartition("src").persist(), vertices.repartition("id").persist()


def pagerank(graph: Graph, iterations: int = 10, by: str = "out", tol: float | None = None) -> DataFrame:
    """id, rank. Starts at 1; the mass of dangling vertices is dropped; isolated vertices end at 0.15.

    Shares and vertices are cached by the key they join on, so an iteration shuffles partial sums only. With ``tol`` it ends early, after the first iteration
    whose delta (see ``pagerank_delta``) is at most that.
    """
    if tol is not None:
        return _until(graph, iterations, by, tol)[0]
    share, vertices = _stored(graph, by)
    state = vertices.withColumn("rank", F.lit(1.0))
    kept = Rounds()
    for i in range(1, iterations + 1):
        state = _step(vertices, share, state)
        if i % UNROLL == 0 and i < iterations:
            state = kept.keep(state)
    out = kept.keep(state)
    kept.release(out)
    share.unpersist()
    vertices.unpersist()
    return out


def _until(graph: Graph, iterations: int, by: str, tol: float | None) -> tuple[DataFrame, list[tuple[int, float]]]:
    """id and rank, and the delta of each iteration, which the job that writes its table sums up."""
    share, vertices = _stored(graph, by, degree=True)
    kept, rows = Rounds(), []
    state = kept.keep(vertices.withColumn("rank", F.lit(1.0)))
    for i in range(1, iterations + 1):
        new = _step(vertices, share, state).join(state.select("id", F.col("rank").alias("old")), "id")
        seen = Observation()
        change = F.sum(F.abs(F.col("rank") - F.col("old")) * F.col("degree"))
        state = kept.keep(new.observe(seen, change.alias("s"), F.count("*").alias("v")).drop("old"))
        rows.append((i, float(seen.get["s"] or 0) / max(1, seen.get["v"])))
        if tol is not None and rows[-1][1] <= tol:
            break
    kept.release(state)
    for x in (share, vertices):
        x.unpersist()
    return state.select("id", "rank"), rows


def pagerank_delta(graph: Graph, iterations: int = 10) -> DataFrame:
    """iter, delta: the mean over vertices of abs(new - old) * out-degree at each iteration."""
    return graph.vertices.sparkSession.createDataFrame(_until(graph, iterations, "out", None)[1], "iter int, delta double")
