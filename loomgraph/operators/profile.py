"""Degree statistics, hubs and dense renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import derived_weight
from loomgraph.graph import Graph, endpoints
from loomgraph.operators.adjacency import degrees
from loomgraph.operators.numbering import numbered

HUB_DEGREE = 14


def degree_stats(graph: Graph) -> DataFrame:
    """One row: v, e, avg_degree, median_degree, lower_median_degree, max_degree, min_degree over vertices that occur in an edge.

    The median is the upper one, at 0-based place v div 2 of the ascending out-degrees; the lower one, at the place before, is given for odd v only. Both are read off
    the degree histogram, which has a row per distinct degree, not per vertex. Without edges v and e are 0 and the others null.
    """
    d = degrees(Graph(endpoints(graph.edges), graph.edges))
    histogram = d.groupBy("degree").agg(F.count("*").alias("n"))
    rows = F.sort_array(F.collect_list(F.struct("degree", "n")))
    one = histogram.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("v"), F.coalesce(F.sum(F.col("degree") * F.col("n")), F.lit(0)).cast("long").alias("e"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"), rows.alias("rows")
    )
    def at(place: str) -> Column:
        return F.expr(
            "aggregate(rows, named_struct('seen', 0L, 'found', cast(null as bigint)), "
            f"(s, x) -> named_struct('seen', s.seen + x.n, 'found', if(s.found is null and s.seen + x.n > {place}, x.degree, s.found))).found"
        )

    lower = F.when((F.col("v") % 2 == 1) & (F.col("v") > 1), at("v div 2 - 1"))
    return one.select("v", "e", (F.col("e") / F.nullif("v", F.lit(0))).alias("avg_degree"), at("v div 2").alias("median_degree"), lower.alias("lower_median_degree"), "max_degree", "min_degree")


def hub_vertices(graph: Graph, threshold: int = HUB_DEGREE) -> DataFrame:
    """id of vertices with more than ``threshold`` out-edges."""
    counted = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return counted.where(F.col("degree") > threshold).select("id")


def hub_histogram(graph: Graph, threshold: int = HUB_DEGREE) -> DataFrame:
    """bucket (hub or other), n."""
    bucket = F.when(F.col("degree") > threshold, "hub").otherwise("other")
    return degrees(graph).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def hub_ratio(graph: Graph, threshold: int = HUB_DEGREE) -> DataFrame:
    """One row: hubs, others, ratio (hubs among all vertices; null without vertices)."""
    hubs = F.count_if(F.col("degree") > threshold)
    return degrees(graph).agg(hubs.alias("hubs"), (F.count("*") - hubs).alias("others"), (hubs / F.nullif(F.count("*"), F.lit(0))).alias("ratio"))


def dense_ids(edges: DataFrame) -> DataFrame:
    """id, new_id: the sorted distinct endpoints as 0..V'-1."""
    return numbered(endpoints(edges), ["id"], "new_id")


def vertex_remap(edges: DataFrame, unweighted: bool = False, seed: int = 0) -> DataFrame:
    """The edges over dense ids; ``unweighted`` derives weights from the new ids."""
    ids = dense_ids(edges)
    src = ids.select(F.col("id").alias("src"), F.col("new_id").alias("new_src"))
    dst = ids.select(F.col("id").alias("dst"), F.col("new_id").alias("new_dst"))
    out = edges.join(src, "src").join(dst, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "weight")
    return out.withColumn("weight", derived_weight(F.col("src"), F.col("dst"), seed)) if unweighted else out
