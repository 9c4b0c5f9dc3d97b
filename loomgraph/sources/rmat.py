"""Recursive-matrix edges as column expressions: each edge falls through log2(n) quadrants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import log2_up, uniform


def rmat_edges(spark: SparkSession, count: int, n: int, seed: int = 0, a: float = 0.5, b: float = 0.1, c: float = 0.1, legacy_scale: bool = False) -> DataFrame:
    """``count`` pairs (src, dst) over ids 0..n-1; n must be a power of 2 and a + b + c at most 1.

    ``legacy_scale`` halves a, b and c, which is what a generator on [0, 2) amounts to.
    """
    if n < 1 or n & (n - 1):
        raise ValueError("n must be a power of 2")
    if min(a, b, c) < 0 or a + b + c > 1:
        raise ValueError("a, b and c must not be negative, and a + b + c at most 1")
    if legacy_scale:
        a, b, c = a / 2, b / 2, c / 2
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for level in range(log2_up(n)):
        u = uniform(F.col("id"), F.lit(seed), F.lit(level))
        low = F.lit(n >> (level + 1)).cast("long")
        src = src + F.when(u >= a + b, low).otherwise(0)
        dst = dst + F.when((u >= a) & (u < a + b) | (u >= a + b + c), low).otherwise(0)
    return spark.range(count).select(src.alias("src"), dst.alias("dst"))


def query_edges(spark: SparkSession, vertices: int, edges: int, seed: int = 100) -> DataFrame:
    """edges / 20 pairs over 2 ** (ceil(log2 vertices) - 1) ids, the workload of the edge query."""
    return rmat_edges(spark, edges // 20, 1 << max(0, log2_up(vertices) - 1), seed)
