"""Edge lists as text: ``src dst [weight]`` split by white space, lines that start with ``#`` are comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import derived_weight
from loomgraph.operators.numbering import placed


def _fields(lines: DataFrame) -> DataFrame:
    """Lines with at least two fields, as src, dst and a weight that may be null."""
    part = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = lines.where(~F.col("value").startswith("#")).select(part.alias("f")).where(F.size("f") >= 2)
    cast = lambda i: F.get("f", F.lit(i)).cast("long")
    return rows.select(cast(0).alias("src"), cast(1).alias("dst"), cast(2).alias("weight"))


def read_weighted(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, weight."""
    return _fields(spark.read.text(path))


def read_unweighted(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """src, dst and a weight in 1..10000 derived from the edge."""
    return _fields(spark.read.text(path)).withColumn("weight", derived_weight(F.col("src"), F.col("dst"), seed))


def read_lines(spark: SparkSession, path: str, start: int, end: int, seed: int = 0) -> DataFrame:
    """The edges on lines [start, end), counted from 0 without comments, in the order of files and lines.

    Lines are counted per split of a file, and a line's number is its place in its split after the lines of the splits before, so no single task gets all lines.
    """
    cut = _placed_lines(spark, path).where((F.col("line") >= start) & (F.col("line") < end))
    return _fields(cut).withColumn("weight", derived_weight(F.col("src"), F.col("dst"), seed))


def _placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line of the lines that are no comments. The position in a split is that of the row in its task, which reads it from its start on."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return placed(lines.where(~F.col("value").startswith("#")), ["file", "block"], [F.col("row")], "line")


def read_headed_pairs(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """A file with a header line and a line ``token E maxSrc maxDst`` before its pairs: (those figures, src and dst)."""
    lines = _placed_lines(spark, path)
    head = [r.value for r in lines.where("line < 2").orderBy("line").collect()]
    figures = dict(zip(("edges", "max_src", "max_dst"), (int(x) for x in head[1].split()[1:4]), strict=False)) if len(head) > 1 else {}
    return figures, _fields(lines.where("line >= 2")).select("src", "dst")


def write_text(edges: DataFrame, path: str) -> None:
    """``src dst weight`` lines."""
    edges.select(F.concat_ws(" ", "src", "dst", "weight").alias("value")).write.text(path)


def first_edges(edges: DataFrame, n: int = 40) -> list[tuple[int, int, int]]:
    """Some ``n`` edges, to look at."""
    return [tuple(r) for r in edges.select("src", "dst", "weight").limit(n).collect()]


def preview(path_lines: DataFrame, n: int = 5) -> dict:
    """The first lines, the last lines and the count of a one-column frame of lines."""
    return {
        "head": [x[0] for x in path_lines.limit(n).collect()],
        "tail": [x[0] for x in path_lines.tail(n)],
        "count": path_lines.count(),
    }
