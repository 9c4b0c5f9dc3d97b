"""Edge streams into a table of one folder per batch, and running degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from loomgraph.graph import EDGE_SCHEMA, Graph
from loomgraph.plans.frontier import sssp, sssp_after_insert


def edge_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of src, dst, weight that arrive below ``path``."""
    reader = spark.readStream.schema(EDGE_SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def write_batch(batch: DataFrame, batch_id: int, table: str) -> None:
    """Overwrites the folder of this batch, so that a replay changes nothing."""
    batch.select("src", "dst", F.coalesce("weight", F.lit(0)).cast("long").alias("weight")).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")


def stream_insert(edges: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream to ``table``; call processAllAvailable() or awaitTermination() on the result."""
    return edges.writeStream.foreachBatch(lambda df, i: write_batch(df, i, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, table: str, upto: int | None = None) -> DataFrame:
    """The edges that have arrived, as a bag; with ``upto`` those of batches up to that one."""
    rows = spark.read.schema("src long, dst long, weight long, batch_id int").parquet(table)
    return (rows if upto is None else rows.where(F.col("batch_id") <= upto)).select("src", "dst", "weight")


def stream_distances(edges: DataFrame, table: str, results: str, checkpoint: str, vertices: DataFrame, root: int) -> StreamingQuery:
    """As ``stream_insert``, and after each batch the shortest distances on the graph so far, one folder of ``results`` per batch.

    A batch starts from the distances of the batch before, and only the sources of its edges send first. Both folders of a batch are overwritten when it is replayed.
    """

    def step(batch: DataFrame, i: int) -> None:
        spark = batch.sparkSession
        write_batch(batch, i, table)
        arrived = spark.read.schema("src long, dst long, weight long").parquet(f"{table}/batch_id={i}")
        grown = Graph.of(snapshot(spark, table, i), vertices)
        try:
            before = spark.read.schema("id long, distance long").parquet(f"{results}/batch_id={i - 1}") if i else None
        except AnalysisException:
            before = None
        found = sssp(grown, root) if before is None else sssp_after_insert(grown, before, arrived)
        found.write.mode("overwrite").parquet(f"{results}/batch_id={i}")

    return edges.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_degrees(edges: DataFrame) -> DataFrame:
    """id, degree of the streamed sources; for output mode complete or update."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
