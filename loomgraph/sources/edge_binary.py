"""Edge lists as flat little-endian int32 records: triples (src, dst, weight) or pairs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import derived_weight
from loomgraph.sources import edge_text


def _records(spark: SparkSession, path: str, width: int) -> DataFrame:
    """hex: the records of the files below the path. Files are split at record bounds, so one large file is read by many tasks; nothing passes through Python."""
    records = spark.sparkContext._jsc.binaryRecords(path, 4 * width).rdd()
    made = spark._jsparkSession.createDataset(records, spark._jvm.org.apache.spark.sql.Encoders.BINARY())
    return DataFrame(made.toDF(), spark).select(F.hex("value").alias("hex"))


def _field(k: int) -> Column:
    """The k-th int32 of a record."""
    turned = F.concat(*[F.substring("hex", 8 * k + 2 * b + 1, 2) for b in (3, 2, 1, 0)])
    unsigned = F.conv(turned, 16, 10).cast("long")
    return F.when(unsigned >= 2**31, unsigned - 2**32).otherwise(unsigned)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, weight."""
    return _records(spark, path, 3).select(*[_field(k).alias(n) for k, n in enumerate(("src", "dst", "weight"))])


def read_pairs(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """src, dst and a weight in 1..10000 derived from the edge."""
    pairs = _records(spark, path, 2).select(_field(0).alias("src"), _field(1).alias("dst"))
    return pairs.withColumn("weight", derived_weight(F.col("src"), F.col("dst"), seed))


def write_binary(edges: DataFrame, path: str, weighted: bool = True) -> int:
    """Writes part files of records to ``path`` (a local path or any URI that pyarrow knows), which must be new or an empty folder, and returns their number.

    Each task writes a file of its own name in a folder of this call; the files of the attempts that count are then moved to ``path``, and that folder goes with what failed or
    repeated attempts left in it. Nothing else is ever deleted.
    """
    from pyarrow import fs

    names = ["src", "dst", "weight"][: 3 if weighted else 2]
    trial = f"_trial-{uuid.uuid4().hex}"

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(path)
        name = f"part-{uuid.uuid4().hex}.bin"
        n = 0
        with store.open_output_stream(f"{root}/{trial}/{name}") as out:
            for f in frames:
                out.write(f[names].to_numpy().astype("<i4").tobytes())
                n += len(f)
        if n:
            yield pd.DataFrame({"name": [name], "n": [n]})

    store, root = _store(path)
    if store.get_file_info(root).type != fs.FileType.NotFound and store.get_file_info(fs.FileSelector(root)):
        raise FileExistsError(f"{path} is not empty")
    store.create_dir(f"{root}/{trial}", recursive=True)
    try:
        kept = [x.name for x in edges.select(*names).mapInPandas(write, "name string, n long").collect()]
        for name in kept:
            store.move(f"{root}/{trial}/{name}", f"{root}/{name}")
    finally:
        store.delete_dir(f"{root}/{trial}")
    return len(kept)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def convert_text(spark: SparkSession, source: str, target: str, kind: str = "weighted", seed: int = 0) -> int:
    """Text edges to binary records, and the number of files: "weighted" triples, "unweighted" pairs, "derived" pairs with derived weights, or "headed" pairs after two lines."""
    if kind == "headed":
        return write_binary(edge_text.read_headed_pairs(spark, source)[1], target, weighted=False)
    read = edge_text.read_weighted(spark, source) if kind == "weighted" else edge_text.read_unweighted(spark, source, seed)
    return write_binary(read, target, weighted=kind != "unweighted")
