"""Where intermediate tables go, and how iterative jobs cut their lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session has none and runs in one process (a local test) a temporary folder becomes it; a cluster must name one, as
    machines don't see each other's folders.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="loomgraph-")
        sc.setCheckpointDir(path)
    return path


_LEAVING: set[str] = set()


def _folder(spark: SparkSession) -> str:
    """This application's folder in the shared one. What is left in it goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/loomgraph/{spark.sparkContext.applicationId}"
    if path not in _LEAVING:
        _LEAVING.add(path)
        at, store = _store(spark, path)
        store.mkdirs(at)
        store.deleteOnExit(at)
    return path


def _store(spark: SparkSession, path: str):
    """The path and its file system, whichever store it is in, in Hadoop's terms."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder."""
    at, store = _store(spark, path)
    store.delete(at, True)


def written(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """The same rows, written to the shared folder and read again: later reads survive lost executors."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` gave, once nothing reads them any more; other frames are left alone."""
    for df in tables:
        if df is not None and (path := df.__dict__.get("scratch_path")):
            remove(df.sparkSession, path)


def checkpointed(df: DataFrame, condition: Column | None = None) -> tuple[DataFrame, int]:
    """The same rows behind a checkpoint in the shared folder, partitioned and sorted as they were, and how many satisfy the condition.

    A checkpoint tells its partitioning only if its own job is planned without adaptive execution, so that is off for this job.
    """
    spark = df.sparkSession
    shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    seen = Observation()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = df.observe(seen, F.count_if(F.lit(True) if condition is None else condition).alias("n")).checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    out.scratch_path = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
    return out, int(seen.get["n"])


class Rounds:
    """State of an iterative job: each round's table is written to the shared folder and read again.

    So no plan spans more than one round, and a lost executor costs no earlier round. The table of the round
    before the last is removed as the job goes on.
    """

    def __init__(self) -> None:
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.spark = df.sparkSession
        self.paths.append(scratch(self.spark, "round"))
        out = written(df, path=self.paths[-1])
        if len(self.paths) > 2:
            remove(self.spark, self.paths.pop(0))
        return out

    def release(self, last: DataFrame | None = None) -> None:
        """Removes the tables that are left but ``last``."""
        kept = last.__dict__.get("scratch_path") if last is not None else None
        for path in self.paths:
            if path != kept:
                remove(self.spark, path)
        self.paths = [x for x in self.paths if x == kept]

    def keep_counting(self, df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
        """``keep`` and how many rows satisfy the condition, counted by the job that writes them."""
        seen = Observation()
        out = self.keep(df.observe(seen, F.count_if(condition).alias("n")))
        return out, int(seen.get["n"])
