"""Places of rows in an order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.graph import fresh_name
from loomgraph.runtime import discard, written


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with their 0-based place in the order of the given columns as ``name``, written to the shared folder.

    Rows are dealt by ranges of these columns and written with the number of their range. A range's first place is how many rows the ranges before it have.
    """
    part = fresh_name(df, "part")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), "ranges")
    out = written(placed(dealt, [part], [F.col(c) for c in order], name).drop(part), "numbered")
    discard(dealt)
    return out


def placed(df: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """The rows with their 0-based place as ``name``: groups follow one another in the order of their columns, rows of a group in the given order.

    Groups are splits or ranges, so one fits a task, and there are few enough of them to be put in order by one.
    """
    first = fresh_name(df, "first")
    sizes = df.groupBy(*groups).agg(F.count("*").alias(first))
    before = Window.orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(*[F.col(g).alias(f"_{first}_{g}") for g in groups], F.coalesce(F.sum(first).over(before), F.lit(0)).alias(first))
    same = [F.col(g).eqNullSafe(F.col(f"_{first}_{g}")) for g in groups]
    inside = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    rows = df.withColumn(name, inside).join(firsts, same)
    return rows.withColumn(name, (F.col(name) + F.col(first) - 1).cast("long")).drop(first, *[f"_{first}_{g}" for g in groups])
