"""Global running totals, ranks and numbers without gathering a table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolex.sources.scratch import stored


def running(df: DataFrame, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """df with the running total of value in an order that leaves no ties.

    Rows are written in ranges of the order, so that every use sees the same ranges; each range is summed in a task of its
    own, and what its predecessors sum to, one number a range, is added.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("__v", value).repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id())
    rows = stored(rows, "ranges")
    totals = rows.groupBy("__p").agg(F.sum("__v").alias("__t"))
    before = totals.select("__p", F.coalesce(F.sum("__t").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    own = F.sum("__v").over(W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    both = rows.withColumn(name, own).join(F.broadcast(before), "__p")  # a row a range
    return both.withColumn(name, F.col(name) + F.col("__b")).drop("__p", "__v", "__b")


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with numbers from 1 in an order that leaves no ties."""
    return running(df, order, F.lit(1).cast("long"), name)


def indexed(df: DataFrame, col: str, name: str) -> DataFrame:
    """Distinct values with dense numbers from 0, in the values' order."""
    return numbered(df.select(col).distinct(), [col], name).select(col, (F.col(name) - 1).alias(name))


def mean_ranks(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Distinct values of the columns with the mean rank of their rows."""
    n = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    return running(n, cols, F.col("__n"), name).select(*cols, (F.col(name) - (F.col("__n") - 1) / 2).alias(name))
