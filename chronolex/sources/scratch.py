"""A folder for intermediates that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def top(spark: SparkSession) -> str:
    """This application's part of spark.checkpoint.dir. Where that is unset a local master gets a temporary folder, and any
    other an error."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not set_to and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not set_to and not getattr(sc, "_chronolex_scratch", None):
        sc._chronolex_scratch = "file://" + tempfile.mkdtemp(prefix="chronolex-scratch-")
    return f"{(set_to or sc._chronolex_scratch).rstrip('/')}/scratch-{sc.applicationId}"


def folder(spark: SparkSession, label: str) -> str:
    """A new path in it."""
    return f"{top(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written and read again: computed once, whatever is derived from it, and not lost with an executor."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediates, once no result that reads them is wanted any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(top(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
