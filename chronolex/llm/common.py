"""Helpers shared by the corpus operators: column access, Arrow maps, shipping the package and shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch holds when it reaches a Python worker; whole texts can be long.
ARROW_ROWS = 1000


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def prepare(spark: SparkSession) -> None:
    """Ship this package to the Python workers, once, and bound the session's Arrow batches, unless they are smaller already.

    Spark has no such bound for one query: it reads the session's when it plans.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ARROW_ROWS:
        spark.conf.set(rows, ARROW_ROWS)
    sc = spark.sparkContext
    if getattr(sc, "_chronolex_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="chronolex-")) / "chronolex_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._chronolex_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset a local master gets a
    temporary folder, and any other an error."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(sc, "_chronolex_dir", None):
        sc._chronolex_dir = "file://" + tempfile.mkdtemp(prefix="chronolex-shared-")
        sc.setCheckpointDir(sc._chronolex_dir)
    return sc._chronolex_dir


def work_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/chronolex-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediates, once no result that reads them is wanted any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under names of its own."""
    return docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], dict[str, list]]], schema: str, size: int = 250) -> DataFrame:
    """Apply a function of a list of row dicts to slices of at most `size` rows. `make` runs once for each task."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                out = f({n: c.to_pylist() for n, c in zip(batch.schema.names, batch.slice(at, size).columns, strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in arrow], schema=arrow)

    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_sample(df: DataFrame, key: Column, bound: int) -> DataFrame:
    """About `bound` rows, and beyond it only with a chance of one in a billion; all rows where there are fewer.

    Rows are taken by a hash of their key, so the same table gives the same sample in any partitioning.
    """
    n = df.count()
    if n <= bound:
        return df
    share = max(bound - 6 * bound**0.5, bound * 0.5) / n
    cut = int((2**63 - 1) * (2 * share - 1)) if share < 1 else 2**63 - 1
    return df.filter(F.xxhash64(F.lit("sample"), key) <= F.lit(cut))


def no_threads() -> None:
    """Tokenizer libraries start no threads of their own in a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")
