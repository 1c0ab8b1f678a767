"""Writers: partitioned cubes, feature files by configuration, document splits, cached intermediates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolex.operators.assemble import medians
from chronolex.operators.cube import Cube


def exists(spark: SparkSession, path: str) -> bool:
    """A finished output: the mark that Spark writes last is there. Any file system that Spark reads."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def by_decade(df: DataFrame, path: str, time: str = "time", most_rows: int = 50_000_000, mode: str = "overwrite") -> None:
    """Parquet with a folder for each decade. Rows of a decade are spread over tasks; AQE sizes them."""
    out = df.withColumn("decade", (F.col(time) - F.pmod(F.col(time), F.lit(10))).cast("int"))
    out.hint("rebalance", "decade").write.mode(mode).option("maxRecordsPerFile", most_rows).option("compression", "snappy").partitionBy("decade").parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Tab-separated rows added to what is there; every part has its header."""
    df.write.mode("append").option("sep", "\t").option("header", True).csv(path)


def feature_table(df: DataFrame, path: str, config: dict[str, str | int]) -> None:
    """Features in folders named after their configuration; a repeated run replaces its own folder only."""
    folder = "/".join(f"{k}={v}" for k, v in config.items())
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/{folder}")


def feature_twins(df: DataFrame, path: str, config: dict[str, str | int], features: list[str]) -> None:
    """A feature table twice: with missing values as they are (`na`), and with the columns' medians in their place (`med`)."""
    for variant, out in (("na", df), ("med", medians(df, features))):
        feature_table(out, path, {**config, "missing": variant})


def word_list(df: DataFrame, col: str, path: str) -> None:
    df.select(F.col(col).cast("string").alias("value")).write.mode("overwrite").text(path)


def unless_done(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and written first if it is not finished there."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_cube(spark: SparkSession, folder: str, width: int, keys: tuple[str, ...], make: Callable[[], Cube]) -> Cube:
    """A cube of bins of this width: the stored one, else re-binned from the finest stored one that divides it, else made."""
    here = f"{folder}/bin={width}"
    if exists(spark, here):
        return Cube(spark.read.parquet(here), keys)
    for finer in (20, 10, 1):
        if width % finer == 0 and width != finer and exists(spark, f"{folder}/bin={finer}"):
            cube = Cube(spark.read.parquet(f"{folder}/bin={finer}"), keys).rebinned(width)
            break
    else:
        cube = make().rebinned(width)
    cube.df.write.mode("overwrite").parquet(here)
    return Cube(spark.read.parquet(here), keys)


def document_split(sentences: DataFrame, doc: str, place: str, n: int = 1000, by: list[str] | None = None) -> DataFrame:
    """The longest document's sentences as train (after 2n), valid (first n) and test (next n), by place; with `by`, those of
    the longest document of each group, such as a decade.

    Two sentences fall between the slices, as in the original cut points n+1 and 2n+2. Ties go to the first document. Sizes
    are summed before they are compared, so a group's documents need not meet in one task.
    """
    by = by or []
    sizes = sentences.groupBy(*by, doc).agg(F.count(F.lit(1)).alias("__n"))
    longest = sizes.groupBy(*by).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(doc).alias("doc"))).alias("__l"))
    longest = longest.select(*(F.col(b).alias(f"__{b}") for b in by), F.col("__l.doc").alias("__doc"))
    same = F.col(doc).eqNullSafe(F.col("__doc"))
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    rows = sentences.join(longest, same, "left_semi").withColumn("__k", F.row_number().over(W.partitionBy(*by, doc).orderBy(place)) - 1)
    part = F.when(F.col("__k") < n, "valid").when((F.col("__k") > n) & (F.col("__k") <= 2 * n), "test").when(F.col("__k") >= 2 * n + 2, "train")
    return rows.withColumn("part", part).filter("part is not null").drop("__k")


def latex(df: DataFrame, most: int = 1000) -> str:
    """A short report table as LaTeX; longer ones are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most")
    line = lambda cells: " & ".join("" if c is None else str(c).replace("_", "\\_").replace("&", "\\&").replace("%", "\\%") for c in cells) + " \\\\"
    return "\n".join(["\\begin{tabular}{" + "l" * len(df.columns) + "}", line(df.columns), "\\hline", *map(line, rows), "\\end{tabular}"])
