"""Readers of n-gram counts, tagged text, posts, archives and word lists."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolex.operators.order import numbered

NGRAM_V1 = T.StructType([T.StructField("ngram", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("count", T.LongType())])
SUBMISSION = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "title", "selftext", "subreddit")] + [T.StructField("created_utc", T.LongType()), T.StructField("is_self", T.BooleanType())])
COMMENT = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "body", "subreddit")] + [T.StructField("created_utc", T.LongType())])
LEGACY_NGRAM = T.StructType([T.StructField("fivegram_pos", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("count", T.LongType()), T.StructField("volume", T.LongType())])


def packed_ngrams(spark: SparkSession, path: str) -> DataFrame:
    """Lines `ngram TAB year,match,volume TAB …` (gzip or plain) as ngram and packed counts."""
    return split_packed(spark.read.text(path))


def split_packed(lines: DataFrame, col: str = "value") -> DataFrame:
    parts = F.split(F.col(col), "\t", 2)
    return lines.select(parts.getItem(0).alias("ngram"), F.try_element_at(parts, F.lit(2)).alias("packed"))


def unpacked(ngrams: DataFrame, keep: tuple[str, ...] = ("ngram",), col: str = "packed") -> DataFrame:
    """A row for each year of the packed counts: keep columns, year, count; malformed triples are dropped."""
    rows = ngrams.select(*keep, F.explode(F.split(col, "\t")).alias("t")).withColumn("f", F.split("t", ","))
    year, count = F.try_element_at("f", F.lit(1)).try_cast("int"), F.try_element_at("f", F.lit(2)).try_cast("long")
    return rows.select(*keep, year.alias("year"), count.alias("count")).filter("year is not null and count is not null")


def ngrams_v1(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ngram, year, count without header or quoting; further columns are ignored."""
    return spark.read.schema(NGRAM_V1).option("sep", "\t").option("quote", "").option("enforceSchema", True).csv(path)


def delimited(spark: SparkSession, path: str, sep: str = "\t", header: bool = True, encoding: str = "UTF-8", schema: T.StructType | str | None = None) -> DataFrame:
    """Text tables of ratings, spellings and features; all strings unless a schema is given.

    Single-byte encodings that Spark does not read, such as cp1252, are read as ISO-8859-1 and their letters exchanged.
    """
    known = encoding.upper() in ("UTF-8", "UTF-16", "UTF-16LE", "UTF-16BE", "UTF-32", "US-ASCII", "ISO-8859-1")
    reader = spark.read.option("sep", sep).option("header", header).option("encoding", encoding if known else "ISO-8859-1")
    df = (reader.schema(schema) if schema else reader).csv(path)
    if known:
        return df
    old = "".join(chr(b) for b in range(128, 256))
    new = "".join(bytes([b]).decode(encoding, "replace") for b in range(128, 256))
    return df.select(*(F.translate(F.col(f"`{f.name}`"), old, new).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema))


def whitespace_table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Columns set apart by any white space."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(*(F.try_element_at(f, F.lit(k + 1)).alias(n) for k, n in enumerate(names)))


def zipped(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, text (one row for each member of each zip file), read by Spark and unpacked on the executors."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if not name.endswith("/"):
                            yield pd.DataFrame({"archive": [p.rsplit("/", 1)[-1]], "member": [name], "text": [z.read(name).decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, "archive string, member string, text string")


def posts(spark: SparkSession, path: str, schema: T.StructType = SUBMISSION) -> DataFrame:
    """JSON lines with a declared schema; lines that are no JSON are rows of nulls, which the post filters drop."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def json_posts(lines: DataFrame, col: str, schema: T.StructType) -> DataFrame:
    """The same from a string column."""
    return lines.select("*", F.from_json(col, schema).alias("__j")).select(*lines.columns, "__j.*")


def frames(spark: SparkSession, pattern: str) -> DataFrame:
    """All Parquet files of a pattern, missing columns filled."""
    return spark.read.option("mergeSchema", True).parquet(pattern)


def words(spark: SparkSession, path: str) -> DataFrame:
    """A word list, one a line; empty lines are dropped."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("word"))


def inventory(df: DataFrame) -> DataFrame:
    """The files behind a table with their size and rows."""
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).groupBy("file", "bytes").agg(F.count(F.lit(1)).alias("rows"))


def row_range(df: DataFrame, order: list[str], start: int, stop: int) -> DataFrame:
    """Rows start to stop - 1, from 0, in an order without ties: a range of a stored frame."""
    return numbered(df, order, "__row").filter(F.col("__row").between(start + 1, stop)).drop("__row")


def year_of(epoch: Column) -> Column:
    return F.year(F.timestamp_seconds(epoch))
