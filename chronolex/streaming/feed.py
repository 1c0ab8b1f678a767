"""Posts as a stream: windows of tagged words counted by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolex.operators import ngrams


def read(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """JSON lines that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def windowed_counts(posts: DataFrame, text: str = "selftext", at: str = "created_at", late: str = "30 days", width: str = "365 days", size: int = 5) -> DataFrame:
    """Counts of tagged n-grams by event-time window; rows later than the watermark are dropped, state behind it is freed."""
    tokens = ngrams.annotate(posts.withWatermark(at, late), [at], text)
    grams = ngrams.joined_windows(tokens, [at], size, name="lemma_pos")
    return grams.groupBy(F.window(at, width), "lemma_pos").agg(F.count(F.lit(1)).alias("count"))


def to_table(counts: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Finished windows as Parquet, exactly once."""
    return counts.select(F.col("window.start").alias("start"), "lemma_pos", "count").writeStream.outputMode(mode).option("checkpointLocation", checkpoint).format("parquet").option("path", path).trigger(availableNow=True).start()
