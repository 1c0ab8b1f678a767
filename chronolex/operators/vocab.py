"""Vocabularies: top-k, presence over time, shares, rank and decile bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolex.operators.order import numbered, running


def top_k(counts: DataFrame, word: str, count: str, k: int) -> DataFrame:
    """The k most frequent words over all rows; ties go to the word that sorts first. Partial sums, then bounded heaps."""
    return counts.groupBy(word).agg(F.sum(count).alias(count)).orderBy(F.desc(count), word).limit(k)


def top_k_per(counts: DataFrame, by: str, word: str, count: str, k: int, parts: int = 16) -> DataFrame:
    """The k most frequent words of each bin.

    A bin's words are ranked in `parts` salted shares first, so that the last ranking of a bin sees parts * k rows at most.
    """
    sums = counts.groupBy(by, word).agg(F.sum(count).alias(count)).withColumn("__s", F.pmod(F.xxhash64(word), F.lit(parts)))
    order = [F.desc(count), F.col(word)]
    local = sums.withColumn("__k", F.row_number().over(W.partitionBy(by, "__s").orderBy(*order))).filter(F.col("__k") <= k)
    return local.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k).select(by, word, count, "rank")


def always_present(counts: DataFrame, word: str, time: str, least: int = 0, count: str = "count") -> DataFrame:
    """Words that occur more than `least` times in every bin there is."""
    bins = counts.agg(F.count_distinct(time).alias("bins"))
    sums = counts.groupBy(word, time).agg(F.sum(count).alias("n")).filter(F.col("n") > least)
    return sums.groupBy(word).agg(F.count(F.lit(1)).alias("present"), F.sum("n").alias(count)).join(F.broadcast(bins), F.col("present") == F.col("bins")).select(word, count)


def share_per_bin(counts: DataFrame, by: str, word: str, count: str = "count") -> DataFrame:
    """Each word's part of its bin's total; totals are a row a bin and joined back."""
    sums = counts.groupBy(by, word).agg(F.sum(count).alias(count))
    totals = sums.groupBy(by).agg(F.sum(count).alias("__total"))
    return sums.join(totals, by).select(by, word, count, (F.col(count).cast("double") / F.col("__total")).alias("share"))


def presence(counts: DataFrame, keys: list[str], times: list[int]) -> DataFrame:
    """For each key a bit for each bin, earliest first, and the number of bins in which it is present."""
    marks = [F.max(F.when(F.col("time") == t, 1).otherwise(0)).alias(f"__{t}") for t in times]
    out = counts.groupBy(*keys).agg(*marks)
    bits = [F.col(f"__{t}") for t in times]
    return out.select(*keys, F.concat(*(b.cast("string") for b in bits)).alias("pattern"), sum(bits[1:], bits[0]).cast("int").alias("present"))


def edges_bin(df: DataFrame, value: str, parts: int = 10, name: str = "bin") -> DataFrame:
    """Quantile bins 1..parts by interpolated edges, so that ties share a bin. One row of edges is joined back."""
    edges = df.agg(F.percentile(value, F.array(*(F.lit(k / parts) for k in range(1, parts)))).alias("__e"))
    return df.crossJoin(F.broadcast(edges)).withColumn(name, (F.size(F.filter("__e", lambda e: F.col(value) > e)) + 1).cast("int")).drop("__e")


def rank_bins(df: DataFrame, value: str, tie: list[str], sizes: tuple[int, ...]) -> DataFrame:
    """The smallest of the sizes within which a row's rank by descending value falls, as `top<size>`; else `rest`."""
    label = F.lit("rest")
    for n in sorted(sizes, reverse=True):
        label = F.when(F.col("__rank") <= n, f"top{n}").otherwise(label)
    return numbered(df, [F.desc(value), *map(F.col, tie)], "__rank").withColumn("rank_bin", label).drop("__rank")


def running_share(df: DataFrame, order: str, value: str, name: str = "cumulative") -> DataFrame:
    """Running total by a column without ties, such as explained variances by component."""
    return running(df, [order], F.col(value), name)


def reduced(before: DataFrame, after: DataFrame, count: str = "count") -> DataFrame:
    """Types and tokens before and after a step, and what part of them is left."""
    sums = lambda df, s: df.agg(F.count(F.lit(1)).alias(f"types_{s}"), F.sum(count).alias(f"tokens_{s}"))
    both = sums(before, "before").crossJoin(sums(after, "after"))
    return both.select("*", F.try_divide(F.col("types_after").cast("double"), F.col("types_before")).alias("types_left"), F.try_divide(F.col("tokens_after").cast("double"), F.col("tokens_before")).alias("tokens_left"))


def greedy_buckets(sizes: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """Bucket numbers of keys in order: a bucket is closed when the next key would take it beyond `most`.

    Every number depends on all before it, so one task reads the sorted rows; it keeps none of them. For metadata such as
    file sizes. Null sizes count 0.
    """
    rows = sizes.select(F.col(key), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias(size)).repartitionByRange(1, key).sortWithinPartitions(key)

    def fold(batches):
        used = bucket = 0
        for b in batches:
            out = []
            for x in b[size].tolist():
                if used and used + x > most:
                    used, bucket = 0, bucket + 1
                used += x
                out.append(bucket)
            yield b.assign(bucket=out)

    return rows.mapInPandas(fold, f"`{key}` {sizes.schema[key].dataType.simpleString()}, `{size}` long, bucket int")
