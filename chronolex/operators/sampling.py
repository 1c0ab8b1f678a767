"""Splits by novelty, negative pairs and repeatable random choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def novelty_split(seen: DataFrame, keys: list[str], before: int, last: int, time: str = "time") -> DataFrame:
    """Each key's part: test if it occurs in the last bin only, valid if in exactly the last two, train if it occurs in an
    earlier bin otherwise; keys that only occur later or in `before` alone have none and are left out.

    before and last are the last two bins.
    """
    t = F.col(time)
    k = seen.groupBy(*keys).agg(F.count_distinct(time).alias("n"), F.max((t == last).cast("int")).alias("in_last"), F.max((t == before).cast("int")).alias("in_before"), F.max((t < before).cast("int")).alias("earlier"))
    part = F.when((F.col("n") == 1) & (F.col("in_last") == 1), "test").when((F.col("n") == 2) & (F.col("in_last") == 1) & (F.col("in_before") == 1), "valid").when(F.col("earlier") == 1, "train")
    return k.select(*keys, part.alias("part")).filter("part is not null")


def pick(col: Column, seed: int) -> Column:
    """A repeatable hash that SQL engines share, as text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), col))


def draw(text: Column, n: Column) -> Column:
    """A repeatable number from 0 to n - 1."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), n)


def negatives(pairs: DataFrame, words: DataFrame, seen: DataFrame, replace: str, seeds: int = 10) -> DataFrame:
    """For each pair and seed the pair with `replace` (head or modifier) exchanged for a random word, such that it is unseen.

    words: (slot, word) with slots 0..n-1. Of the words that the kept side was never seen with, in the order of their slots,
    one is drawn by a hash, each with the same chance. A pair has no row only if its kept side was seen with every word.
    The drawn word's slot is the drawn number plus the slots before it that are taken: taken slots and drawn numbers are
    sorted together for each kept word, so nothing is crossed with the words, and no list of them is gathered.
    """
    keep = "modifier" if replace == "head" else "head"
    n = words.agg(F.count(F.lit(1)).alias("n_words"))
    taken = seen.select(F.col(keep).alias("k"), F.col(replace).alias("word")).distinct().join(words, "word").select("k", "slot")
    own = W.partitionBy("k").orderBy("slot")
    gaps = taken.select("k", (F.col("slot") - F.row_number().over(own) + 1).alias("at"))  # free slots before a taken one
    used = taken.groupBy("k").agg(F.count(F.lit(1)).alias("n_taken"))
    rows = pairs.select("modifier", "head", F.col(keep).alias("k")).distinct().join(used, "k", "left").crossJoin(F.broadcast(n))
    rows = rows.withColumn("n_free", F.col("n_words") - F.coalesce("n_taken", F.lit(0))).filter("n_free > 0")
    rows = rows.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    text = F.concat_ws("|", "modifier", "head", F.col("seed").cast("string"))
    drawn = rows.select("k", draw(text, F.col("n_free")).alias("at"), "modifier", "head", "seed")
    both = gaps.withColumn("gap", F.lit(1)).unionByName(drawn.withColumn("gap", F.lit(0)), allowMissingColumns=True)
    before = F.sum("gap").over(W.partitionBy("k").orderBy("at", F.desc("gap")).rowsBetween(W.unboundedPreceding, 0))
    placed = both.withColumn("slot", F.col("at") + before).filter("gap = 0").select("modifier", "head", "seed", "slot")
    return placed.join(words.select("slot", F.col("word").alias(f"new_{replace}")), "slot").drop("slot")


def reversed_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs and their reversals, labelled 1 and 0; reversals that are pairs themselves are left out."""
    turned = pairs.select(F.col("head").alias("modifier"), F.col("modifier").alias("head")).join(pairs, ["modifier", "head"], "left_anti")
    return pairs.select("modifier", "head", F.lit(1).alias("label")).unionByName(turned.select("modifier", "head", F.lit(0).alias("label")))


def sample(df: DataFrame, key: Column, n: int, seed: int) -> DataFrame:
    """n rows in a repeatable random order."""
    return df.withColumn("__r", pick(key, seed)).orderBy("__r").limit(n).drop("__r")


def hash_split(df: DataFrame, key: Column, train: float, seed: int) -> DataFrame:
    """df with part train or test; about `train` of the rows are in the first, whatever the partitioning."""
    u = F.conv(F.substring(pick(key, seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return df.withColumn("part", F.when(u < train, "train").otherwise("test"))


def edge_choice(left: Column, right: Column, key: Column, constant: bool = False) -> Column:
    """One of two context words by a hash of the key, or always the left one."""
    return left if constant else F.when(F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(2)) == 0, left).otherwise(right)


def set_sizes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of two word sets, their union, intersection and difference, from one pass over both."""
    marks = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    k = marks.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    in_a, in_b = F.col("a") == 1, F.col("b") == 1
    return k.agg(count(in_a).alias("n_a"), count(in_b).alias("n_b"), F.count(F.lit(1)).alias("n_union"), count(in_a & in_b).alias("n_both"), count(in_a & ~in_b).alias("n_only_a"))
