"""From long features to one wide row per pair: pivots, ratings, imputation, scaling, reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def widen(long: DataFrame, keys: Sequence[str], features: Sequence[str], times: Sequence[int], how: str = "avg", sep: str = ":") -> DataFrame:
    """One column `<feature>:<time>` for each feature and bin; the bins are given, so no job looks for them."""
    agg = getattr(F, how)
    cells = [agg(F.when(F.col("time") == t, F.col(f))).alias(f"{f}{sep}{t}") for f in features for t in times]
    return long.groupBy(*keys).agg(*cells)


def lengthen(wide: DataFrame, keys: Sequence[str], sep: str = ":") -> DataFrame:
    """Columns `<feature>:<time>` as rows of keys, feature, time and value."""
    cols = [c for c in wide.columns if c not in keys]
    long = wide.unpivot(list(keys), [F.col(f"`{c}`").cast("double").alias(c) for c in cols], "name", "value")
    parts = F.split("name", sep)
    return long.select(*keys, parts.getItem(0).alias("feature"), parts.getItem(1).cast("int").alias("time"), "value")


def rated(ratings: DataFrame, wide: DataFrame) -> DataFrame:
    """Every rated pair with its features, if it has any; ratings from several sources are all kept, copies once."""
    return ratings.join(wide, ["modifier", "head"], "left").dropDuplicates()


def medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls of the columns replaced by the column's median (one row of medians, joined back)."""
    m = df.agg(*(F.median(f"`{c}`").alias(f"__m_{k}") for k, c in enumerate(cols)))
    filled = {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.col(f"__m_{k}")) for k, c in enumerate(cols)}
    return df.crossJoin(F.broadcast(m)).select(*(filled[c].alias(c) if c in filled else F.col(f"`{c}`") for c in df.columns))


def min_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns scaled to 0..1; a constant column becomes 0."""
    m = df.agg(*(f(F.col(f"`{c}`").cast("double")).alias(f"__{n}_{k}") for k, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))))
    scaled = {c: F.coalesce(F.try_divide(F.col(f"`{c}`").cast("double") - F.col(f"__lo_{k}"), F.col(f"__hi_{k}") - F.col(f"__lo_{k}")), F.when(F.col(f"`{c}`").isNotNull(), F.lit(0.0))) for k, c in enumerate(cols)}
    return df.crossJoin(F.broadcast(m)).select(*(scaled[c].alias(c) if c in scaled else F.col(f"`{c}`") for c in df.columns))


def finite(x: Column) -> Column:
    """Infinities and NaN as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order that leaves no ties."""
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")


def tagged(ratings: DataFrame, is_adj: Column, eight: bool = False) -> DataFrame:
    """Each rating once for every tag combination of modifier and head; the modifier's tags depend on is_adj.

    The larger expansion tags adjectives as nouns as well.
    """
    nouns = [(m, h) for m in ("NOUN", "PROPN") for h in ("NOUN", "PROPN")]
    adjectives = [("ADJ", h) for h in ("NOUN", "PROPN")]
    pairs = lambda tags: F.array(*(F.struct(F.lit(m).alias("m"), F.lit(h).alias("h")) for m, h in tags))
    tags = F.when(is_adj, pairs(adjectives + (nouns if eight else []))).otherwise(pairs(nouns))
    out = ratings.withColumn("__t", F.explode(tags))
    glue = lambda word, tag: F.concat_ws("_", F.col(word), F.col(f"__t.{tag}"))
    return out.withColumn("modifier", glue("modifier", "m")).withColumn("head", glue("head", "h")).drop("__t")


def complete(keys: DataFrame, times: DataFrame, long: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every key at every bin, with features where there are any. times is the list of bins: a row each."""
    return keys.crossJoin(F.broadcast(times)).join(long, [*on, "time"], "left")


def unseen(pairs: DataFrame, times: DataFrame, seen: DataFrame) -> DataFrame:
    """(modifier, head, time) of pairs that are not seen at that time."""
    return pairs.select("modifier", "head").distinct().crossJoin(F.broadcast(times)).join(seen.select("modifier", "head", "time"), ["modifier", "head", "time"], "left_anti")


def by_unit(long: DataFrame, unit: str, features: Sequence[str]) -> DataFrame:
    """Mean and standard deviation of features per modifier or head; a single row's deviation is the column's mean one."""
    agg = long.groupBy(unit).agg(*(f(c).alias(f"{c}_{n}") for c in features for n, f in (("mean", F.avg), ("std", F.stddev_samp))))
    means = agg.agg(*(F.avg(f"{c}_std").alias(f"__{c}") for c in features))
    fill = {f"{c}_std": F.coalesce(f"{c}_std", f"__{c}") for c in features}
    return agg.crossJoin(F.broadcast(means)).select(*(fill[c].alias(c) if c in fill else F.col(c) for c in agg.columns))


def gap_free(long: DataFrame, keys: Sequence[str], since: int, expected: int) -> DataFrame:
    """Rows from `since` on of keys that are present at each of the expected bins."""
    rows = long.filter(F.col("time") >= since)
    whole = rows.groupBy(*keys).agg(F.count_distinct("time").alias("n")).filter(F.col("n") == expected).drop("n")
    return rows.join(whole, list(keys), "left_semi")


# Rated compounds that the regressions leave out.
LEFT_OUT = ("call_centre", "benign_tumour", "computer_programme", "grey_matter", "labour_union", "baby_blues", "contact_lenses")


def without_named(ratings: DataFrame, compound: str = "compound", names: Sequence[str] = LEFT_OUT) -> DataFrame:
    """Rows of other compounds, and those without a name."""
    return ratings.filter(F.coalesce(~F.col(compound).isin(*names), F.lit(True)))


def pattern_subset(features: DataFrame, pattern: str, is_adj: str = "is_adj") -> DataFrame:
    """Rows of one tag pattern for regression: an, nn, ap or pp.

    The head has the second letter's tag (n: NOUN, p: PROPN). The modifier has the head's tag too, but that of an adjective
    compound is an ADJ where the pattern begins with a.
    """
    tag = "_NOUN" if pattern[1] == "n" else "_PROPN"
    own = F.when(F.col(is_adj), F.col("modifier").contains("_ADJ" if pattern[0] == "a" else tag)).otherwise(F.col("modifier").contains(tag))
    return features.filter(own & F.col("head").contains(tag))


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows, mean, standard deviation and median of a value per group."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.median(v).alias("median"))


def nested_summary(df: DataFrame, outer: Sequence[str], inner: str, value: str) -> DataFrame:
    """Mean and deviation over seeds (inner groups) of the seeds' means."""
    means = df.groupBy(*outer, inner).agg(F.avg(F.col(value).cast("double")).alias("m"))
    return means.groupBy(*outer).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"), F.count(F.lit(1)).alias("n"))


def rating_level(x: Column) -> Column:
    """high from 4, med from 2, else low."""
    return F.when(x >= 4, "high").when(x >= 2, "med").when(x < 2, "low")


def family_of(name: str) -> str:
    """The feature family of a feature's name."""
    families = {"cordeiro": ("sim_cpf", "beta", "geom_mean", "arith_mean"), "cosine": ("sim_with", "sim_bw"), "setting": ("perc_",), "info": ("log_ratio", "ppmi", "local_mi"), "freq": ("comp_tf", "mod_tf", "head_tf", "log_", "comp_freq", "mod_freq", "head_freq"), "prod": ("mod_prod", "head_prod", "mod_family", "head_family"), "change": ("change_",)}
    if name.endswith("_settings"):
        return "setting"
    return next((f for f, starts in families.items() if name.startswith(starts)), "other")
