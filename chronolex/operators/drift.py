"""Change of a key's vector since the previous time at which the key is present."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolex.operators.cube import Cube
from chronolex.operators.similarity import dense_cosine, norms


def change(cube: Cube, name: str) -> DataFrame:
    """Cosine of each key's vector with its previous one; null at a key's first time.

    The previous time comes from a window over distinct (key, time) rows, the dot product from an equi-join on the context.
    """
    n = norms(cube, "n")
    by_key = W.partitionBy(*cube.keys).orderBy("time")
    steps = n.withColumn("before", F.lag("time").over(by_key)).withColumn("n_before", F.lag("n").over(by_key))
    now = cube.df.join(steps.filter("before is not null").select(*cube.row, "before"), cube.row)
    then = cube.df.select(*cube.keys, "context", F.col("time").alias("before"), F.col("count").cast("double").alias("w"))
    dots = now.join(then, [*cube.keys, "context", "before"]).groupBy(*cube.row).agg(F.sum(F.col("count").cast("double") * F.col("w")).alias("dot"))
    out = steps.join(dots, cube.row, "left")
    cosine = F.try_divide(F.coalesce("dot", F.lit(0.0)), F.col("n") * F.col("n_before"))
    return out.select(*cube.row, F.when(F.col("before").isNotNull(), cosine).alias(name))


def features(compounds: Cube, modifiers: Cube, heads: Cube) -> DataFrame:
    """Drift of pairs with that of their constituents; rows at which a constituent is new are left out."""
    out = change(compounds, "change_comp")
    for cube, name in ((modifiers, "change_mod"), (heads, "change_head")):
        out = out.join(change(cube, name).filter(F.col(name).isNotNull()), cube.row)
    return out.select("modifier", "head", "time", "change_comp", "change_mod", "change_head")


def dense_change(df: DataFrame, keys: list[str], vector: str, time: str = "time", name: str = "change") -> DataFrame:
    before = F.lag(vector).over(W.partitionBy(*keys).orderBy(time))
    return df.withColumn("_before", before).select(*keys, time, dense_cosine(F.col(vector), F.col("_before")).alias(name))


def percent_change(df: DataFrame, keys: list[str], value: str, time: str = "time") -> Column:
    """Relative change of a value since the key's previous row."""
    v = F.col(value).cast("double")
    before = F.lag(v).over(W.partitionBy(*keys).orderBy(time))
    return F.try_divide(v, before) - 1
