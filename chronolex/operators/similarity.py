"""Cosine features over sparse vectors in long form; nothing is pivoted over contexts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.operators.cube import Cube

BLENDS = (("0", 0.0), ("25", 0.25), ("50", 0.5), ("75", 0.75), ("100", 1.0), ("beta", None))


def norms(cube: Cube, name: str = "norm") -> DataFrame:
    v = F.col("count").cast("double")
    return cube.df.groupBy(*cube.row).agg(F.sqrt(F.sum(v * v)).alias(name))


def _vector(cube: Cube, name: str) -> DataFrame:
    return cube.df.select(*cube.cell, F.col("count").cast("double").alias(name))


def pair_sums(compounds: Cube, modifiers: Cube, heads: Cube) -> DataFrame:
    """For each pair and bin the sums over its contexts that every cosine and blend is made of, and the constituents' norms.

    vv, vm, vh, hm: products of the pair's, its modifier's and its head's counts; bh, bm, hh and mm: products with the pair and
    squares where both constituents are there. A sum is null where its vectors share no context. One pass: two joins on contexts, one grouping, two on norms.
    """
    cells = _vector(compounds, "v").join(_vector(heads, "h"), heads.cell, "left").join(_vector(modifiers, "m"), modifiers.cell, "left")
    v, m, h = F.col("v"), F.col("m"), F.col("h")
    both = m.isNotNull() & h.isNotNull()
    sums = {"vv": v * v, "vm": v * m, "vh": v * h, "hm": h * m, "bh": F.when(both, v * h), "bm": F.when(both, v * m), "hh": F.when(both, h * h), "mm": F.when(both, m * m)}
    out = cells.groupBy("modifier", "head", "time").agg(*(F.sum(x).alias(n) for n, x in sums.items()))
    return out.join(norms(heads, "nh"), heads.row, "left").join(norms(modifiers, "nm"), modifiers.row, "left")


def between_constituents(compounds: Cube, modifiers: Cube, heads: Cube, unseen: DataFrame | None = None) -> DataFrame:
    """Cosine of modifier and head. For seen pairs only contexts of the pair enter the sum; unseen pairs (modifier, head,
    time) use all shared contexts."""
    return cosines(compounds, modifiers, heads, unseen).select("modifier", "head", "time", "sim_bw_constituents")


def _unseen_cosine(modifiers: Cube, heads: Cube, unseen: DataFrame) -> DataFrame:
    free = unseen.select("modifier", "head", "time").join(_vector(heads, "h"), heads.row).join(_vector(modifiers, "m"), modifiers.cell)
    dot = free.groupBy("modifier", "head", "time").agg(F.sum(F.col("h") * F.col("m")).alias("hm"))
    return dot.join(norms(heads, "nh"), heads.row).join(norms(modifiers, "nm"), modifiers.row)


def beta_of(sm: Column, sh: Column, sb: Column) -> Column:
    """The blend weight that best explains the pair; 0.5 where it is undefined."""
    return F.coalesce(F.try_divide(sm - sh * sb, (sm + sh) * (1 - sb)), F.lit(0.5))


def cosines(compounds: Cube, modifiers: Cube, heads: Cube, unseen: DataFrame | None = None) -> DataFrame:
    """The three cosines, beta and the two means; unseen pairs have only the cosine of their constituents."""
    on = ["modifier", "head", "time"]
    sums = pair_sums(compounds, modifiers, heads).filter("hm is not null")
    if unseen is not None:
        sums = sums.unionByName(_unseen_cosine(modifiers, heads, unseen), allowMissingColumns=True)
    out = sums.select(*on, *_cosine_columns())
    sm, sh = F.col("sim_with_modifier"), F.col("sim_with_head")
    return out.select(*on, "sim_with_modifier", "sim_with_head", "sim_bw_constituents", beta_of(sm, sh, F.col("sim_bw_constituents")).alias("beta"), F.sqrt(sm * sh).alias("geom_mean_sim"), F.coalesce((sm + sh) / 2, sm, sh).alias("arith_mean_sim"))


def _cosine_columns() -> list[Column]:
    nc = F.sqrt("vv")
    return [(F.col("vm") / (nc * F.col("nm"))).alias("sim_with_modifier"), (F.col("vh") / (nc * F.col("nh"))).alias("sim_with_head"), (F.col("hm") / (F.col("nh") * F.col("nm"))).alias("sim_bw_constituents")]


def blends(compounds: Cube, modifiers: Cube, heads: Cube, beta: DataFrame | None = None) -> DataFrame:
    """Cosine of every pair with weighted sums of its unit constituents, over the contexts that all three share.

    A blend's product with the pair and its own square follow from the same sums, so all blends are arithmetic on one row.
    beta is each pair's own weight; where it is not given it is the one that cosines() gives.
    """
    on = ["modifier", "head", "time"]
    sums = pair_sums(compounds, modifiers, heads).filter("hm is not null")
    if beta is not None:
        sums = sums.join(beta.select(*on, "beta"), on)
    else:
        sums = sums.select("*", *_cosine_columns()).withColumn("beta", beta_of(F.col("sim_with_modifier"), F.col("sim_with_head"), F.col("sim_bw_constituents")))
    nh, nm = F.col("nh"), F.col("nm")
    out = []
    for name, b in BLENDS:
        b = F.col("beta") if b is None else F.lit(b)
        with_pair = b * F.col("bh") / nh + (1 - b) * F.col("bm") / nm
        square = b * b * F.col("hh") / (nh * nh) + 2 * b * (1 - b) * F.col("hm") / (nh * nm) + (1 - b) * (1 - b) * F.col("mm") / (nm * nm)
        out.append(F.try_divide(with_pair, F.sqrt(square) * F.sqrt("vv")).alias(f"sim_cpf_{name}"))
    return sums.select(*on, *out)


def compared(aware: Cube, agnostic: Cube, name: str) -> DataFrame:
    """For each key and bin of either setting: the cosine of its two vectors, and the aware one's token and type share; null
    where a key is in one setting only, and the cosine also where the vectors share no context. One join and one grouping."""
    cells = _vector(aware, "a").join(_vector(agnostic, "g"), aware.cell, "full")
    a, g = F.col("a"), F.col("g")
    n = lambda x: F.nullif(F.count(x), F.lit(0)).cast("double")
    cosine = F.try_divide(F.sum(a * g), F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(g * g)))
    return cells.groupBy(*aware.row).agg(cosine.alias(f"sim_{name}_settings"), F.try_divide(F.sum(a), F.sum(g)).alias(f"perc_token_{name}"), F.try_divide(n(a), n(g)).alias(f"perc_type_{name}"))


def shares(aware: Cube, agnostic: Cube, name: str) -> DataFrame:
    """Token and type share of the aware setting."""
    return compared(aware, agnostic, name).drop(f"sim_{name}_settings")


def settings(aware: tuple[Cube, Cube, Cube], agnostic: tuple[Cube, Cube, Cube]) -> DataFrame:
    """Cross-setting cosines and shares of compounds, modifiers and heads for every pair and bin of both."""
    per = [compared(x, y, n).filter(F.col(f"sim_{n}_settings").isNotNull()) for x, y, n in zip(aware, agnostic, ("comp", "modifier", "head"), strict=True)]
    return per[0].join(per[1], ["modifier", "time"]).join(per[2], ["head", "time"])


# dense vectors

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), F.sqrt(dot(a, a))))


def dense_cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def composed(a: Column, b: Column) -> Column:
    """The additive vector of a novel pair."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def mean_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Group means of dense vectors, one position at a time; partial sums are merged before the shuffle."""
    parts = df.select(*keys, F.posexplode(vector).alias("__k", "__x")).groupBy(*keys, "__k").agg(F.avg(F.col("__x").cast("double")).alias("__x"))
    rows = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__k", "__x"))).alias("__v"))
    return rows.select(*keys, F.transform("__v", lambda s: s["__x"]).alias(vector))


def join_all(frames: list[DataFrame], on: list[str], how: str = "inner") -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, how), frames)
