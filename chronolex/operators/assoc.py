"""Association, productivity and frequency features of cubes.

Totals come from group-bys that are joined back: a bin has few groups, and a window over it would gather the bin in one task.
Counts are made double before they are multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.operators.cube import Cube


def log2(x: Column) -> Column:
    """log2 of a positive number, else null."""
    return F.when(x > 0, F.log2(x))


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def ppmi(cube: Cube, alpha: float = 1.0, keep_negative_as_zero: bool = False) -> Cube:
    """Counts become log2(XY N / (X Y^alpha)), X the key's and Y the context's mass in the bin, N the bin's.

    Negative weights are dropped, or set to 0. The row totals roll up to N, so the cube is summed twice, not thrice.
    """
    x = cube.df.groupBy(*cube.row).agg(F.sum("count").alias("x"))
    y = cube.df.groupBy("context", "time").agg(F.sum("count").alias("y"))
    n = y.groupBy("time").agg(F.sum("y").alias("n"))
    y = y.join(n, "time")
    joined = cube.df.join(x, cube.row).join(y, ["context", "time"])
    weight = log2(_d("count") * _d("n") / (_d("x") * (_d("y") if alpha == 1.0 else F.pow(_d("y"), F.lit(alpha)))))
    out = joined.withColumn("count", weight)
    out = out.withColumn("count", F.greatest("count", F.lit(0.0))) if keep_negative_as_zero else out.filter("count >= 0")
    return Cube(out.select(*cube.cell, "count"), cube.keys)


def productivity(compounds: Cube, modifiers: Cube, heads: Cube, distinct: bool = False) -> DataFrame:
    """Family sizes of both constituents for every observed pair and bin.

    A family is counted in cube rows (pairs and contexts), or in distinct pairs.
    """
    rows = compounds.df.select("modifier", "head", "time").distinct() if distinct else compounds.df
    size = rows.groupBy("time").agg(F.count(F.lit(1)).alias("comp_size"))
    out = compounds.df.select("modifier", "head", "time").distinct()
    for role, short, cube in (("modifier", "mod", modifiers), ("head", "head", heads)):
        family = rows.groupBy(role, "time").agg(F.count(F.lit(1)).alias(f"{short}_prod"))
        own = cube.df.groupBy("time").agg(F.count(F.lit(1)).alias("own_size"))
        p = _d(f"{short}_prod")
        family = family.join(size, "time").join(own, "time").select(role, "time", f"{short}_prod", log2(p / F.col("comp_size")).alias(f"{short}_family_size"), log2(p / F.col("own_size")).alias(f"{short}_family_size_new"))
        out = out.join(family, [role, "time"])
    return out.select("modifier", "head", "time", "mod_prod", "mod_family_size", "mod_family_size_new", "head_prod", "head_family_size", "head_family_size_new")


def family_size_distinct(compounds: Cube, early: bool = False) -> DataFrame:
    """Family sizes over distinct pairs: -log2((p+1)/(N-p+1)), or in the early form 1 + log2(N/(p+1)) with products."""
    pairs = compounds.df.select("modifier", "head", "time").distinct()
    n = pairs.groupBy("time").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.join(n, "time")
    for role, short in (("modifier", "mod"), ("head", "head")):
        out = out.join(pairs.groupBy(role, "time").agg(F.count(F.lit(1)).alias(f"{short}_p")), [role, "time"])
        p = _d(f"{short}_p")
        size = 1 + log2(F.col("n") / (p + 1)) if early else -log2((p + 1) / (F.col("n") - p + 1))
        out = out.withColumn(f"{short}_family_size", size)
    cols = ["modifier", "head", "time", "mod_family_size", "head_family_size"]
    if early:
        out = out.withColumn("const_prod", F.col("mod_family_size") * F.col("head_family_size"))
        cols.append("const_prod")
    return out.select(*cols)


def contingency(compounds: Cube) -> DataFrame:
    """a, x_star, star_y, N and the other three cells of the 2x2 table of every pair and bin."""
    pair = compounds.df.groupBy("modifier", "head", "time").agg(F.sum("count").alias("a"))
    x = pair.groupBy("modifier", "time").agg(F.sum("a").alias("x_star"))
    y = pair.groupBy("head", "time").agg(F.sum("a").alias("star_y"))
    n = x.groupBy("time").agg(F.sum("x_star").alias("N"))
    t = pair.join(x, ["modifier", "time"]).join(y, ["head", "time"]).join(n, "time")
    return t.select("modifier", "head", "time", "a", "x_star", "star_y", "N", (F.col("x_star") - F.col("a")).alias("b"), (F.col("star_y") - F.col("a")).alias("c"), (F.col("N") - F.col("x_star") - F.col("star_y") + F.col("a")).alias("d"))


def association(table: DataFrame) -> DataFrame:
    """log_ratio, ppmi and local_mi of contingency tables."""
    a, b, c, d, x, y, n = (_d(k) for k in ("a", "b", "c", "d", "x_star", "star_y", "N"))
    term = lambda cell, row, col: cell * F.coalesce(log2((cell * n + 1) / (row * col + 1)), F.lit(0.0))
    pmi = log2((a * n + 1) / (x * y + 1))
    ratio = 2 * (term(a, x, y) + term(b, x, n - y) + term(c, n - x, y) + term(d, n - x, n - y))
    return table.select("modifier", "head", "time", ratio.alias("log_ratio"), F.greatest(pmi, F.lit(0.0)).alias("ppmi"), (a * pmi).alias("local_mi"))


def association_natural(table: DataFrame, floor: float = 0.001) -> DataFrame:
    """Log-likelihood ratio with natural logarithms and empty cells raised to a floor, and PPMI over the plain product."""
    n, x, y = _d("N"), _d("x_star"), _d("star_y")
    cell = {k: F.when(_d(k) == 0, F.lit(floor)).otherwise(_d(k)) for k in "abcd"}
    expected = {"a": x * y, "b": x * (n - y), "c": (n - x) * y, "d": (n - x) * (n - y)}
    total = F.lit(0.0)
    for k in "abcd":
        e = F.when(expected[k] == 0, F.lit(floor)).otherwise(expected[k])
        total = total + cell[k] * F.ln(cell[k] * n / e)
    plain = log2((_d("a") * n + 1) / (x * y))
    return table.select("modifier", "head", "time", (2 * total).alias("log_ratio_ln"), F.greatest(plain, F.lit(0.0)).alias("ppmi_plain"))


def frequency(table: DataFrame, modifiers: Cube, heads: Cube) -> DataFrame:
    """Frequencies of pair and constituents, their logs and shares; missing shares are 0."""
    m = modifiers.df.groupBy("time").agg(F.sum("count").alias("m_total"))
    h = heads.df.groupBy("time").agg(F.sum("count").alias("h_total"))
    t = table.join(m, "time").join(h, "time")
    out = [F.col(k) for k in ("modifier", "head", "time")] + [F.col("a").alias("comp_freq"), F.col("x_star").alias("mod_freq"), F.col("star_y").alias("head_freq")]
    for name, f, own in (("comp", "a", None), ("mod", "x_star", "m_total"), ("head", "star_y", "h_total")):
        out += [F.log2(1 + _d(f)).alias(f"{name}_tf"), F.coalesce(log2(_d(f) / _d("N")), F.lit(0.0)).alias(f"log_{name}_freq")]
        if own:
            out.append(F.coalesce(log2(_d(f) / _d(own)), F.lit(0.0)).alias(f"log_{name}_freq_new"))
    return t.select(*out)


def log_frequency_early(table: DataFrame) -> DataFrame:
    """log2(N/(f+1)) of pair, modifier and head."""
    logs = [log2(_d("N") / (_d(f) + 1)).alias(f"{name}_log_inv") for name, f in (("comp", "a"), ("mod", "x_star"), ("head", "star_y"))]
    return table.select("modifier", "head", "time", *logs)


def features(compounds: Cube, modifiers: Cube, heads: Cube) -> DataFrame:
    """Productivity, association and frequency features in one row for each pair and bin."""
    on = ["modifier", "head", "time"]
    table = contingency(compounds)
    return productivity(compounds, modifiers, heads).join(association(table), on).join(frequency(table, modifiers, heads), on)
