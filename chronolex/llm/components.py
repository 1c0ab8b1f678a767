"""Connected components of a distributed graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the smallest of the node and its neighbours."""
    near = _both(edges)
    least = stored(near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "least")
    return near.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n"), "least")
    return down.join(least, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b")).filter("a <> b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the smallest node reachable) for every node that has an edge; edges has columns a and b.

    Null ends and loops are ignored; no edges give no rows. Each round is written to the shared folder, and so are the minima
    that it joins, as Spark splits a node with very many edges only where both sides of the join are plain shuffles. The
    number of rounds grows with the logarithm of the longest path; running out of them raises an error rather than giving half a result.
    """
    now = stored(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        now = stored(_small_star(_large_star(now)), "edges")
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            roots = now.select("b").distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
        before = mark
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
