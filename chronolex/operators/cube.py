"""Co-occurrence cubes: long tables (keys…, context, time, count), one row for each key, context and time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_time(time: Column | str, width: int) -> Column:
    """The first year of the bin of this width; width 0, like any width beyond the years, is one bin, 0."""
    t = F.col(time) if isinstance(time, str) else time
    return F.lit(0) if width == 0 else (t - F.pmod(t, F.lit(width))).cast("int")


@dataclass(frozen=True)
class Cube:
    """A cube and the names of its key columns; context, time and count have fixed names."""

    df: DataFrame
    keys: tuple[str, ...]

    @property
    def cell(self) -> list[str]:
        return [*self.keys, "context", "time"]

    @property
    def row(self) -> list[str]:
        return [*self.keys, "time"]

    def regrouped(self, df: DataFrame | None = None, keys: Sequence[str] | None = None) -> Cube:
        """One row a cell again, after keys, contexts or times were rewritten."""
        keys = tuple(keys or self.keys)
        df = self.df if df is None else df
        return Cube(df.groupBy(*keys, "context", "time").agg(F.sum("count").alias("count")), keys)

    def rebinned(self, width: int) -> Cube:
        return self.regrouped(self.df.withColumn("time", bin_time("time", width)))

    def projected(self, *keys: str) -> Cube:
        """The cube of some of the keys, such as modifiers from compounds."""
        return self.regrouped(keys=keys)

    def mass(self) -> DataFrame:
        return self.df.groupBy(*self.row).agg(F.sum("count").alias("mass"))

    def above(self, cutoff: int) -> Cube:
        """Keys whose counts in a bin sum to more than the cutoff. A group-by and a join: a frequent key's rows stay spread.

        The join is an inner one with distinct keys: a semi join would be pushed below the cube's own sums, and raw rows would
        be shuffled. So the cube's shuffle is there once and read by both sides.
        """
        if not cutoff:
            return self
        kept = self.mass().filter(F.col("mass") > cutoff).drop("mass")
        return Cube(self.df.join(kept, self.row).select(*self.df.columns), self.keys)

    def restricted(self, words: DataFrame, on: Sequence[str]) -> Cube:
        """Cells whose columns `on` are in a word list. Below the cube's sums or above them, the list is joined early if short."""
        return Cube(self.df.join(words.select(*on).distinct(), list(on)).select(*self.df.columns), self.keys)

    def without_tags(self) -> Cube:
        """Keys without their part-of-speech suffix; only a head keeps _ADJ."""
        df = self.df
        for k in self.keys:
            df = df.withColumn(k, F.regexp_replace(k, "_NOUN|_PROPN" if k == "head" else "_NOUN|_PROPN|_ADJ", ""))
        return self.regrouped(df)


def compounds_from(facts: DataFrame, name: str, context: Column, time: Column, count: Column) -> Cube:
    """A (modifier, head) cube of facts with a two-word name column."""
    words = F.split(F.col(name), " ")
    df = facts.select(words.getItem(0).alias("modifier"), words.getItem(1).alias("head"), context.alias("context"), time.alias("time"), count.alias("count"))
    return Cube(df, ("modifier", "head")).regrouped()
