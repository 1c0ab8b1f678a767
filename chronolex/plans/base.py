"""Registration of queries, and the cubes that the driver tables stand for."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.operators.cube import Cube, compounds_from

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Years of shipment in the driver's tables, for SQL, which needs its columns named; and the aware setting.
YEARS = (1995, 1996, 1997, 1998, 1999, 2000, 2001)
AWARE = "l_returnflag = 'N'"


def query(sql: str | None = None):
    """Register a query under its function's name; sql is the same in DuckDB's dialect."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))


def compounds(spark: SparkSession, sf_dir: str, where: str | None = None) -> Cube:
    """Name words of parts as modifier and head, suppliers as contexts, years of shipment as time, quantities as counts."""
    rows = facts(spark, sf_dir)
    rows = rows.filter(where) if where else rows
    return compounds_from(rows, "p_name", F.concat(F.lit("s"), F.col("l_suppkey")), F.year("l_shipdate"), F.col("l_quantity").cast("long"))


def cubes(spark: SparkSession, sf_dir: str, where: str | None = None, width: int | None = None) -> tuple[Cube, Cube, Cube]:
    """Compounds, modifiers and heads. The compounds are kept in memory or on disk: each feature reads them several times."""
    c = compounds(spark, sf_dir, where)
    if width is not None:
        c = c.rebinned(width)
    c = Cube(c.df.persist(), c.keys)
    return c, c.projected("modifier"), c.projected("head")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show; no negative zeros."""
    cols = [(F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f"`{f.name}`") for f in df.schema]
    return df.select(*cols)


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def cooc_sql(where: str | None = None, name: str = "cooc", time: str = "CAST(year(l_shipdate) AS INTEGER)") -> str:
    return f"""{name} AS (
  SELECT split_part(p_name, ' ', 1) AS modifier, split_part(p_name, ' ', 2) AS head, 's' || l_suppkey AS context, {time} AS time, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS count
  FROM lineitem JOIN part ON l_partkey = p_partkey {f"WHERE {where}" if where else ""} GROUP BY 1, 2, 3, 4)"""


def role_sql(role: str, name: str, cube: str = "cooc") -> str:
    return f"{name} AS (SELECT {role}, context, time, CAST(sum(count) AS BIGINT) AS count FROM {cube} GROUP BY 1, 2, 3)"


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def all_cubes_sql(where: str | None = None, suffix: str = "") -> Iterable[str]:
    c = f"cooc{suffix}"
    return cooc_sql(where, c), role_sql("modifier", f"mods{suffix}", c), role_sql("head", f"heads{suffix}", c)


def values(df: DataFrame, col: str) -> list:
    """The distinct values of a column of few, sorted; null last."""
    found = [r[0] for r in df.select(col).distinct().collect()]
    return sorted((x for x in found if x is not None)) + [None] * (None in found)
