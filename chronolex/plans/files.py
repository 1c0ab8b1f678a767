"""Queries that write the formats of corpora and features to the shared folder and read them with the engine's readers."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.functions import text as tx
from chronolex.operators import vocab
from chronolex.operators.sampling import draw
from chronolex.plans.base import compounds, cooc_sql, query, table, with_sql
from chronolex.sources import corpora, scratch, sinks

PER_YEAR = "SELECT 'c' || o_custkey AS ngram, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS count FROM orders GROUP BY 1, 2"


def _per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.concat(F.lit("c"), F.col("o_custkey")).alias("ngram"), F.year("o_orderdate").alias("year")).agg(F.sum(F.floor("o_totalprice")).alias("count"))


@query(PER_YEAR)
def packed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed shards of packed yearly counts."""
    path = scratch.folder(spark, "shards")
    triple = F.concat_ws(",", F.col("year").cast("string"), F.col("count").cast("string"), F.lit("1"))
    lines = _per_year(spark, sf_dir).groupBy("ngram").agg(F.array_join(F.collect_list(triple), "\t").alias("packed"))
    lines.select(F.concat_ws("\t", "ngram", "packed").alias("value")).write.option("compression", "gzip").text(path)
    return corpora.unpacked(corpora.packed_ngrams(spark, path))


@query(PER_YEAR)
def yearly_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed tab-separated n-gram files with further columns and without a header."""
    path = scratch.folder(spark, "yearly")
    _per_year(spark, sf_dir).withColumn("volumes", F.lit(1)).write.option("sep", "\t").option("compression", "gzip").csv(path)
    return corpora.ngrams_v1(spark, path).select("ngram", "year", "count")


@query("SELECT n_name AS word, CAST(n_nationkey AS VARCHAR) AS first, CAST(n_regionkey AS VARCHAR) AS second FROM nation")
def spaced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns set apart by any white space."""
    path = scratch.folder(spark, "spaced")
    n = table(spark, sf_dir, "nation")
    n.select(F.concat(F.lit("  "), F.col("n_name"), F.lit(" \t "), F.col("n_nationkey"), F.lit("   "), F.col("n_regionkey"))).write.text(path)
    return corpora.whitespace_table(spark, path, ["word", "first", "second"])


@query("SELECT 'regions.zip' AS archive, r_name || '.txt' AS member, r_name || chr(10) || r_regionkey AS text FROM region")
def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of zip archives; the archive here holds a file for each region."""
    path = f"{scratch.folder(spark, 'archives')}/regions.zip"
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        for row in table(spark, sf_dir, "region").select("r_name", "r_regionkey").toLocalIterator():
            z.writestr(f"{row['r_name']}.txt", f"{row['r_name']}\n{row['r_regionkey']}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(content.getvalue()))
    out.close()
    return corpora.zipped(spark, path)


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS title, CAST(floor(epoch(ts)) AS BIGINT) AS created_utc, event_id % 2 = 0 AS is_self FROM events")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts from files of JSON lines, by a declared schema; broken lines are rows of nulls, which a filter drops."""
    path = scratch.folder(spark, "posts")
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("title"), F.unix_timestamp("ts").alias("created_utc"), (F.col("event_id") % 2 == 0).alias("is_self"))
    e.select(F.to_json(F.struct("*")).alias("value")).union(spark.createDataFrame([("{broken",)], "value string")).write.text(path)
    return corpora.posts(spark, path).filter("id is not null").select("id", "title", "created_utc", "is_self")


@query("SELECT n_nationkey AS k, n_name AS name, CAST(NULL AS BIGINT) AS region FROM nation UNION ALL SELECT r_regionkey, r_name, CAST(r_regionkey AS BIGINT) FROM region")
def frames_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames of a pattern; columns that a file lacks are null."""
    path = scratch.folder(spark, "frames")
    table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).write.parquet(f"{path}/part=1")
    table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("region")).write.parquet(f"{path}/part=2")
    return corpora.frames(spark, f"{path}/part=*").select("k", "name", "region")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 200")
def stored_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 200 to 699 of a stored frame."""
    return corpora.row_range(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 200, 700)


@query("SELECT p_partkey, CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'ruddy' WHEN 'small' THEN 'little' ELSE split_part(p_name, ' ', 1) END AS modifier FROM part")
def spelling_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings from a file of word and preferred form."""
    path = scratch.folder(spark, "spelling")
    spark.createDataFrame([("red", "ruddy"), ("small", "little"), ("unused", "never")], "word string, preferred string").coalesce(1).write.option("header", True).csv(path)
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").getItem(0).alias("modifier"))
    return tx.respelled(p, corpora.delimited(spark, path, sep=","), ("modifier",))


@query("SELECT r_regionkey, r_name, CAST(2 AS BIGINT) AS n FROM region")
def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows added to what is there, a header only once for each part."""
    path = scratch.folder(spark, "appended")
    for _ in range(2):
        sinks.append(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), path)
    return corpora.delimited(spark, path, schema="r_regionkey int, r_name string").groupBy("r_regionkey", "r_name").agg(F.count(F.lit(1)).alias("n"))


TWINS = "w AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS DOUBLE) END AS size FROM part)"


@query(with_sql(TWINS) + "SELECT 'na' AS missing, * FROM w UNION ALL SELECT 'med', p_partkey, p_brand, coalesce(size, (SELECT median(size) FROM w)) FROM w")
def feature_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature table with and without imputed values, in folders named after the configuration."""
    path = scratch.folder(spark, "twins")
    size = F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("double"))
    sinks.feature_twins(table(spark, sf_dir, "part").select("p_partkey", "p_brand", size.alias("size")), path, {"cutoff": 0}, ["size"])
    return corpora.delimited(spark, path, schema="p_partkey long, p_brand string, size double").select("missing", "p_partkey", "p_brand", "size")


@query(with_sql(cooc_sql()) + "SELECT modifier, head, context, CAST(time - time % 20 AS INTEGER) AS time, CAST(sum(count) AS BIGINT) AS count FROM cooc GROUP BY ALL")
def cached_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube of twenty years, re-binned from the stored one of ten."""
    folder = scratch.folder(spark, "bins")
    sinks.cached_cube(spark, folder, 10, ("modifier", "head"), lambda: compounds(spark, sf_dir))

    def never():
        raise AssertionError("the stored cube was there")

    sinks.cached_cube(spark, folder, 20, ("modifier", "head"), never)
    return sinks.cached_cube(spark, folder, 20, ("modifier", "head"), never).df.select("modifier", "head", "context", "time", "count")


@query("SELECT r_regionkey, r_name FROM region")
def finished_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An output that is there is not made again."""
    path = scratch.folder(spark, "finished")
    sinks.unless_done(spark, path, lambda: table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    return sinks.unless_done(spark, path, lambda: spark.createDataFrame([], "r_regionkey int, r_name string"))


DECADES = "s AS (SELECT 1900 + 10 * (conv_id % 5) AS decade, conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)"


@query(with_sql(DECADES, "l AS (SELECT decade, arg_min(conv_id, (-n, conv_id)) AS conv_id FROM s GROUP BY 1)") + "SELECT * FROM (SELECT CAST(s.decade AS BIGINT) AS decade, s.conv_id, turn, CASE WHEN k < 2 THEN 'valid' WHEN k > 2 AND k <= 4 THEN 'test' WHEN k >= 6 THEN 'train' END AS part FROM s JOIN l ON s.conv_id = l.conv_id) WHERE part IS NOT NULL")
def decade_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest conversation of each decade, cut into parts."""
    c = table(spark, sf_dir, "conversations").select((1900 + 10 * F.pmod("conv_id", F.lit(5))).alias("decade"), "conv_id", "turn")
    return sinks.document_split(c, "conv_id", "turn", n=2, by=["decade"])


@query("SELECT CAST(concat('0x', substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 8 AS share, count(*) AS n FROM orders GROUP BY 1")
def work_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt out to shares of about one size, the same in every run."""
    return table(spark, sf_dir, "orders").groupBy(draw(F.col("o_orderkey").cast("string"), F.lit(8)).alias("share")).agg(F.count(F.lit(1)).alias("n"))


@query(with_sql(cooc_sql(), "top AS (SELECT context FROM cooc GROUP BY 1 ORDER BY sum(count) DESC, context LIMIT 5)") + "SELECT * FROM cooc WHERE context IN (SELECT context FROM top)")
def listed_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose context is in a stored word list."""
    path = scratch.folder(spark, "contexts")
    c = compounds(spark, sf_dir)
    sinks.word_list(vocab.top_k(c.df, "context", "count", 5), "context", path)
    return c.restricted(corpora.words(spark, path).select(F.col("word").alias("context")), ["context"]).df


@query("SELECT n_nationkey, 1900 + 10 * CAST(n_nationkey % 10 AS INTEGER) AS decade FROM nation")
def file_decades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decades of file names."""
    name = F.concat(F.lit("corpus_"), (1900 + 10 * (F.col("n_nationkey") % 10)).cast("string"), F.lit("s.zip"))
    return table(spark, sf_dir, "nation").select("n_nationkey", tx.decade_of(name).alias("decade"))
