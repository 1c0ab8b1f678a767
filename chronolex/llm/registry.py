"""Queries of the corpus operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.llm import decontam, html_lines, langid, line_dedup, media_mpeg, packing, pii, simhash, token_rollup, toxicity
from chronolex.llm.common import read, stored, work_dir


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.detect(read(spark, sf_dir, "documents"))


def op2_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an MPEG audio stream and read back."""
    return media_mpeg.from_media(media_mpeg.to_media(read(spark, sf_dir, "documents")))


def op3_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that occur earlier."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedupe_lines(docs, removed_col="n_windows")


def token_changes(docs: DataFrame) -> dict[str, DataFrame]:
    """Batches over all documents: loads of the byte vocabulary's counts, deletes of later copies, what remains under a
    version `current` with the byte vocabulary's counts, the same counts with the word vocabulary as a version of its own, and
    a revision of `current` to the word vocabulary."""
    all_docs = stored(token_rollup.token_counts(docs, keep=("source", "lang")), "token-counts")
    least = stored(all_docs.groupBy("text_key").agg(F.min("doc_id").alias("least_id")), "token-heads")  # written, so that Spark can split a text with very many copies
    marked = stored(all_docs.join(least, "text_key").select("source", "lang", "n_byte", "n_word", (~F.col("doc_id").eqNullSafe(F.col("least_id"))).alias("copy")), "token-copies")
    kept = marked.filter("not copy")

    def rows(df: DataFrame, op: str, version: str, n: str, old: F.Column = F.lit(None).cast("long")) -> DataFrame:
        return df.select("source", "lang", F.lit(version).alias("tokenizer"), F.lit(op).alias("op"), F.col(n).alias("n_tokens"), old.alias("old_tokens"))

    return {
        "load": rows(marked, "insert", "byte_bpe_50k", "n_byte"),
        "copies": rows(marked.filter("copy"), "delete", "byte_bpe_50k", "n_byte"),
        "current": rows(kept, "insert", "current", "n_byte"),
        "word": rows(kept, "insert", "word_bpe_49k", "n_word"),
        "retokenised": rows(kept, "revise", "current", "n_word", F.col("n_byte")),
    }


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after all batches; one of them is sent twice, and the first are folded into a snapshot."""
    rollup = token_rollup.Rollup(spark, f"{work_dir(spark)}/rollup-{uuid.uuid4().hex}")
    batches = token_changes(read(spark, sf_dir, "documents"))
    for k, (name, changes) in enumerate(batches.items()):
        rollup.commit(name, changes)
        if k == 1:
            rollup.commit(name, changes)
            rollup.compact()
    return rollup.totals()


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.held_out_predictions(read(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_lines.extract(read(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack_words(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.held_out_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    return decontam.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_mpeg, op3_line_windows, op4_token_rollup, op5_simhash, op6_langid, op7_html, op8_packing, op9_toxicity, op10_decontamination)}

WORDS_SQL = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LEADS = ", ".join(f"lead(w, {k}) OVER o" for k in range(1, decontam.WINDOW))

ORACLE: dict[str, str] = {
    "op10_decontamination": f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
grams AS (
  SELECT DISTINCT item, size, array_to_string(w[k:k + size - 1], ' ') AS g
  FROM (SELECT item, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM grams),
docs AS (SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM docs),
places AS (SELECT doc_id, k, [w, {LEADS}] AS a FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
hits AS (
  SELECT p.doc_id, p.k, p.size, g.item
  FROM (SELECT doc_id, k, size, array_to_string(a[1:size], ' ') AS g FROM places, sizes WHERE a[size] IS NOT NULL) p JOIN grams g ON p.size = g.size AND p.g = g.g),
hit_words AS (SELECT doc_id, count(DISTINCT k + o) AS n_hit FROM (SELECT doc_id, k, unnest(range(0, size)) AS o FROM hits) GROUP BY 1),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items i ON d.doc_id = i.doc_id""",
    "op3_line_windows": """
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
lines AS (
  SELECT doc_id, n, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS body FROM raw),
placed AS (
  SELECT doc_id, n, line, body, sum(CASE WHEN body <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS place FROM lines),
full_lines AS (SELECT doc_id, place, body FROM placed WHERE body <> ''),
windows AS (
  SELECT doc_id, place, body AS l1, lead(body, 1) OVER w AS l2, lead(body, 2) OVER w AS l3 FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
ranked AS (
  SELECT doc_id, place, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, place) AS k FROM windows WHERE l3 IS NOT NULL),
later AS (SELECT doc_id, place FROM ranked WHERE k > 1),
covered AS (SELECT DISTINCT doc_id, place + d AS place FROM later, (VALUES (0), (1), (2)) AS t(d)),
rebuilt AS (
  SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.n) FILTER (WHERE c.place IS NULL) AS text
  FROM placed p LEFT JOIN covered c ON p.doc_id = c.doc_id AND p.place = c.place GROUP BY p.doc_id),
counts AS (SELECT doc_id, count(*) AS n_windows FROM later GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text, CAST(coalesce(c.n_windows, 0) AS BIGINT) AS n_windows
FROM documents d LEFT JOIN rebuilt r ON d.doc_id = r.doc_id LEFT JOIN counts c ON d.doc_id = c.doc_id""",
}
