"""Queries of the word, tag and token functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.functions import text as tx
from chronolex.operators import assemble, assoc, models, ngrams, sampling, similarity
from chronolex.plans.base import all_cubes_sql, compounds, cooc_sql, cubes, query, r, rounded, table, with_sql
from chronolex.plans.features import FREQ, FREQ_COLS, K3, PROD, PROD_COLS, TABLE
from chronolex.plans.texts import CLASSED, N, TOKENS, WIN5, WORDS, _docs, _s, _windows


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each token: doc_id, lemma, pos."""
    return ngrams.annotate(_docs(spark, sf_dir), ["doc_id"]).select("doc_id", F.explode("tokens").alias("t")).select("doc_id", "t.lemma", "t.pos")


@query(with_sql(WORDS, TOKENS, WIN5) + "SELECT time, count(*) AS n FROM win WHERE p0 = 'NOUN' AND p1 = 'NOUN' AND p2 = 'NOUN' AND p3 = 'NOUN' AND p4 = 'NOUN' GROUP BY 1")
def uniform_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of one tag only; the rule-based tagger has no unknown words, so nouns stand in for them."""
    tags = ngrams.annotate(_docs(spark, sf_dir), ["time"]).select("time", F.col("tokens.pos").alias("pos"))
    return ngrams.windows(tags, ["time"], col="pos").filter(tx.all_unknown(F.col("w"), "NOUN")).groupBy("time").agg(F.count(F.lit(1)).alias("n"))


def _merged_sql() -> str:
    p = [f"(({N[k]} OR p{k} = 'ADJ') AND {N[k + 1]})" for k in range(4)]
    left, right = f"({p[0]} AND NOT {N[2]})", f"({p[3]} AND NOT {N[2]})"
    return f"CAST(CASE WHEN {right} AND NOT {left} THEN 5 WHEN {p[2]} AND NOT {N[1]} AND NOT {N[4]} THEN 4 WHEN {p[1]} AND NOT {N[0]} AND NOT {N[3]} THEN 3 WHEN {left} AND {right} THEN 1 WHEN {left} THEN 2 ELSE 0 END AS INTEGER)"


@query(with_sql(WORDS, TOKENS, WIN5) + f"SELECT {_merged_sql()} AS merged_class, count(*) AS n FROM win GROUP BY 1")
def merged_pattern_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noun patterns whose first part may be an adjective."""
    return _windows(spark, sf_dir).groupBy(ngrams.noun_class(F.col("w.pos"), merged=True).alias("merged_class")).agg(F.count(F.lit(1)).alias("n"))


CLEAN_ROWS = " UNION ALL ".join(f"SELECT doc_id, {_s(s)} AS modifier, {_s(s + 1)} AS head, {_s(q)} AS context FROM cls WHERE c = {c}" for c, starts in ((1, (0, 3)), (2, (0,)), (3, (1,)), (4, (2,)), (5, (3,))) for s in starts for q in range(5) if q not in (s, s + 1))
FLAGS = "flags AS (SELECT doc_id, max(CAST(pos = 'NOUN' AND coalesce(nxt, 'X') = 'NOUN' AS INTEGER)) = 1 AS num_comp FROM (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY k) AS nxt FROM toks) GROUP BY 1)"


@query(with_sql(WORDS, TOKENS, WIN5, CLASSED, FLAGS) + f"SELECT modifier, head, context, CAST(1900 + d.doc_id % 100 AS INTEGER) AS year, num_comp, d.lang AS comp_ner_sent, count(*) AS count FROM ({CLEAN_ROWS}) w JOIN flags f ON f.doc_id = w.doc_id JOIN documents d ON d.doc_id = w.doc_id GROUP BY ALL HAVING count(*) > 1")
def cube_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounds of noun patterns by year, with a document's flag and label among the keys (languages stand in for labels)."""
    docs = table(spark, sf_dir, "documents").withColumn("year", (1900 + F.pmod("doc_id", F.lit(100))).cast("int"))
    t = ngrams.annotate(docs, ["year", "lang"])
    pair = F.exists(F.arrays_zip(F.slice("tokens.pos", 1, F.greatest(F.size("tokens") - 1, F.lit(0))).alias("a"), F.slice("tokens.pos", 2, F.size("tokens")).alias("b")), lambda x: (x["a"] == "NOUN") & (x["b"] == "NOUN"))
    rows = t.select("year", "tokens", pair.alias("num_comp"), F.col("lang").alias("comp_ner_sent"))

    def nouns_only(tags: list[str]) -> list[dict]:
        c = ngrams.class_of(tags)
        return [s for s in ngrams.aware_of(c) if s["r"] == "compound"] if c <= 5 else []

    keep = ["year", "num_comp", "comp_ner_sent"]
    slots = ngrams.document_slots(rows, keep, nouns_only, {"modifier": "m", "head": "h", "context": "c"})
    return slots.groupBy("modifier", "head", "context", *keep).agg(F.count(F.lit(1)).alias("count")).filter("count > 1")


@query(with_sql(WORDS, TOKENS) + "SELECT word, count(*) AS n FROM (SELECT CASE WHEN pos = 'NOUN' THEN lemma || '_m' ELSE lemma || '_' || lower(pos) || '_m' END AS word FROM toks WHERE doc_id % 2 = 0 UNION ALL SELECT CASE WHEN pos = 'NOUN' THEN lemma || '_h' ELSE lemma || '_' || lower(pos) || '_h' END FROM toks WHERE doc_id % 2 = 1) GROUP BY 1")
def joint_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a joint space named by their role; documents of even ids stand in for one role."""
    w = _tagged(spark, sf_dir).select("doc_id", F.concat_ws("_", "lemma", F.lower("pos")).alias("w"))
    word = F.when(F.col("doc_id") % 2 == 0, tx.role_suffix(F.col("w"), "modifier")).otherwise(tx.role_suffix(F.col("w"), "head"))
    return w.groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN p_size % 2 = 0 THEN 'NUM' ELSE p_size || '_NOUN' END AS token, count(*) AS n FROM part GROUP BY 1")
def numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numerals as one token."""
    token = F.concat_ws("_", F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "NUM").otherwise("NOUN"))
    return table(spark, sf_dir, "part").groupBy(tx.numerals_as_one(token).alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query(with_sql(WORDS, TOKENS) + "SELECT lemma, pos, count(*) AS n FROM toks WHERE regexp_full_match(lemma, '[a-zA-Z]+') AND pos IN ('NOUN', 'PROPN', 'VERB', 'ADJ', 'ADV') GROUP BY 1, 2")
def symbol_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content words of letters without accents or other symbols."""
    t = _tagged(spark, sf_dir)
    return t.filter(tx.clean_word(F.col("lemma"), F.col("pos"))).groupBy("lemma", "pos").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT split_part(p_name, ' ', 1) AS modifier, p_size % 2 = 0 OR split_part(p_name, ' ', 1) IN ('red', 'small') AS is_adj, count(*) AS n FROM part GROUP BY 1, 2")
def adjective_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjectives by the tag string, or by a list."""
    p = table(spark, sf_dir, "part").select(F.split("p_name", " ").getItem(0).alias("modifier"), F.when(F.col("p_size") % 2 == 0, "a/ADJ_b/NOUN").alias("pos"))
    return p.groupBy("modifier", tx.adjective(F.col("pos"), F.col("modifier"), ("red", "small")).alias("is_adj")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 > 1 THEN CAST(p_size AS DOUBLE) / 2 END AS ratio FROM part")
def finite_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infinities and NaN as null."""
    x = F.when(F.col("p_size") % 5 == 0, float("inf")).when(F.col("p_size") % 5 == 1, float("nan")).otherwise(F.col("p_size").cast("double") / 2)
    return table(spark, sf_dir, "part").select("p_partkey", assemble.finite(x).alias("ratio"))


@query(with_sql(WORDS, TOKENS, "e AS (SELECT doc_id, k, left(lemma, 3) AS ent, pos = 'NOUN' AND coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY k), 'X') = 'NOUN' AS comp FROM toks)", "j AS (SELECT doc_id, string_agg(ent, ' ' ORDER BY k) AS s FROM e WHERE comp GROUP BY 1)") + "SELECT d.doc_id, md5(coalesce(s, '')) AS labels FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id")
def entity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the labels of compound tokens; adjacent nouns stand in for compounds, first letters for labels."""
    t = ngrams.annotate(_docs(spark, sf_dir), ["doc_id"])
    comp = lambda x, k: (x["pos"] == "NOUN") & F.coalesce(F.get("tokens", k + 1)["pos"] == "NOUN", F.lit(False))
    rows = F.transform("tokens", lambda x, k: F.struct(F.when(comp(x, k), "compound").otherwise("dep").alias("dep"), F.substring(x["lemma"], 1, 3).alias("ent")))
    return t.select("doc_id", F.md5(ngrams.compound_labels(rows)).alias("labels"))


@query(with_sql(WORDS, TOKENS) + "SELECT doc_id, CASE WHEN lemma IN ('is', 'are', 'was') AND pos = 'VERB' THEN 'be' ELSE lemma END AS lemma, count(*) AS n FROM toks WHERE pos = 'VERB' GROUP BY 1, 2")
def lemma_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbs by their lemma, where the lookup has one."""
    lookup = spark.createDataFrame([(w, "VERB", "be") for w in ("is", "are", "was")] + [("was", "NOUN", "wa")], "word string, pos string, lemma string")
    t = _tagged(spark, sf_dir).filter("pos = 'VERB'").withColumnRenamed("lemma", "word")
    return tx.lemmas(t, lookup, "word", "pos").groupBy("doc_id", F.col("word").alias("lemma")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, regexp_replace(concat_ws(' ', role, ',', trim(text), '!'), ' ([.,;:!?)]|''s\\b|n''t\\b)', '\\1', 'g') AS body FROM conversations")
def detokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as running text."""
    tokens = F.concat(F.array("role", F.lit(",")), F.split(F.trim("text"), " "), F.array(F.lit("!")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.detokenised(tokens).alias("body"))


@query(with_sql(WORDS, TOKENS, "w2 AS (SELECT t.*, lead(lemma) OVER o AS head, lead(pos) OVER o AS p1, lead(pos, 2) OVER o AS p2, lag(lemma) OVER o AS b1, lead(lemma, 2) OVER o AS a1 FROM toks t WINDOW o AS (PARTITION BY doc_id ORDER BY k))") + "SELECT doc_id, CAST(k AS INTEGER) AS k, lemma AS modifier, head, CASE WHEN CAST('0x' || substr(md5(doc_id || '|' || k), 1, 8) AS BIGINT) % 2 = 0 THEN coalesce(b1, '') ELSE coalesce(a1, '') END AS context FROM w2 WHERE pos = 'NOUN' AND p1 = 'NOUN' AND coalesce(p2, 'X') <> 'NOUN'")
def edge_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent nouns with one of the words at their sides; the other edge is dropped by a repeatable choice."""
    p = ngrams.adjacent_pairs(ngrams.annotate(_docs(spark, sf_dir), ["doc_id"]), ["doc_id"], reach=1)
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("k").cast("string"))
    return p.select("doc_id", "k", "modifier", "head", sampling.edge_choice(F.col("left"), F.col("right"), key).alias("context"))


@query(with_sql(*all_cubes_sql(), PROD, TABLE, FREQ) + f"SELECT * FROM (SELECT {K3}, {PROD_COLS} FROM prod) JOIN (SELECT {K3}, {FREQ_COLS} FROM t JOIN mt USING (time) JOIN ht USING (time)) USING ({K3}) JOIN (SELECT {K3}, a, b, c, d FROM t) USING ({K3})")
def joined_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature tables folded into one by their keys."""
    c, m, h = cubes(spark, sf_dir)
    t = assoc.contingency(c).persist()
    return rounded(similarity.join_all([assoc.productivity(c, m, h), assoc.frequency(t, m, h), t.select("modifier", "head", "time", "a", "b", "c", "d")], ["modifier", "head", "time"]))


@query(with_sql(cooc_sql(), TABLE) + f"SELECT family, {r('sum(v)', 3)} AS total, count(*) AS n FROM (SELECT 'info' AS family, greatest(log2((fa * fn + 1) / (fx * fy + 1)), 0) AS v FROM t UNION ALL SELECT 'freq', log2(1 + fx) FROM t UNION ALL SELECT 'freq', log2(1 + fy) FROM t) GROUP BY 1")
def feature_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features summed by the family that their names' beginnings tell."""
    t = assoc.contingency(compounds(spark, sf_dir))
    f = t.join(assoc.association(t), ["modifier", "head", "time"]).select("ppmi", F.log2(1 + F.col("x_star")).alias("mod_tf"), F.log2(1 + F.col("star_y")).alias("head_tf"))
    rows = F.explode(F.array(*(F.struct(F.lit(assemble.family_of(c)).alias("family"), F.col(c).alias("v")) for c in f.columns)))
    return rounded(f.select(rows.alias("x")).groupBy("x.family").agg(F.sum("x.v").alias("total"), F.count(F.lit(1)).alias("n")), 3)


@query(with_sql(cooc_sql(), TABLE) + f"SELECT * FROM (SELECT {K3}, a FROM t) ORDER BY a DESC, modifier, head, time LIMIT 10")
def best_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows of a report."""
    return models.best_configurations(assoc.contingency(compounds(spark, sf_dir)).select("modifier", "head", "time", "a"), "a", 10, ["modifier", "head", "time"])
