"""Queries of regression subsets, reports, legacy patterns, flags and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.functions import text as tx
from chronolex.operators import assemble, assoc, models, ngrams, vocab
from chronolex.operators.cube import Cube
from chronolex.plans.base import compounds, cooc_sql, query, r, role_sql, rounded, table, with_sql
from chronolex.plans.features import RARE, RATINGS, TABLE, _rare, _ratings, _tag_sql
from chronolex.plans.texts import TOKENS, WIN5, WORDS, _docs
from chronolex.sources import corpora


def _subset_sql(p: str) -> str:
    tag = "_NOUN" if p[1] == "n" else "_PROPN"
    adj = "_ADJ" if p[0] == "a" else tag
    return f"SELECT '{p}' AS pattern, modifier, head, rating FROM x WHERE contains(head, '{tag}') AND contains(modifier, CASE WHEN contains(modifier, 'small_') OR contains(modifier, 'red_') THEN '{adj}' ELSE '{tag}' END)"


@query(with_sql(RATINGS, f"x AS ({_tag_sql(True)})") + " UNION ALL ".join(map(_subset_sql, ("an", "nn", "ap", "pp"))))
def pattern_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_adj = F.col("modifier").isin("small", "red")
    tagged = assemble.tagged(_ratings(spark, sf_dir).withColumn("is_adj", is_adj), F.col("is_adj"), eight=True)
    parts = [assemble.pattern_subset(tagged, p).select(F.lit(p).alias("pattern"), "modifier", "head", "rating") for p in ("an", "nn", "ap", "pp")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT p_partkey, replace(p_name, ' ', '_') AS compound FROM part WHERE replace(p_name, ' ', '_') NOT IN ('red_widget', 'small_ring')")
def named_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_name", " ", "_").alias("compound"))
    return assemble.without_named(p, names=("red_widget", "small_ring"))


@query(with_sql(cooc_sql(), TABLE) + f"SELECT head, time, count(*) AS n, {r('avg(a)', 5)} AS mean, {r('stddev_samp(a)', 5)} AS std, {r('median(a)', 5)} AS median FROM t GROUP BY 1, 2")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assemble.summary(assoc.contingency(compounds(spark, sf_dir)), ["head", "time"], "a"), 5)


@query(with_sql(cooc_sql(), TABLE) + f"SELECT head, {r('avg(m)', 5)} AS mean, {r('stddev_samp(m)', 5)} AS std, count(*) AS n FROM (SELECT head, time, avg(fa) AS m FROM t GROUP BY 1, 2) GROUP BY 1")
def nested_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assemble.nested_summary(assoc.contingency(compounds(spark, sf_dir)), ["head"], "time", "a"), 5)


def _margin(f: str) -> str:
    return f"SELECT '{f}' AS factor, (SELECT sum(s * s / n) FROM (SELECT {f}, count(*) AS n, sum(fa) AS s FROM t GROUP BY 1)) - ss / nn AS ss, (SELECT count(DISTINCT {f}) FROM t) - 1 AS df FROM tot"


@query(with_sql(cooc_sql(), TABLE, "tot AS (SELECT count(*) AS nn, sum(fa) * sum(fa) AS ss, sum(fa * fa) AS q FROM t)", f"m AS ({_margin('time')} UNION ALL {_margin('head')})", "rest AS (SELECT (SELECT q - ss / nn FROM tot) - sum(ss) AS ss_rest, (SELECT nn - 1 FROM tot) - sum(df) AS df_rest FROM m)") + f"SELECT factor, {r('ss', 2)} AS ss, CAST(df AS BIGINT) AS df, {r('ss_rest', 2)} AS ss_rest, CAST(df_rest AS BIGINT) AS df_rest, {r('(ss / df) / (ss_rest / df_rest)', 4)} AS f_value FROM m, rest")
def two_way_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.two_way_anova(assoc.contingency(compounds(spark, sf_dir)).persist(), "time", "head", "a")
    return out.select("factor", F.round("ss", 2).alias("ss"), "df", F.round("ss_rest", 2).alias("ss_rest"), "df_rest", F.round("f_value", 4).alias("f_value"))


REGRESSION = "w AS (SELECT fa, fx FROM t)", "z AS (SELECT regr_slope(fa, fx) AS b, regr_intercept(fa, fx) AS i, regr_r2(fa, fx) AS q, regr_avgx(fa, fx) AS m, regr_sxx(fa, fx) AS sxx, count(*) AS n FROM w)", "e AS (SELECT z.*, (SELECT sum((fa - i - b * fx) * (fa - i - b * fx)) FROM w) / (n - 2) AS v FROM z)"


@query(with_sql(cooc_sql(), TABLE, *REGRESSION) + f"SELECT 'x_star' AS term, {r('b', 5)} AS coefficient, {r('sqrt(v / sxx)', 5)} AS error, {r('b / sqrt(v / sxx)', 4)} AS t, {r('q', 5)} AS r2 FROM e UNION ALL SELECT '(intercept)', {r('i', 4)}, {r('sqrt(v * (1.0 / n + m * m / sxx))', 4)}, {r('i / sqrt(v * (1.0 / n + m * m / sxx))', 4)}, {r('q', 5)} FROM e")
def linear_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients with their errors and t values; p values, which SQL has no function for, are held against an integral in the tests."""
    t = assoc.contingency(compounds(spark, sf_dir)).select(F.col("a").cast("double"), F.col("x_star").cast("double"))
    digits = F.when(F.col("term") == "x_star", 5).otherwise(4)
    out = models.linear_summary(t, "a", ["x_star"])
    fine = lambda c: F.when(digits == 5, F.round(c, 5)).otherwise(F.round(c, 4)).alias(c)
    return out.select("term", fine("coefficient"), fine("error"), F.round("t", 4).alias("t"), F.round("r2", 5).alias("r2"))


CLAWS = "CASE WHEN pos = 'NOUN' THEN 'nn1' WHEN pos = 'VERB' THEN 'vvd' WHEN pos = 'ADJ' THEN 'jj' WHEN pos = 'ADV' THEN 'rr' ELSE 'at' END"


def _legacy_sql() -> str:
    u = lambda k: f"l{k} || '_' || CASE t{k} WHEN 'nn1' THEN 'noun' WHEN 'vvd' THEN 'verb' WHEN 'jj' THEN 'adj' WHEN 'rr' THEN 'adv' END"
    rows = []
    for s in range(4):
        test = " AND ".join([f"t{s} = 'nn1' AND t{s + 1} = 'nn1'", f"regexp_full_match(l{s}, '[a-z.-]+') AND regexp_full_match(l{s + 1}, '[a-z.-]+')", *(f"t{q} <> 'nn1'" for q in (s - 1, s + 2) if 0 <= q < 5)])
        rows += [f"SELECT {u(s)} AS modifier, {u(s + 1)} AS head, {u(q)} AS context FROM g WHERE {test} AND t{q} <> 'at'" for q in range(5) if q not in (s, s + 1)]
    return " UNION ALL ".join(rows)


@query(with_sql(WORDS, TOKENS, f"c AS (SELECT doc_id, k, lemma, {CLAWS} AS tag FROM toks)", "g AS (SELECT * FROM (SELECT lemma AS l0, tag AS t0, " + ", ".join(f"lead(lemma, {k}) OVER o AS l{k}, lead(tag, {k}) OVER o AS t{k}" for k in range(1, 5)) + " FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY k)) WHERE l4 IS NOT NULL)") + f"SELECT modifier, head, context, count(*) AS count FROM ({_legacy_sql()}) GROUP BY 1, 2, 3 HAVING count(*) > 1")
def legacy_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-grams in the older tag set: pairs of singular nouns without a third, contexts of content classes."""
    tag = F.transform("tokens", lambda t: F.struct(t["lemma"].alias("lemma"), F.when(t["pos"] == "NOUN", "nn1").when(t["pos"] == "VERB", "vvd").when(t["pos"] == "ADJ", "jj").when(t["pos"] == "ADV", "rr").otherwise("at").alias("pos")))
    t = ngrams.annotate(_docs(spark, sf_dir), ["doc_id"]).select("doc_id", tag.alias("tokens"))
    grams = ngrams.joined_windows(t, [], name="fivegram_pos")
    return ngrams.legacy_pairs(grams, []).groupBy("modifier", "head", "context").agg(F.count(F.lit(1)).alias("count")).filter("count > 1")


@query(with_sql(WORDS, TOKENS, "d AS (SELECT doc_id, k, lemma, pos = 'NOUN' AND coalesce(lead(pos) OVER o, 'X') = 'NOUN' AS comp FROM toks WINDOW o AS (PARTITION BY doc_id ORDER BY k))", "e AS (SELECT *, coalesce(lead(comp) OVER (PARTITION BY doc_id ORDER BY k), false) AS nxt FROM d)") + "SELECT doc_id, CAST(max(CAST(comp AS INTEGER)) = 1 AS BOOLEAN) AS has_compound, CAST(count(*) FILTER (WHERE comp AND NOT nxt) AS INTEGER) AS runs FROM e GROUP BY 1")
def compound_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency labels stood in for by adjacent nouns: whether a text has compounds, and in how many runs."""
    t = ngrams.annotate(_docs(spark, sf_dir), ["doc_id"]).filter(F.size("tokens") > 0)
    dep = F.transform("tokens", lambda x, k: F.when((x["pos"] == "NOUN") & F.coalesce(F.try_element_at("tokens", k + 2)["pos"] == "NOUN", F.lit(False)), "compound").otherwise("dep"))
    return t.select("doc_id", dep.alias("dep")).select("doc_id", F.exists("dep", lambda d: d == "compound").alias("has_compound"), ngrams.compound_runs(F.col("dep")).alias("runs"))


@query(with_sql(WORDS, TOKENS, WIN5) + "SELECT d.doc_id, count(w.doc_id) AS n_full, CAST(count(w.doc_id) FILTER (WHERE 'ADJ' IN (p0, p1, p2, p3, p4)) AS BIGINT) AS n_adj FROM documents d LEFT JOIN win w ON d.doc_id = w.doc_id GROUP BY 1")
def ngram_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests on the joined form of all of a document's windows: fully tagged ones, and those with an adjective."""
    t = ngrams.annotate(_docs(spark, sf_dir), ["doc_id"])
    g = ngrams.joined_windows(t, ["doc_id"], name="g", outer=True)
    full = tx.fully_tagged(F.col("g")) & (tx.token_count(F.col("g")) == 5) & tx.already_tagged(F.col("g"))
    return g.groupBy("doc_id").agg(F.count_if(full).alias("n_full"), F.count_if(full & F.col("g").rlike("_ADJ( |$)")).alias("n_adj"))


@query(with_sql(RARE, role_sql("modifier", "mr", "cooc_r"), "k AS (SELECT modifier, CAST(sum(count) AS BIGINT) AS count FROM mr GROUP BY 1)") + "SELECT modifier || '_ADJ' AS modifier, count FROM k WHERE regexp_full_match(modifier, '.*[0-9]+')")
def tag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys tagged, stripped and re-grouped; adjectives stay only on heads."""
    c = _rare(spark, sf_dir)
    noun = F.concat("modifier", F.when(F.pmod("time", F.lit(2)) == 0, "_NOUN").otherwise("_PROPN"))
    both = Cube(c.df.withColumn("modifier", noun).withColumn("head", F.concat("modifier", F.lit("_ADJ"))), c.keys).without_tags()
    heads = both.df.select(F.regexp_replace("head", "_NOUN|_PROPN", "").alias("modifier"), "count").groupBy("modifier").agg(F.sum("count").alias("count"))
    return heads.filter(F.col("modifier").rlike("^.*[0-9]+_ADJ$"))


@query("SELECT CAST(count(*) AS BIGINT) AS files_with_rows, CAST((SELECT count(*) FROM lineitem) AS BIGINT) AS rows FROM (SELECT 1)")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by file, from the scan's own metadata."""
    i = corpora.inventory(table(spark, sf_dir, "lineitem")).filter("rows > 0 and bytes > 0")
    return i.agg(F.count_if(F.col("rows") > 0).alias("files_with_rows"), F.sum("rows").alias("rows"))


@query("SELECT d.lang, d.source, count(*) AS n, CAST(count(l.toxic) AS BIGINT) AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count("toxic").alias("labelled"))


@query(with_sql(cooc_sql(), TABLE) + f"SELECT time, modifier, {r('sum(fa) / sum(sum(fa)) OVER (PARTITION BY time)')} AS share FROM t GROUP BY 1, 2")
def modifier_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vocab.share_per_bin(compounds(spark, sf_dir).df, "time", "modifier").drop("count"))


@query(with_sql(cooc_sql(), role_sql("modifier", "mods"), "e AS (SELECT modifier, CAST(sum(count) AS BIGINT) AS m, CAST(count(DISTINCT context) AS BIGINT) AS contexts FROM mods GROUP BY 1)") + f"SELECT modifier, m, contexts, {r('m / CAST(contexts AS DOUBLE)')} AS per_context FROM e")
def constituent_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = compounds(spark, sf_dir).projected("modifier").df.groupBy("modifier").agg(F.sum("count").alias("m"), F.count_distinct("context").alias("contexts"))
    return rounded(m.select("*", (F.col("m").cast("double") / F.col("contexts")).alias("per_context")))
