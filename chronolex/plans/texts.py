"""Queries of text, window, post and embedding operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolex.functions import text as tx
from chronolex.operators import assoc, drift, ngrams, packed, similarity, vocab
from chronolex.operators.cube import Cube, bin_time
from chronolex.plans.base import query, r, rounded, table, values, with_sql
from chronolex.plans.features import LLR, PMI, TABLE
from chronolex.sources import corpora, scratch, sinks
from chronolex.streaming import feed

YEAR = "CAST(1900 + doc_id % 100 AS INTEGER)"  # the documents have no dates
DECADE = "CAST(1900 + doc_id % 100 - doc_id % 10 AS INTEGER)"
WORDS = "words AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[a-zß-öø-ÿ]+') AS w FROM documents)"
TOKENS = f"toks AS (SELECT doc_id, lang, {DECADE} AS time, k, w AS lemma, {ngrams.tag_sql('w')} AS pos FROM (SELECT doc_id, lang, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM words))"


def _leads(n: int) -> str:
    cols = ", ".join(f"lead(lemma, {k}) OVER o AS l{k}, lead(pos, {k}) OVER o AS p{k}" for k in range(1, n))
    return f"SELECT doc_id, time, k, lemma AS l0, pos AS p0, {cols} FROM toks WINDOW o AS (PARTITION BY doc_id ORDER BY k)"


WIN5 = f"win AS (SELECT * FROM ({_leads(5)}) WHERE l4 IS NOT NULL)"
N = [f"(p{k} = 'NOUN')" for k in range(5)]
A = [f"(p{k} = 'ADJ')" for k in range(4)]


def _class_sql() -> str:
    nn = [f"({N[k]} AND {N[k + 1]})" for k in range(4)]
    an = [f"({A[k]} AND {N[k + 1]})" for k in range(4)]
    gap = f"NOT {N[2]}"
    whens = [f"WHEN {an[0]} AND {gap} AND {nn[3]} THEN 12", f"WHEN {nn[0]} AND {gap} AND {an[3]} THEN 11"]
    for base, p in ((6, an), (1, nn)):
        both = f"({p[0]} AND {gap} AND {p[3]})"
        whens += [f"WHEN NOT {both} AND {gap} AND {p[3]} THEN {base + 4}", f"WHEN NOT {N[1]} AND {p[2]} AND NOT {N[4]} THEN {base + 3}", f"WHEN NOT {N[0]} AND {p[1]} AND NOT {N[3]} THEN {base + 2}", f"WHEN NOT {both} AND {p[0]} AND {gap} THEN {base + 1}", f"WHEN {both} THEN {base}"]
    return f"CAST(CASE {' '.join(whens)} ELSE 0 END AS INTEGER)"


CLASSED = f"cls AS (SELECT *, {_class_sql()} AS c FROM win)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("time", bin_time(F.lit(1900) + F.pmod("doc_id", F.lit(100)), 10).cast("int"))


def _windows(spark: SparkSession, sf_dir: str, size: int = 5) -> DataFrame:
    return ngrams.windows(ngrams.annotate(_docs(spark, sf_dir), ["doc_id", "time"]), ["doc_id", "time"], size)


def _joined(spark: SparkSession, sf_dir: str, size: int = 5) -> DataFrame:
    return ngrams.joined_windows(ngrams.annotate(_docs(spark, sf_dir), ["time"]), ["time"], size, name="lemma_pos")


def _slots(spark: SparkSession, sf_dir: str, of, keys: tuple[str, ...], size: int = 5) -> DataFrame:
    names = {k: {"modifier": "m", "head": "h", "word": "m"}[k] for k in keys} | {"context": "c"}
    return ngrams.document_slots(ngrams.annotate(_docs(spark, sf_dir), ["time"]), ["time"], of, names, size)


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("w.pos")
    return _windows(spark, sf_dir).withColumn("comp_class", ngrams.pattern_class(pos)).withColumn("noun_class", ngrams.noun_class(pos))


@query(with_sql(WORDS, TOKENS, "j AS (SELECT doc_id, count(*) AS n, string_agg(lemma || '_' || pos, ' ' ORDER BY k) AS s FROM toks GROUP BY 1)") + "SELECT d.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_tokens, md5(concat_ws(' ', s, CASE WHEN coalesce(n, 0) < 5 THEN rtrim(repeat('eos_X ', CAST(5 - coalesce(n, 0) AS INTEGER))) END)) AS lemma_pos FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id")
def tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens, and a digest of all of them as lemma_POS, short texts padded."""
    t = ngrams.annotate(_docs(spark, sf_dir), ["doc_id"])
    return t.select("doc_id", F.size("tokens").alias("n_tokens"), F.md5(ngrams.lemma_pos(ngrams.padded(F.col("tokens")))).alias("lemma_pos"))


@query(with_sql(WORDS, TOKENS, WIN5) + "SELECT time, p0 || ' ' || p1 || ' ' || p2 || ' ' || p3 || ' ' || p4 AS tags, count(*) AS n FROM win GROUP BY 1, 2")
def fivegrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array_join("w.pos", " ")
    return _windows(spark, sf_dir).groupBy("time", tags.alias("tags")).agg(F.count(F.lit(1)).alias("n"))


@query(with_sql(WORDS, TOKENS, WIN5, "g AS (SELECT time, " + " || ' ' || ".join(f"l{k} || '_' || p{k}" for k in range(5)) + " AS lemma_pos, count(*) AS count FROM win GROUP BY 1, 2)") + "SELECT lemma_pos, time, count FROM g WHERE count > 5")
def fivegram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of whole five-grams above a cutoff."""
    return _joined(spark, sf_dir).groupBy("lemma_pos", "time").agg(F.count(F.lit(1)).alias("count")).filter("count > 5")


@query(with_sql(WORDS, TOKENS, WIN5, "g AS (SELECT time, l0, p0, l1, p1, l2, p2, l3, p3, l4, p4, count(*) AS count FROM win GROUP BY ALL)") + "SELECT time, count(*) AS types, CAST(sum(count) AS BIGINT) AS tokens, CAST(count(*) FILTER (WHERE count > 1) AS BIGINT) AS repeated FROM g GROUP BY 1")
def fivegram_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _joined(spark, sf_dir).groupBy("time", "lemma_pos").agg(F.count(F.lit(1)).alias("count"))
    return g.groupBy("time").agg(F.count(F.lit(1)).alias("types"), F.sum("count").alias("tokens"), F.count_if(F.col("count") > 1).alias("repeated"))


@query(with_sql(WORDS, TOKENS, WIN5, CLASSED) + "SELECT time, c AS comp_class, count(*) AS n FROM cls GROUP BY 1, 2")
def pattern_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classed(spark, sf_dir).groupBy("time", "comp_class").agg(F.count(F.lit(1)).alias("n"))


BOTH = f"({N[0]} AND {N[1]} AND NOT {N[2]} AND {N[3]} AND {N[4]})"


@query(with_sql(WORDS, TOKENS, WIN5) + f"SELECT CAST(CASE WHEN {BOTH} THEN 1 WHEN {N[0]} AND {N[1]} AND NOT {N[2]} THEN 2 WHEN {N[3]} AND {N[4]} AND NOT {N[2]} THEN 5 WHEN {N[1]} AND {N[2]} AND NOT {N[0]} AND NOT {N[3]} THEN 3 WHEN {N[2]} AND {N[3]} AND NOT {N[1]} AND NOT {N[4]} THEN 4 ELSE 0 END AS INTEGER) AS noun_class, count(*) AS n FROM win GROUP BY 1")
def noun_pattern_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classed(spark, sf_dir).groupBy("noun_class").agg(F.count(F.lit(1)).alias("n"))


def _s(k: int) -> str:
    return f"l{k} || '_' || p{k}"


def _aware_sql(role: str) -> str:
    rows = []
    for c, starts in ngrams.PAIR_AT.items():
        for s in starts:
            if role == "compound":
                rows += [f"SELECT {_s(s)} AS modifier, {_s(s + 1)} AS head, {_s(q)} AS context, time FROM cls WHERE c = {c}" for q in range(5) if q not in (s, s + 1)]
            else:
                own = s if role == "modifier" else s + 1
                rows += [f"SELECT {_s(own)} AS {role}, {_s(q)} AS context, time FROM cls WHERE c = {c}" for q in range(5) if q != own and abs(q - own) <= 3]
    return " UNION ALL ".join(rows)


def _cut_sql(slots: str, keys: str, cutoff: int) -> str:
    n = len(keys.split(",")) + 2
    return f"SELECT * EXCLUDE (mass) FROM (SELECT *, sum(count) OVER (PARTITION BY {keys}, time) AS mass FROM (SELECT {keys}, context, time, count(*) AS count FROM ({slots}) GROUP BY {', '.join(str(k + 1) for k in range(n))})) WHERE mass > {cutoff}"


@query(with_sql(WORDS, TOKENS, WIN5, CLASSED) + _cut_sql(_aware_sql("compound"), "modifier, head", 10))
def cube_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounds inside patterns, above a cutoff of 10."""
    slots = _slots(spark, sf_dir, lambda tags: [s for s in ngrams.aware_slots_of(tags) if s["r"] == "compound"], ("modifier", "head"))
    return ngrams.cube_of(slots, ("modifier", "head")).above(10).df


@query(with_sql(WORDS, TOKENS, WIN5, CLASSED) + _cut_sql(_aware_sql("modifier"), "modifier", 50))
def cube_aware_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = _slots(spark, sf_dir, lambda tags: [s for s in ngrams.aware_slots_of(tags) if s["r"] == "modifier"], ("modifier",))
    return ngrams.cube_of(slots, ("modifier",)).above(50).df


@query(with_sql(WORDS, TOKENS, WIN5, CLASSED) + _cut_sql(_aware_sql("head"), "head", 50))
def cube_aware_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = _slots(spark, sf_dir, lambda tags: [s for s in ngrams.aware_slots_of(tags) if s["r"] == "head"], ("head",))
    return ngrams.cube_of(slots, ("head",)).above(50).df


def _phrase_sql() -> str:
    outside = {0: (2,), 1: (0, 3), 2: (1, 4), 3: (2,)}
    rows = []
    for s in range(4):
        free = " AND ".join(f"NOT {N[q]}" for q in outside[s])
        for first in (N[s], A[s]):
            rows += [f"SELECT {_s(s)} AS modifier, {_s(s + 1)} AS head, {_s(q)} AS context, time FROM win WHERE {first} AND {N[s + 1]} AND {free}" for q in range(5) if q not in (s, s + 1)]
    return " UNION ALL ".join(rows)


@query(with_sql(WORDS, TOKENS, WIN5) + _cut_sql(_phrase_sql(), "modifier, head", 20))
def cube_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any pattern match, patterns not exclusive, above a cutoff of 20."""
    return ngrams.cube_of(_slots(spark, sf_dir, ngrams.phrases_of, ("modifier", "head")), ("modifier", "head")).above(20).df


WORD_SQL = " UNION ALL ".join(f"SELECT {_s(k)} AS word, {_s(q)} AS context, time FROM win WHERE p{k} IN ('NOUN', 'PROPN', 'ADJ')" for k in range(5) for q in range(5) if q != k and abs(q - k) <= 3)


@query(with_sql(WORDS, TOKENS, WIN5) + _cut_sql(WORD_SQL, "word", 200))
def cube_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nouns and adjectives with their windows, above a cutoff of 200."""
    return packed.neighbour_cube(ngrams.annotate(_docs(spark, sf_dir), ["time"]), 200).df


def _linked_sql(link: tuple[str, ...], head_first: bool) -> str:
    n, rows = len(link) + 2, []
    for s in range(5 - n + 1):
        e = s + n - 1
        a, b = (e, s) if head_first else (s, e)
        test = " AND ".join([N[s], N[e], *(f"l{s + 1 + k} = '{w}'" for k, w in enumerate(link))])
        rows += [f"SELECT {_s(a)} AS modifier, {_s(b)} AS head, {_s(q)} AS context, time FROM win WHERE {test}" for q in range(5) if not s <= q <= e]
    return "SELECT modifier, head, context, time, count(*) AS count FROM (" + " UNION ALL ".join(rows) + ") GROUP BY 1, 2, 3, 4"


@query(with_sql(WORDS, TOKENS, WIN5) + f"SELECT 'of' AS link, * FROM ({_linked_sql(('of',), True)}) UNION ALL SELECT 'of the', * FROM ({_linked_sql(('of', 'the'), True)}) UNION ALL SELECT 's', * FROM ({_linked_sql(('s',), False)})")
def linked_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _windows(spark, sf_dir)
    parts = [ngrams.cube_of(ngrams.linked_slots(w, ["time"], link, first), ("modifier", "head")).df.select(F.lit(" ".join(link)).alias("link"), "*") for link, first in ((("of",), True), (("of", "the"), True), (("s",), False))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _four_sql() -> str:
    rows = []
    for s in range(3):
        test = " AND ".join([N[s], N[s + 1], *(f"NOT {N[q]}" for q in (s - 1, s + 2) if 0 <= q < 4)])
        rows += [f"SELECT {_s(s)} AS modifier, {_s(s + 1)} AS head, {_s(q)} AS context, time FROM w4 WHERE {test}" for q in range(4) if q not in (s, s + 1)]
    return " UNION ALL ".join(rows)


@query(with_sql(WORDS, TOKENS, f"w4 AS (SELECT * FROM ({_leads(4)}) WHERE l3 IS NOT NULL)") + _cut_sql(_four_sql(), "modifier, head", 10))
def cube_fourgrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.cube_of(_slots(spark, sf_dir, ngrams.fours_of, ("modifier", "head"), 4), ("modifier", "head")).above(10).df


@query(with_sql(WORDS, TOKENS, f"w2 AS (SELECT t.*, lead(lemma) OVER o AS head, lead(pos) OVER o AS p1, lead(pos, 2) OVER o AS p2, lag(lemma, 2) OVER o AS b2, lag(lemma) OVER o AS b1, lead(lemma, 2) OVER o AS a1, lead(lemma, 3) OVER o AS a2 FROM toks t WINDOW o AS (PARTITION BY doc_id ORDER BY k))") + "SELECT doc_id, CAST(k AS INTEGER) AS k, lemma AS modifier, head, concat_ws(' ', b2, b1) AS \"left\", concat_ws(' ', a1, a2) AS \"right\" FROM w2 WHERE lang <> 'xx' AND pos = 'NOUN' AND p1 = 'NOUN' AND coalesce(p2, 'X') <> 'NOUN'")
def adjacent_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ngrams.annotate(_docs(spark, sf_dir).filter("lang <> 'xx'"), ["doc_id"])
    return ngrams.adjacent_pairs(t, ["doc_id"])


@query(with_sql(WORDS, TOKENS) + "SELECT time, lemma || '_' || pos AS modifier, head || '_' || p1 AS head, count(*) AS count FROM (SELECT *, lead(lemma) OVER o AS head, lead(pos) OVER o AS p1 FROM toks WINDOW o AS (PARTITION BY doc_id ORDER BY k)) WHERE pos IN ('NOUN', 'VERB', 'ADJ') AND p1 IN ('NOUN', 'VERB', 'ADJ') GROUP BY 1, 2, 3 HAVING count(*) > 3")
def bigram_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _joined(spark, sf_dir, 2).select("time", F.split("lemma_pos", " ").alias("g"))
    g = g.select("time", F.col("g").getItem(0).alias("modifier"), F.col("g").getItem(1).alias("head"))
    ok = F.col("modifier").rlike("_(NOUN|VERB|ADJ)$") & F.col("head").rlike("_(NOUN|VERB|ADJ)$")
    return g.filter(ok).groupBy("time", "modifier", "head").agg(F.count(F.lit(1)).alias("count")).filter("count > 3")


@query(with_sql(WORDS, TOKENS) + "SELECT lemma, pos, count(*) AS count FROM toks WHERE pos IN ('NOUN', 'PROPN', 'VERB', 'ADJ', 'ADV') GROUP BY 1, 2")
def vocab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.content_counts(ngrams.annotate(_docs(spark, sf_dir), []))


@query(with_sql(WORDS, TOKENS, "c AS (SELECT time, lemma, count(*) AS count FROM toks GROUP BY 1, 2)", "k AS (SELECT *, row_number() OVER (PARTITION BY time ORDER BY count DESC, lemma) AS k FROM c)") + "SELECT DISTINCT lemma FROM k WHERE k <= 200")
def context_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of each decade's most frequent words."""
    t = ngrams.annotate(_docs(spark, sf_dir), ["time"]).select("time", F.explode("tokens.lemma").alias("lemma"), F.lit(1).alias("count"))
    return vocab.top_k_per(t, "time", "lemma", "count", 200).select("lemma").distinct()


@query(with_sql(WORDS, TOKENS, "c AS (SELECT lemma, time, count(*) AS n FROM toks GROUP BY 1, 2 HAVING count(*) > 10)") + "SELECT lemma, CAST(sum(n) AS BIGINT) AS count FROM c GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT time) FROM toks)")
def words_every_decade(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ngrams.annotate(_docs(spark, sf_dir), ["time"]).select("time", F.explode("tokens.lemma").alias("lemma")).groupBy("time", "lemma").agg(F.count(F.lit(1)).alias("count"))
    return vocab.always_present(t.persist(), "lemma", "time", least=10)


def _scores_sql() -> str:
    counts = ", ".join(f"len(list_filter(w, lambda x: list_contains({list(ws)}, x))) AS {lang}" for lang, ws in tx.FUNCTION_WORDS.items())
    rows = ", ".join(f"{{'p': {lang} / t, 'lang': '{lang}'}}" for lang in tx.FUNCTION_WORDS)
    return f"n AS (SELECT doc_id, {counts} FROM words), s AS (SELECT doc_id, list_filter(list_reverse_sort([{rows}]), lambda x: x.p >= 0.1) AS s FROM (SELECT *, CAST({' + '.join(tx.FUNCTION_WORDS)} AS DOUBLE) AS t FROM n) WHERE t > 0)"


@query(with_sql(WORDS, _scores_sql()) + "SELECT s[1].lang AS lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(doc_id) AS BIGINT) AS ids FROM s JOIN documents d USING (doc_id) WHERE len(s) = 1 OR abs(s[1].p - s[2].p) / (s[1].p + s[2].p) > 0.1 GROUP BY 1")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose best language is well ahead of the second, by shares of function words; scores under 0.1 are no labels."""
    scores = tx.language_scores(ngrams.words_of(F.col("text")))
    d = table(spark, sf_dir, "documents").withColumn("s", scores).filter(tx.confident(F.transform("s", lambda x: x["p"])))
    return d.groupBy(F.col("s")[0]["lang"].alias("lang")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.sum("doc_id").alias("ids"))


@query(with_sql(WORDS, TOKENS) + "SELECT doc_id, count(*) AS n_tokens, CAST(count(*) FILTER (WHERE pos = 'NOUN') AS BIGINT) AS n_nouns, CAST(count(*) FILTER (WHERE pos = 'DET') AS BIGINT) AS n_dets FROM toks GROUP BY 1")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ngrams.annotate(_docs(spark, sf_dir), ["doc_id"]).filter(F.size("tokens") > 0)
    n = lambda tag: F.size(F.filter("tokens", lambda x: x["pos"] == tag)).cast("long")
    return t.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), n("NOUN").alias("n_nouns"), n("DET").alias("n_dets"))


@query("SELECT o_custkey AS ngram, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS count FROM orders GROUP BY 1, 2")
def unpack_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of packed counts, as a raw shard has them, taken apart again."""
    per_year = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum(F.floor("o_totalprice")).alias("c"))
    lines = per_year.groupBy("o_custkey").agg(F.array_join(F.collect_list(F.concat_ws(",", F.col("y").cast("string"), F.col("c").cast("string"), F.lit("1"))), "\t").alias("packed"))
    lines = lines.select(F.concat_ws("\t", F.col("o_custkey").cast("string"), "packed").alias("value"))
    return corpora.unpacked(corpora.split_packed(lines)).select(F.col("ngram").cast("long").alias("ngram"), "year", "count")


POSTS = "trim(text) <> '' AND trim(text) <> '[deleted]'" + "".join(f" AND NOT starts_with(trim(text), '{b}')" for b in tx.BOILERPLATE)


@query(f"SELECT conv_id, turn, trim(regexp_replace(concat_ws(' ', role, text), '\\s+', ' ', 'g')) AS body FROM conversations WHERE {POSTS}")
def posts_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter(tx.wanted_post(F.col("text")))
    return c.select("conv_id", "turn", tx.post_text(F.col("role"), F.col("text")).alias("body"))


@query("SELECT t.topic, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations JOIN (VALUES ('user', 'ask'), ('assistant', 'answer')) t(role, topic) USING (role) GROUP BY 1")
def posts_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = spark.createDataFrame([("User", "ask"), ("Assistant", "answer")], "role string, topic string")
    return tx.with_topic(table(spark, sf_dir, "conversations"), topics, "role").groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON posts by a declared schema."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    return corpora.json_posts(e, "props", T.StructType.fromDDL("k long")).select("event_id", "event_type", "k")


@query("SELECT event_type, CAST(year(ts) AS INTEGER) AS year, count(*) AS count FROM events GROUP BY 1, 2")
def posts_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch seconds to years."""
    e = table(spark, sf_dir, "events").select("event_type", F.unix_timestamp("ts").alias("created_utc"))
    return e.groupBy("event_type", corpora.year_of(F.col("created_utc")).alias("year")).agg(F.count(F.lit(1)).alias("count"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '\\|p[0-9]+|\\||@@[0-9]*|</?P>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.clean_tagged_text(F.col("text"))).alias("digest"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS modifier, split_part(p_name, ' ', 2) AS head, CASE WHEN split_part(p_name, ' ', 1) = 'red' THEN 'ruddy' ELSE split_part(p_name, ' ', 1) END AS respelled, TRY_CAST(p_brand AS DOUBLE) AS number, CAST(levenshtein(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) AS INTEGER) AS distance FROM part")
def parse_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in rating spelling taken apart, respelled and measured."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", tx.rating_pair(F.regexp_replace("p_name", " ", "-n ")).alias("p"))
    p = p.select("p_partkey", "p.modifier", "p.head", F.col("p.modifier").alias("respelled"), tx.number(F.col("p_brand")).alias("number"), tx.spelling_distance(F.col("p.modifier"), F.col("p.head")).alias("distance"))
    return tx.respelled(p, spark.createDataFrame([("red", "ruddy")], "word string, preferred string"), ("respelled",))


@query("SELECT p_size, p_brand, count(*) AS n, CAST(count(*) FILTER (WHERE (CAST(p_size % 2 = 0 AS INTEGER) + CAST(p_size % 3 = 0 AS INTEGER) + CAST(p_size % 5 = 0 AS INTEGER)) >= 2) AS BIGINT) AS opaque FROM part GROUP BY 1, 2")
def vote_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = [(F.col("p_size") % k == 0).cast("int") for k in (2, 3, 5)]
    return table(spark, sf_dir, "part").groupBy("p_size", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(tx.opaque(*votes)).alias("opaque"))


EMB = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(with_sql(EMB, "p AS (SELECT *, lead(v) OVER (ORDER BY vec_id) AS w FROM e)") + f"SELECT vec_id, {r('list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w)))', 5)} AS cosine FROM p WHERE w IS NOT NULL")
def emb_cos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector with the next one's, joined on ids; the ids are dense."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w"))
    return rounded(e.join(nxt, "vec_id").select("vec_id", similarity.dense_cosine(F.col("embedding"), F.col("w")).alias("cosine")), 5)


@query(with_sql(EMB, "p AS (SELECT a.vec_id, a.v AS x, b.v AS y, c.v AS z FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2)", "s AS (SELECT vec_id, z, list_transform(list_zip(x, y), lambda t: t[1] + t[2]) AS s FROM p)") + f"SELECT vec_id, {r('list_dot_product(s, z) / (sqrt(list_dot_product(s, s)) * sqrt(list_dot_product(z, z)))', 5)} AS cosine FROM s")
def emb_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive composition of two vectors against a third."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    y, z = (e.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(n)) for k, n in ((1, "y"), (2, "z")))
    s = similarity.composed(F.col("embedding"), F.col("y"))
    return rounded(e.join(y, "vec_id").join(z, "vec_id").select("vec_id", similarity.dense_cosine(s, F.col("z")).alias("cosine")), 5)


@query(with_sql(EMB, "u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM e)") + f"SELECT label, CAST(k - 1 AS INTEGER) AS k, {r('avg(x)', 5)} AS x FROM u GROUP BY 1, 2")
def emb_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = similarity.mean_vectors(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return rounded(m.select("label", F.posexplode("embedding").alias("k", "x")), 5)


@query(with_sql(EMB, "p AS (SELECT *, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM e)") + f"SELECT label, vec_id, {r('list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w)))', 5)} AS change FROM p")
def emb_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.dense_change(table(spark, sf_dir, "embeddings"), ["label"], "embedding", time="vec_id"), 5)


DENSE = "cooc AS (SELECT 'l' || label AS modifier, 'h' || vec_id % 20 AS head, CAST(vec_id % 3 AS INTEGER) AS time, list_sum(list_transform(v, lambda x: x + 1)) AS count FROM e)"


@query(with_sql(EMB, DENSE, TABLE.replace("AS BIGINT", "AS DOUBLE")) + f"SELECT modifier, head, time, {r('fa', 3)} AS a, {r('fx', 3)} AS x_star, {r('fy', 3)} AS star_y, {r(LLR, 3)} AS log_ratio, {r(f'greatest({PMI}, 0)', 5)} AS ppmi, {r(f'fa * ({PMI})', 3)} AS local_mi FROM t")
def emb_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense variant of association: a vector's mass is the sum of its values plus one, and pairs of labels and shares of
    the vectors are the table's rows and columns."""
    mass = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") + 1)
    name = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    cells = table(spark, sf_dir, "embeddings").select(name("l", F.col("label")).alias("modifier"), name("h", F.col("vec_id") % 20).alias("head"), F.lit("all").alias("context"), (F.col("vec_id") % 3).cast("int").alias("time"), mass.alias("count"))
    t = assoc.contingency(Cube(cells, ("modifier", "head"))).persist()
    both = t.join(assoc.association(t), ["modifier", "head", "time"])
    return both.select("modifier", "head", "time", *((F.round(c, n) + F.lit(0.0)).alias(c) for c, n in (("a", 3), ("x_star", 3), ("star_y", 3), ("log_ratio", 3), ("ppmi", 5), ("local_mi", 3))))


@query("SELECT CAST(decade AS INTEGER) AS decade, count(*) AS n, CAST(sum(q) AS BIGINT) AS q FROM (SELECT year(l_shipdate) - year(l_shipdate) % 10 AS decade, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY 1")
def decade_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with a folder for each decade and read back with the folders as a column."""
    path = scratch.folder(spark, "decades")
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("time"), F.col("l_quantity").cast("long").alias("q"))
    sinks.by_decade(rows, path)
    return spark.read.parquet(path).groupBy("decade").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"))


@query("SELECT n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features appended as tab-separated text under their configuration and read back with a schema."""
    path = scratch.folder(spark, "tsv")
    sinks.feature_table(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, {"cutoff": 0, "setting": "aware"})
    return corpora.delimited(spark, path, schema="n_nationkey int, n_name string, n_regionkey long").select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT lower(text) AS lemma, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(n_name), '[a-z]+')) AS text FROM nation) GROUP BY 1")
def word_list_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.folder(spark, "words")
    sinks.word_list(table(spark, sf_dir, "nation").select(F.explode(ngrams.words_of(F.col("n_name"))).alias("w")), "w", path)
    return corpora.words(spark, path).groupBy(F.col("word").alias("lemma")).agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("s AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)", "l AS (SELECT conv_id FROM s ORDER BY n DESC, conv_id LIMIT 1)") + "SELECT * FROM (SELECT conv_id, turn, CASE WHEN k < 2 THEN 'valid' WHEN k > 2 AND k <= 4 THEN 'test' WHEN k >= 6 THEN 'train' END AS part FROM s WHERE conv_id = (SELECT conv_id FROM l)) WHERE part IS NOT NULL")
def document_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return sinks.document_split(c, "conv_id", "turn", n=2)


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def config_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which configurations there are; the long form of a pivoted inventory, whose columns are the values that occur."""
    d = table(spark, sf_dir, "documents").select("source", "lang")
    found = values(d, "lang")
    names = [f"lang {k}" for k in range(len(found))]
    wide = d.groupBy("source").agg(*(F.nullif(F.count_if(F.col("lang").eqNullSafe(F.lit(x))), F.lit(0)).alias(n) for n, x in zip(names, found, strict=True)))
    lang = F.get(F.array(*map(F.lit, found)), F.substring("name", 6, 9).cast("int"))
    return wide.unpivot(["source"], names, "name", "n").filter("n is not null").select("source", lang.cast("string").alias("lang"), "n")


@query(f"""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type || '_NOUN' AS lemma_pos, count(*) AS count FROM events GROUP BY 1, 2""")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The social feed as a stream: JSON files in, event-time windows out, a window's last update once the stream has drained.

    Windows behind the watermark are dropped from the state; a repeated batch overwrites its own folder."""
    folder, name = scratch.folder(spark, "feed"), "feed_" + scratch.folder(spark, "q").rsplit("-", 1)[-1]
    e = table(spark, sf_dir, "events").select(F.unix_timestamp("ts").alias("created_utc"), F.regexp_replace("event_type", "_", "").alias("selftext"))
    e.coalesce(4).write.json(folder)
    posts = feed.read(spark, folder, T.StructType.fromDDL("created_utc long, selftext string")).withColumn("created_at", F.timestamp_seconds("created_utc"))
    counts = feed.windowed_counts(posts, width="1 day", late="2 days", size=1).select(F.col("window.start").alias("start"), F.regexp_replace("lemma_pos", "_.*", "_NOUN").alias("lemma_pos"), "count")
    path = scratch.folder(spark, "feed-out")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    q = counts.writeStream.outputMode("update").option("checkpointLocation", scratch.folder(spark, "feed-state")).queryName(name).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.parquet(path).groupBy("start", "lemma_pos").agg(F.max_by("count", "epoch").alias("count"))
