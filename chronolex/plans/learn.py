"""Queries of the matrix, regression and classifier operators. Those with SQL check an identity that SQL can compute."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronolex.operators import assemble, assoc, models, order, sampling, similarity
from chronolex.operators.cube import Cube
from chronolex.plans.base import compounds, cooc_sql, cubes, query, r, role_sql, rounded, table, with_sql
from chronolex.plans.features import PMI, TABLE, _rare
from chronolex.plans.texts import EMB
from chronolex.sources.scratch import stored


def _neighbours(v: DataFrame) -> DataFrame:
    """key, v, and w, the vector of the same word at the time before."""
    before = F.lag("v").over(W.partitionBy(F.split("key", r"\|").getItem(0)).orderBy("key"))
    return v.withColumn("w", before).filter("w is not null")


@query()
def svd_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring rows of the reduced space; cosines do not depend on signs."""
    v = models.svd(compounds(spark, sf_dir).projected("modifier"), 8).select("key", "v")
    return _neighbours(v).select("key", similarity.dense_cosine(F.col("v"), F.col("w")).alias("cosine"))


@query(with_sql(cooc_sql(), role_sql("modifier", "mods"), "s AS (SELECT a.modifier, a.time, a.context, a.count, lag(a.time) OVER (PARTITION BY a.modifier, a.context ORDER BY a.time) AS x FROM mods a)", "times AS (SELECT modifier, time, lag(time) OVER (PARTITION BY modifier ORDER BY time) AS before, sqrt(sum(CAST(count AS DOUBLE) * count)) AS n FROM mods GROUP BY 1, 2)", "d AS (SELECT t.modifier, t.time, sum(CAST(a.count AS DOUBLE) * b.count) AS dot FROM times t JOIN mods a ON a.modifier = t.modifier AND a.time = t.time JOIN mods b ON b.modifier = t.modifier AND b.time = t.before AND b.context = a.context GROUP BY 1, 2)") + f"SELECT t.modifier || '|' || t.time AS key, {r('coalesce(dot, 0) / (t.n * b.n)', 5)} AS cosine FROM times t JOIN times b ON b.modifier = t.modifier AND b.time = t.before LEFT JOIN d ON d.modifier = t.modifier AND d.time = t.time")
def svd_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all dimensions, the cosines of the reduced rows are those of the rows themselves."""
    c = compounds(spark, sf_dir).projected("modifier")
    c = Cube(stored(c.df, "mods"), c.keys)
    n = c.df.agg(F.count_distinct("modifier", "time"), F.count_distinct("context")).first()
    return rounded(_neighbours(models.svd(c, min(n))).select("key", similarity.dense_cosine(F.col("v"), F.col("w")).alias("cosine")), 5)


@query()
def svd_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A space fitted on compounds; modifiers and heads projected, and the cosine of each pair's constituents in it."""
    c = compounds(spark, sf_dir)
    c = Cube(stored(c.df, "compounds"), c.keys)
    v = stored(models.svd_project(c, {"modifier": c.projected("modifier"), "head": c.projected("head")}, 6), "projected")
    pairs = c.df.select("modifier", "head", "time").distinct()
    side = lambda kind: v.filter(F.col("kind") == kind).select(F.split("key", r"\|").getItem(0).alias(kind), F.split("key", r"\|").getItem(1).cast("int").alias("time"), F.col("v").alias(f"v_{kind}"))
    return pairs.join(side("modifier"), ["modifier", "time"]).join(side("head"), ["head", "time"]).select("modifier", "head", "time", similarity.dense_cosine(F.col("v_modifier"), F.col("v_head")).alias("cosine"))


@query()
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return models.projected(e.filter("label = 0"), e.select("vec_id", "embedding"), "embedding", 4).select("vec_id", "v")


@query(with_sql(EMB, "p AS (SELECT a.vec_id, a.v, b.v AS w FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)") + f"SELECT vec_id, {r('list_sum(list_transform(list_zip(v, w), lambda t: (t[1] - t[2]) * (t[1] - t[2])))', 4)} AS distance FROM p")
def pca_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all components, squared distances of projected vectors are those of the vectors themselves."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    v = stored(models.projected(e, e, "embedding", 64).select("vec_id", "v"), "components")
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    d = F.zip_with("v", "w", lambda x, y: x - y)
    return rounded(both.select("vec_id", similarity.dot(d, d).alias("distance")), 4)


def _association(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = assoc.contingency(compounds(spark, sf_dir))
    f = t.join(assoc.association(t), ["modifier", "head", "time"])
    return f.select("modifier", "head", "time", "ppmi", F.log2(F.col("x_star").cast("double")).alias("mod_tf"), F.log2(F.col("a").cast("double")).alias("label"))


MOMENTS = f"f AS (SELECT greatest({PMI}, 0) AS x1, log2(fx) AS x2, log2(fa) AS y FROM t)", "m AS (SELECT corr(x1, x2) AS r, corr(x1, y) AS c1, corr(x2, y) AS c2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, stddev_pop(y) AS s, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM f)", "b AS (SELECT *, ((c1 * 1.1 - r * c2) / (1.21 - r * r)) * s / s1 AS b1, ((c2 * 1.1 - r * c1) / (1.21 - r * r)) * s / s2 AS b2, sign(c2) * greatest(abs(c2) - 0.1, 0) * s / s2 AS l2 FROM m)"


@query(with_sql(cooc_sql(), TABLE, *MOMENTS) + f"SELECT 'ridge' AS method, 'ppmi' AS term, {r('b1', 5)} AS coefficient FROM b UNION ALL SELECT 'ridge', 'mod_tf', {r('b2', 5)} FROM b UNION ALL SELECT 'ridge', '(intercept)', {r('my - b1 * m1 - b2 * m2', 4)} FROM b UNION ALL SELECT 'lasso', 'mod_tf', {r('l2', 5)} FROM b UNION ALL SELECT 'lasso', '(intercept)', {r('my - l2 * m2', 4)} FROM b")
def ridge_lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixing weights 0 and 1 at a strength of 0.1: two features with the one, a single one with the other, which have closed forms."""
    f = stored(_association(spark, sf_dir), "association")
    out = []
    for name, mix, cols in (("ridge", 0.0, ["ppmi", "mod_tf"]), ("lasso", 1.0, ["mod_tf"])):
        data = VectorAssembler(inputCols=cols, outputCol="features").transform(f)
        sums = models.products(data, "label", F.concat_ws("|", "modifier", "head"), 1, [0])[0]
        raw, _ = models.penalised(sums, models.np.array([mix]), [0.1], sweeps=2000, least=1e-14)
        out += [(name, n, round(float(x), 5 if n != "(intercept)" else 4)) for n, x in zip(["(intercept)", *cols], raw[0, 0], strict=True)]
    return spark.createDataFrame(out, "method string, term string, coefficient double")


def _regression(spark: SparkSession, sf_dir: str, **settings) -> tuple[DataFrame, DataFrame]:
    """The mean size of a pair's parts from the pair's features, which do not hold it. Folds are of pairs, not of rows."""
    c = cubes(spark, sf_dir)
    f = assoc.features(*c).join(similarity.cosines(*c), ["modifier", "head", "time"])
    names = [x for x in f.columns if x not in ("modifier", "head", "time")]
    w = F.split("p_name", " ")
    size = table(spark, sf_dir, "part").groupBy(w.getItem(0).alias("modifier"), w.getItem(1).alias("head")).agg(F.avg("p_size").alias("label"))
    rows = stored(f.join(size, ["modifier", "head"]).select("modifier", "head", "time", "label", *(F.col(x).cast("double").alias(x) for x in names)), "regression")
    fitted = models.prepared(names).fit(rows)
    data = stored(fitted.transform(rows).select("modifier", "head", "time", "label", "features"), "prepared")
    return models.elastic_net(data, "label", models.selected(fitted, names), F.concat_ws("|", "modifier", "head"), **settings)


@query()
def elastic_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each seed the importance of every feature at the best of 1000 settings, with R squared and rank correlation."""
    found = _regression(spark, sf_dir)[1]
    family = F.when(F.lit(False), "")
    for n in [x["feature"] for x in found.select("feature").distinct().collect()]:
        family = family.when(F.col("feature") == n, assemble.family_of(n))
    return found.withColumn("family", family.otherwise("other"))


@query()
def best_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best of all settings and seeds."""
    return models.best_configurations(_regression(spark, sf_dir)[0], "r2", 20, ["seed", "mix", "strength"])


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return sampling.hash_split(e.select("vec_id", (F.col("label") % 2).cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features")), F.col("vec_id").cast("string"), 0.8, 1991)


@query()
def mlp_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 hidden units and 100 steps on whole vectors."""
    d = stored(_labelled(spark, sf_dir), "labelled")
    return models.accuracy(models.mlp(d.filter("part = 'train'"), 64).transform(d.filter("part = 'test'")))


@query()
def gbt_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty trees."""
    d = stored(_labelled(spark, sf_dir), "labelled")
    return models.confusion(models.gbt(d.filter("part = 'train'")).transform(d.filter("part = 'test'")))


@query(with_sql(EMB, "x AS (SELECT vec_id, label % 2 AS label, CAST(list_sum(v) > 0 AS INTEGER) AS prediction FROM e)") + "SELECT vec_id FROM x WHERE label = 0 AND prediction = 1")
def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of even labels that a rule takes for odd ones."""
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    d = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).alias("label"), (total > 0).cast("int").alias("prediction"))
    return models.false_positives(d, ["vec_id"])


@query()
def plausibility_over_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen pairs against corrupted ones on the vectors of both constituents: a network for each of ten negative sets, and the
    mean and deviation of their accuracies on held-out pairs."""
    c = _rare(spark, sf_dir)
    c = Cube(stored(c.df, "rare"), c.keys).rebinned(0)
    side = lambda role: models.svd(c.projected(role), 8).select(F.regexp_replace("key", r"\|0$", "").alias(role), F.col("v").alias(f"v_{role}"))
    m, h = (stored(side(x), x) for x in ("modifier", "head"))
    pairs = stored(c.df.select("modifier", "head").distinct(), "pairs")
    words = order.indexed(pairs, "head", "slot").select(F.col("head").alias("word"), "slot")
    made = sampling.negatives(pairs, words, pairs, "head").select("modifier", F.col("new_head").alias("head"), "seed", F.lit(0.0).alias("label"))
    real = pairs.select("modifier", "head", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("seed"), F.lit(1.0).alias("label"))
    rows = real.unionByName(made).join(m, "modifier").join(h, "head").withColumn("features", array_to_vector(F.concat("v_modifier", "v_head")))
    data = stored(sampling.hash_split(rows.select("modifier", "head", "seed", "label", "features"), F.concat_ws("|", "modifier", "head"), 0.8, 1991), "sets")
    size = len(data.select("features").first()[0]) if not data.isEmpty() else 0
    parts = []
    for seed in range(10):
        own = data.filter(F.col("seed") == seed)
        net = models.mlp(own.filter("part = 'train'"), size, hidden=30, steps=30)
        parts.append(net.transform(own.filter("part = 'test'")).select("seed", "label", "prediction"))
    return models.accuracy_over_sets(reduce(DataFrame.unionByName, parts), "seed")
