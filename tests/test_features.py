"""Features of tiny cubes against plain recomputation from their definitions."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronolex.operators import assemble, assoc, drift, models, order, sampling, similarity, vocab
from chronolex.operators.cube import Cube, bin_time


@pytest.fixture(scope="module")
def data():
    rng = random.Random(9)
    cells = defaultdict(int)
    for _ in range(300):
        cells[rng.choice("ab"), rng.choice("xyz"), rng.choice("pqrst"), rng.choice([1900, 1912, 1925, 1950])] += rng.randrange(1, 9)
    return dict(cells)


@pytest.fixture(scope="module")
def cubes(spark, data):
    c = Cube(spark.createDataFrame([(*k, v) for k, v in data.items()], "modifier string, head string, context string, time int, count long"), ("modifier", "head"))
    return c, c.projected("modifier"), c.projected("head")


def vectors(data, *keys):
    at = {"m": 0, "h": 1}
    out = defaultdict(lambda: defaultdict(int))
    for k, v in data.items():
        out[(*(k[at[x]] for x in keys), k[3])][k[2]] += v
    return out


def cos(a, b, only=None):
    dot = sum(v * b.get(c, 0) for c, v in a.items() if only is None or c in only)
    return dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))


def test_contingency_example(spark):
    rows = [("m", "h", "c", 0, 10), ("m", "k", "c", 0, 5), ("n", "h", "c", 0, 10), ("n", "k", "c", 0, 75)]
    c = Cube(spark.createDataFrame(rows, "modifier string, head string, context string, time int, count long"), ("modifier", "head"))
    r = assoc.contingency(c).filter("modifier = 'm' and head = 'h'").first()
    assert [r[k] for k in ("a", "b", "c", "d", "x_star", "star_y", "N")] == [10, 5, 10, 75, 15, 20, 100]
    a = assoc.association(assoc.contingency(c)).filter("modifier = 'm' and head = 'h'").first()
    assert a["ppmi"] == pytest.approx(math.log2(1001 / 301)) and a["local_mi"] == pytest.approx(10 * a["ppmi"]) and a["log_ratio"] > 0
    assert assoc.association_natural(assoc.contingency(c)).filter("log_ratio_ln < 0").count() == 0


def test_cosines_blends_and_drift(data, cubes):
    c, m, h = cubes
    vc, vm, vh = vectors(data, "m", "h"), vectors(data, "m"), vectors(data, "h")
    rows = {(r["modifier"], r["head"], r["time"]): r for r in similarity.cosines(c, m, h).collect()}
    assert set(rows) == set(vc)
    for (a, b, t), r in rows.items():
        x, y, z = vc[a, b, t], vm[a, t], vh[b, t]
        sm, sh, sb = cos(x, y), cos(x, z), cos(z, y, only=x)
        assert (r["sim_with_modifier"], r["sim_with_head"], r["sim_bw_constituents"]) == pytest.approx((sm, sh, sb)) and all(0 <= v <= 1 + 1e-9 for v in (sm, sh, sb))
        assert r["beta"] == pytest.approx((sm - sh * sb) / ((sm + sh) * (1 - sb)) if sb < 1 else 0.5)
        assert (r["geom_mean_sim"], r["arith_mean_sim"]) == pytest.approx((math.sqrt(sm * sh), (sm + sh) / 2))
    for r in similarity.blends(c, m, h, similarity.cosines(c, m, h)).collect():
        k = (r["modifier"], r["head"], r["time"])
        x, y, z = vc[k], vm[k[0], k[2]], vh[k[1], k[2]]
        ny, nz, nx = (math.sqrt(sum(v * v for v in u.values())) for u in (y, z, x))
        for name, w in (("0", 0), ("25", 0.25), ("100", 1), ("beta", rows[k]["beta"])):
            blend = {q: w * z[q] / nz + (1 - w) * y[q] / ny for q in x}
            assert r[f"sim_cpf_{name}"] == pytest.approx(sum(x[q] * blend[q] for q in x) / (nx * math.sqrt(sum(v * v for v in blend.values()))))
    for r in drift.change(c, "d").collect():
        times = sorted(t for a, b, t in vc if (a, b) == (r["modifier"], r["head"]))
        k = times.index(r["time"])
        assert r["d"] is None if k == 0 else r["d"] == pytest.approx(cos(vc[r["modifier"], r["head"], times[k]], vc[r["modifier"], r["head"], times[k - 1]]))


def test_ppmi_productivity_and_frequency(data, cubes):
    c, m, h = cubes
    got = {(r["modifier"], r["head"], r["context"], r["time"]): r["count"] for r in assoc.ppmi(c).df.collect()}
    total, x, y = defaultdict(int), defaultdict(int), defaultdict(int)
    for (a, b, q, t), v in data.items():
        total[t] += v
        x[a, b, t] += v
        y[q, t] += v
    want = {k: math.log2(v * total[k[3]] / (x[k[0], k[1], k[3]] * y[k[2], k[3]])) for k, v in data.items()}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0})
    for r in assoc.productivity(c, m, h).collect():
        rows = [k for k in data if k[3] == r["time"]]
        n = sum(k[0] == r["modifier"] for k in rows)
        assert r["mod_prod"] == n and r["mod_family_size"] == pytest.approx(math.log2(n / len(rows)))
    f = assoc.frequency(assoc.contingency(c), m, h).first()
    assert f["mod_tf"] == pytest.approx(math.log2(1 + f["mod_freq"])) and f["log_mod_freq"] == f["log_mod_freq_new"] <= 0


def test_rebin_and_cutoff(data, cubes):
    c = cubes[0]
    for w in (10, 20, 50, 10000, 0):
        r = c.rebinned(w)
        assert r.df.agg(F.sum("count")).first()[0] == sum(data.values())
        assert {x["time"] for x in r.df.collect()} == {0 if not w else k[3] - k[3] % w for k in data}
    sizes = [c.above(k).df.count() for k in (0, 10, 30, 60, 1000)]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] == len(data) and sizes[-1] == 0
    ppmi_once = assoc.ppmi(c.above(10)).df.count()
    assert ppmi_once == assoc.ppmi(c.above(0).above(10)).df.count()
    tagged = Cube(c.df.withColumn("modifier", F.concat("modifier", F.lit("_ADJ"))).withColumn("head", F.concat("head", F.lit("_ADJ"))), c.keys).without_tags()
    assert {r["modifier"] for r in tagged.df.collect()} == {"a", "b"} and {r["head"] for r in tagged.df.collect()} == {"x_ADJ", "y_ADJ", "z_ADJ"}


def test_unseen_pair(spark):
    rows = [("m", "k", "c", 0, 3), ("n", "h", "c", 0, 4), ("n", "h", "d", 0, 3)]
    c = Cube(spark.createDataFrame(rows, "modifier string, head string, context string, time int, count long"), ("modifier", "head"))
    missing = assemble.unseen(spark.createDataFrame([("m", "h")], "modifier string, head string"), c.df.select("time").distinct(), c.df)
    out = {(r["modifier"], r["head"]): r for r in similarity.cosines(c, c.projected("modifier"), c.projected("head"), missing).collect()}
    assert out["m", "h"]["sim_bw_constituents"] == pytest.approx(0.8) and out["m", "h"]["sim_with_modifier"] is None and out["m", "h"]["beta"] == 0.5
    assert out["n", "h"]["sim_bw_constituents"] == pytest.approx(1.0)


def test_settings_and_shares(spark, data, cubes):
    aware = tuple(Cube(x.df.filter("context <> 't'"), x.keys) for x in cubes)
    rows = similarity.settings(aware, cubes).collect()
    assert rows and all(0 < r["perc_token_comp"] <= 1 and 0 <= r["sim_head_settings"] <= 1 + 1e-9 for r in rows)


def test_assembly(spark, cubes):
    t = assoc.contingency(cubes[0])
    wide = assemble.widen(t, ["modifier", "head"], ["a"], [1900, 1912, 1925, 1950])
    long = assemble.lengthen(wide, ["modifier", "head"]).filter("value is not null")
    assert {(r["modifier"], r["head"], r["time"], int(r["value"])) for r in long.collect()} == {(r["modifier"], r["head"], r["time"], r["a"]) for r in t.collect()}
    ratings = spark.createDataFrame([("a", "x", 1.0), ("q", "q", 2.0), ("a", "x", 1.0)], "modifier string, head string, rating double")
    rated = assemble.rated(ratings, wide).collect()
    assert len(rated) == 2 and [r["a:1900"] for r in rated if r["modifier"] == "q"] == [None]
    some = spark.createDataFrame([(1.0, None), (3.0, 2.0), (None, 4.0)], "p double, `q.r` double")
    assert sorted((r[0], r[1]) for r in assemble.medians(some, ["p", "q.r"]).collect()) == [(1.0, 3.0), (2.0, 4.0), (3.0, 2.0)]
    scaled = assemble.min_max(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "p double, q double"), ["p", "q"]).collect()
    assert sorted(str(tuple(r)) for r in scaled) == ["(0.0, 0.0)", "(1.0, 0.0)", "(None, 0.0)"]
    tags = assemble.tagged(ratings.limit(1), F.lit(True), eight=True)
    assert tags.count() == 6 and assemble.tagged(ratings.limit(1), F.lit(False)).count() == 4
    bad = spark.createDataFrame([(float("inf"),), (float("nan"),), (1.0,)], "x double")
    assert [r[0] for r in bad.select(assemble.finite(F.col("x"))).collect()] == [None, None, 1.0]
    assert [assemble.family_of(n) for n in ("sim_cpf_25", "sim_with_head", "perc_token_comp", "ppmi", "mod_tf", "mod_prod", "change_comp")] == ["cordeiro", "cosine", "setting", "info", "freq", "prod", "change"]


def test_vocabulary(spark):
    df = spark.createDataFrame([(t, w, c) for t in (1, 2) for w, c in (("a", 5), ("b", 5), ("c", 1))] + [(2, "d", 9)], "time int, word string, count long")
    assert [r["word"] for r in vocab.top_k(df, "word", "count", 2).collect()] == ["a", "b"]
    assert {(r["time"], r["word"]) for r in vocab.top_k_per(df, "time", "word", "count", 1).collect()} == {(1, "a"), (2, "d")}
    assert {r["word"] for r in vocab.always_present(df, "word", "time", least=1).collect()} == {"a", "b"}
    assert {r["word"]: (r["pattern"], r["present"]) for r in vocab.presence(df, ["word"], [1, 2]).collect()} == {"a": ("11", 2), "b": ("11", 2), "c": ("11", 2), "d": ("01", 1)}
    b = vocab.greedy_buckets(spark.createDataFrame([(k, 4) for k in range(5)] + [(5, 20)], "k int, size int"), "k", "size", 10)
    assert [(r["k"], r["bucket"]) for r in b.orderBy("k").collect()] == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 3)]
    bins = vocab.edges_bin(spark.range(100).select(F.col("id").cast("double").alias("x")), "x")
    assert sorted({(r["bin"]) for r in bins.collect()}) == list(range(1, 11)) and bins.groupBy("bin").count().filter("count = 10").count() == 10


def test_sampling(spark):
    seen = spark.createDataFrame([("m", "h", t) for t in (1990, 2000)] + [("m", "k", 2000), ("n", "h", 1950), ("n", "k", 1950), ("n", "k", 2000)], "modifier string, head string, time int")
    parts = {(r["modifier"], r["head"]): r["part"] for r in sampling.novelty_split(seen, ["modifier", "head"], 1990, 2000).collect()}
    assert parts == {("m", "h"): "valid", ("m", "k"): "test", ("n", "h"): "train", ("n", "k"): "train"}
    pairs = seen.select("modifier", "head").distinct()
    words = spark.createDataFrame([(k, w) for k, w in enumerate("hkxyz")], "slot long, word string")
    neg = sampling.negatives(pairs, words, pairs, "head").collect()
    assert all(r["new_head"] in "xyz" for r in neg) and len({(r["modifier"], r["head"], r["seed"]) for r in neg}) == len(neg) == 40
    turned = sampling.reversed_pairs(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "modifier string, head string")).collect()
    assert sum(r["label"] for r in turned) == 3 and len(turned) == 4
    n = sampling.set_sizes(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b",), ("c",)], "k string"), "k").first()
    assert tuple(n) == (2, 2, 3, 1, 1)


def test_models(spark, cubes):
    v = {r["key"]: r["v"] for r in models.svd(cubes[0], 3).collect()}
    assert len(v) == assoc.contingency(cubes[0]).count() and all(sum(x * x for x in u) == pytest.approx(1.0) for u in v.values())
    ids = order.indexed(spark.createDataFrame([(w,) for w in "cabdca"], "w string").repartition(3), "w", "i").collect()
    assert {r["w"]: r["i"] for r in ids} == {"a": 0, "b": 1, "c": 2, "d": 3}
    ranks = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (2.0, 25.0), (9.0, 90.0)], "prediction double, label double")
    assert models.spearman(ranks, "prediction", "label").first()["rho"] == pytest.approx(0.9486832980505138)
    r = models.correlations(ranks, ["prediction", "label"]).filter("a <> b").first()["r"]
    assert r == pytest.approx(0.997, abs=0.01) and models.correlations(ranks, ["prediction", "label"], "spearman").count() == 4
    f = models.anova(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 7.0)], "g string, v double"), "g", "v").first()
    assert (f["ss_between"], f["ss_within"], f["f_value"]) == (16.0, 4.0, 8.0)
    assert models.explained([3.0, 4.0]) == [0.36, 0.64]


def test_dense(spark):
    df = spark.createDataFrame([("a", 1, [3.0, 4.0]), ("a", 2, [4.0, 3.0]), ("a", 4, [0.0, 0.0])], "k string, time int, v array<float>")
    assert [r["change"] for r in drift.dense_change(df, ["k"], "v").orderBy("time").collect()] == [None, pytest.approx(0.96), None]
    assert similarity.mean_vectors(df, ["k"], "v").first()["v"] == pytest.approx([7 / 3, 7 / 3])
    assert df.filter("time = 1").select(similarity.unit(F.col("v"))).first()[0] == pytest.approx([0.6, 0.8])
    assert spark.range(1).select(bin_time(F.lit(1987), 20)).first()[0] == 1980


def test_negatives_are_drawn_from_all_unseen_words(spark):
    """However dense the table is, every pair gets an unseen word if there is one, each with about the same chance."""
    rng = random.Random(8)
    heads = [f"h{k:02d}" for k in range(30)]
    seen = [(m, h) for m, most in (("a", 29), ("b", 25), ("c", 3), ("d", 30)) for h in rng.sample(heads, most)]
    pairs = spark.createDataFrame(seen, "modifier string, head string")
    words = order.indexed(pairs, "head", "slot").select(F.col("head").alias("word"), "slot")
    got = sampling.negatives(pairs, words, pairs.union(pairs), "head", seeds=40).collect()
    assert len(got) == 40 * (29 + 25 + 3) and not {(r["modifier"], r["new_head"]) for r in got} & set(seen)
    assert len({(r["modifier"], r["head"], r["seed"]) for r in got}) == len(got)
    drawn = [r["new_head"] for r in got if r["modifier"] == "b"]
    assert len(set(drawn)) == 5 and all(drawn.count(h) > 0.7 * len(drawn) / 5 for h in set(drawn))
    turned = sampling.negatives(pairs, order.indexed(pairs, "modifier", "slot").select(F.col("modifier").alias("word"), "slot"), pairs, "modifier", seeds=2).collect()
    assert not {(r["new_modifier"], r["head"]) for r in turned} & set(seen)
    assert {r["head"] for r in turned} == {h for _, h in seen if any((m, h) not in seen for m in "abcd")}


def test_running_totals_and_ranks(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(9)) for k in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(3)
    want, total = {}, 0
    for k, v in sorted(rows):
        total += v
        want[k] = total
    assert {r["k"]: r["t"] for r in order.running(df, ["k"], F.col("v"), "t").collect()} == want
    assert {r["k"]: r["n"] for r in order.numbered(df, [F.desc("k")], "n").collect()} == {k: n + 1 for n, (k, _) in enumerate(sorted(rows, reverse=True))}
    ranks = {r["v"]: r["m"] for r in order.mean_ranks(df, ["v"], "m").collect()}
    values = sorted(v for _, v in rows)
    assert ranks == {v: values.index(v) + (values.count(v) + 1) / 2 for v in set(values)}
    assert order.running(df.filter("false"), ["k"], F.col("v"), "t").count() == 0
    grouped = spark.createDataFrame([(g, float(x), float(x * x if g else -x)) for g in (0, 1) for x in range(8)], "g int, a double, b double")
    assert {r["g"]: round(r["rho"], 9) for r in models.spearman(grouped, "a", "b", ["g"]).collect()} == {0: -1.0, 1: 1.0}


def regression_rows(spark, n=300):
    rng = random.Random(6)
    rows = []
    for k in range(n):
        x = [rng.gauss(0, 1) for _ in range(3)]
        rows.append((k, *x, 7.0, 2 * x[0] - x[1] + 0.3 * rng.gauss(0, 1)))
    return spark.createDataFrame(rows, "k int, a double, b double, c double, flat double, label double")


def test_elastic_nets_equal_those_of_spark(spark):
    from pyspark.ml.regression import LinearRegression

    df, names = regression_rows(spark), ["a", "flat", "b", "c"]
    fitted = models.prepared(names).fit(df)
    assert models.selected(fitted, names) == ["a", "b", "c"]
    sd = df.agg(F.stddev_pop("label")).first()[0]
    data = fitted.transform(df).withColumn("label", F.col("label") / sd)
    sums = models.products(data, "label", F.col("k"), 4, [0, 1])
    assert sums.shape == (2, 4, 5, 5) and sums[0].sum(axis=0)[0, 0] == 300 and models.np.allclose(sums[0].sum(axis=0), sums[1].sum(axis=0))
    for mix, strength in ((0.0, 0.5), (0.5, 0.2), (1.0, 0.1)):
        raw, scaled = models.penalised(sums[0].sum(axis=0)[None], models.np.array([mix]), [strength], least=1e-12)
        spark_fit = LinearRegression(elasticNetParam=mix, regParam=strength, tol=1e-12, maxIter=500).fit(data)
        assert raw[0, 0] == pytest.approx([spark_fit.intercept, *spark_fit.coefficients], abs=5e-3)
    grid, best = models.elastic_net(data, "label", ["a", "b", "c"], F.col("k"), folds=4, seeds=[3, 5], mixes=(0.1, 1.0), strengths=(0.001, 0.1, 1.0))
    assert grid.count() == 12 and best.count() == 6
    for r in best.collect():
        assert r["r2"] > 0.97 and r["rho"] > 0.97 and r["strength"] == 0.001
    weight = {r["feature"]: r["importance"] for r in best.filter("seed = 3").collect()}
    assert weight["a"] > weight["b"] > 0.2 > 0.05 > weight["c"]
    top = models.best_configurations(grid, "r2", 1, ["seed", "mix", "strength"]).first()
    assert top["r2"] == max(r["r2"] for r in grid.collect())


def test_held_out_scores_are_those_of_models_that_never_saw_the_rows(spark):
    np = models.np
    rows = regression_rows(spark, 60)
    df = models.prepared(["a", "b"]).fit(rows).transform(rows)
    sums = models.products(df, "label", F.col("k"), 3, [1])[0]
    rows = df.select("features", "label", F.pmod(F.xxhash64(F.lit(1), F.col("k")), F.lit(3)).alias("fold")).collect()
    x, y, f = np.array([[1, *r["features"]] for r in rows]), np.array([r["label"] for r in rows]), np.array([r["fold"] for r in rows])
    scores = []
    for k in range(3):
        w = np.linalg.lstsq(x[f != k], y[f != k], rcond=None)[0]
        scores.append(1 - ((y[f == k] - x[f == k] @ w) ** 2).sum() / ((y[f == k] - y[f == k].mean()) ** 2).sum())
        raw, _ = models.penalised((sums.sum(axis=0) - sums[k])[None], np.array([1.0]), [0.0], sweeps=5000, least=1e-13)
        assert raw[0, 0] == pytest.approx(w, abs=1e-8)
    grid, _ = models.elastic_net(df, "label", ["a", "b"], F.col("k"), folds=3, seeds=[1], mixes=(1.0,), strengths=(1e-9,))
    assert grid.first()["r2"] == pytest.approx(np.mean(scores), abs=1e-4)


def test_linear_summary_p_values(spark):
    """Against an integral of the t distribution's density."""
    df = regression_rows(spark, 30)
    for r in models.linear_summary(df, "label", ["a", "c"]).collect():
        n, t = 27, abs(r["t"])
        scale = math.gamma((n + 1) / 2) / math.sqrt(n * math.pi) / math.gamma(n / 2)
        step = 1e-3
        area = sum(scale * (1 + (step * (k + 0.5)) ** 2 / n) ** (-(n + 1) / 2) * step for k in range(int(t / step)))
        assert r["p"] == pytest.approx(max(0.0, 1 - 2 * area), abs=2e-3) and r["t"] == pytest.approx(r["coefficient"] / r["error"])


def test_projection_into_a_fitted_space(spark, cubes):
    """With all dimensions the fitted cube's own rows keep their cosines."""
    c = cubes[0]
    v = {r["key"]: r["v"] for r in models.svd_project(c, {"own": c}, 5).collect()}
    whole = defaultdict(dict)
    for r in c.df.collect():
        whole[f"{r['modifier']}|{r['head']}|{r['time']}"][r["context"]] = r["count"]
    assert set(v) == set(whole)
    keys = sorted(v)
    for a, b in zip(keys, keys[1:], strict=False):
        assert sum(x * y for x, y in zip(v[a], v[b], strict=True)) == pytest.approx(cos(whole[a], whole[b]), abs=1e-8)
    assert models.false_positives(spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0), (3, 0, 0.0)], "k int, label int, prediction double"), ["k"]).first()["k"] == 1
