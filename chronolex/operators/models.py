"""Matrices, regressions and classifiers on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.operators.cube import Cube
from chronolex.operators.order import indexed, mean_ranks
from chronolex.sources.scratch import stored


def coordinate_matrix(entries: DataFrame):
    """A distributed matrix of rows (i long, j long, x double); they stay in the JVM."""
    from pyspark.mllib.common import callMLlibFunc
    from pyspark.mllib.linalg.distributed import CoordinateMatrix

    return CoordinateMatrix(callMLlibFunc("createCoordinateMatrix", entries, 0, 0))


def _cells(cube: Cube, tag: str) -> DataFrame:
    """key (joined), context and x, one row for each."""
    label = F.concat_ws(tag, *(F.col(c).cast("string") for c in cube.row))
    return cube.df.select(label.alias("key"), "context", F.col("count").cast("double").alias("x")).groupBy("key", "context").agg(F.sum("x").alias("x"))


def svd(cube: Cube, k: int, tag: str = "|") -> DataFrame:
    """Rows of a cube in k dimensions (left vectors times singular values), unit length: key (joined), v.

    The cube is summed first, as a cell must be there once; the matrix stays distributed and only k vectors of the
    vocabulary's length reach the driver. The sign of a dimension is arbitrary: compare cosines.
    """
    from pyspark.mllib.common import callMLlibFunc

    cells = stored(_cells(cube, tag), "cells")
    rows, cols = indexed(cells, "key", "i"), indexed(cells, "context", "j")
    entries = cells.join(rows, "key").join(cols, "context").select("i", "j", "x")
    u = coordinate_matrix(entries).toIndexedRowMatrix().computeSVD(k, computeU=True)
    scale = F.array(*(F.lit(float(x)) for x in u.s.toArray()))
    left = callMLlibFunc("getIndexedRows", u.U._java_matrix_wrapper._java_model).toDF("i", "u")
    found = left.select("i", F.zip_with(vector_to_array("u"), scale, lambda x, y: x * y).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return found.join(rows, "i").select("key", F.transform("v", lambda x: F.try_divide(x, norm)).alias("v"))


def svd_project(fit_on: Cube, others: dict[str, Cube], k: int, tag: str = "|") -> DataFrame:
    """Rows of other cubes in the space of one cube's k strongest right vectors: kind, key, v of unit length.

    The right vectors are a row for each context and are joined to the cells; contexts that the fitted cube lacks add nothing.
    """
    cells = stored(_cells(fit_on, tag), "cells")
    rows, cols = indexed(cells, "key", "i"), stored(indexed(cells, "context", "j"), "contexts")
    entries = cells.join(rows, "key").join(cols, "context").select("i", "j", "x")
    v = coordinate_matrix(entries).toIndexedRowMatrix().computeSVD(k, computeU=False).V.toArray()
    right = fit_on.df.sparkSession.createDataFrame([(j, row.tolist()) for j, row in enumerate(v)], "j long, w array<double>")
    space = cols.join(right, "j").select("context", "w")
    out = None
    for kind, cube in others.items():
        part = _cells(cube, tag).join(space, "context")
        part = part.select(F.lit(kind).alias("kind"), "key", F.posexplode(F.transform("w", lambda z: z * F.col("x"))).alias("d", "z")).groupBy("kind", "key", "d").agg(F.sum("z").alias("z"))
        out = part if out is None else out.unionByName(part)
    vec = out.groupBy("kind", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "z"))), lambda t: t["z"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return vec.select("kind", "key", F.transform("v", lambda x: F.try_divide(x, norm)).alias("v"))


def explained(values: list[float]) -> list[float]:
    total = sum(x * x for x in values) or 1.0
    return [x * x / total for x in values]


def projected(fit_on: DataFrame, df: DataFrame, vector: str, k: int, name: str = "v") -> DataFrame:
    """Principal components of one table's vectors, applied to another's."""
    model = PCA(k=k, inputCol="__f", outputCol="__p").fit(fit_on.withColumn("__f", array_to_vector(F.col(vector).cast("array<double>"))))
    return model.transform(df.withColumn("__f", array_to_vector(F.col(vector).cast("array<double>")))).withColumn(name, vector_to_array("__p")).drop("__f", "__p")


def prepared(cols: Sequence[str]) -> Pipeline:
    """Median imputation, columns without variance out, centred and scaled, in `features`."""
    filled = [f"__{c}" for c in cols]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=list(cols), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__raw"), VarianceThresholdSelector(featuresCol="__raw", outputCol="__some", varianceThreshold=1e-9), StandardScaler(inputCol="__some", outputCol="features", withMean=True, withStd=True)])


def selected(fitted, cols: Sequence[str]) -> list[str]:
    """The columns that are left in the features of a fitted `prepared` pipeline, in their order."""
    return [cols[k] for k in fitted.stages[2].selectedFeatures]


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of two columns, ties by mean rank: one row, or one for each group.

    Ranks run on from group to group, which leaves the correlations as they are, so no group is sorted in one task.
    """
    ranked = df.select(*by, a, b).na.drop()
    for c in (a, b):
        ranked = ranked.join(mean_ranks(ranked, [*by, c], f"__r_{c}"), [*by, c])
    return ranked.groupBy(*by).agg(F.corr(f"__r_{a}", f"__r_{b}").alias("rho"))


def products(df: DataFrame, label: str, key: Column, folds: int, seeds: Sequence[int], features: str = "features") -> np.ndarray:
    """Sums of products of (1, features, label) by seed and fold: an array (seed, fold, m, m).

    One pass over the data, whatever is fitted on it later; what reaches the driver has the size of the array.
    """
    fold = F.array(*(F.pmod(F.xxhash64(F.lit(s), key), F.lit(folds)).cast("int") for s in seeds))
    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), fold.alias("f")).filter("y is not null")
    n_seeds = len(seeds)

    def run(batches):
        import pyarrow as pa

        total = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            z = np.column_stack([np.ones(n), b.column("x").flatten().to_numpy().reshape(n, -1), b.column("y").to_numpy()])
            f = b.column("f").flatten().to_numpy().reshape(n, n_seeds)
            if total is None:
                total = np.zeros((n_seeds, folds, z.shape[1], z.shape[1]))
            for s in range(n_seeds):
                for k in range(folds):
                    own = z[f[:, s] == k]
                    total[s, k] += own.T @ own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "value"])

    sums = rows.mapInArrow(run, "k long, value double").groupBy("k").agg(F.sum("value").alias("value")).toPandas().sort_values("k")
    m = round((len(sums) / (n_seeds * folds)) ** 0.5)
    return sums["value"].to_numpy().reshape(n_seeds, folds, m, m)


def penalised(sums: np.ndarray, mixes: np.ndarray, strengths: Sequence[float], sweeps: int = 200, least: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Elastic nets on sums of products, one problem for each row of sums and entry of mixes, at every strength.

    Columns and label are scaled to unit variance, so strengths mean the same for all. Gives weights (strength, problem,
    1 + features) on the data's own scale, intercept first, and the scaled ones without it. All problems go through the
    coordinates together, from the greatest strength to the smallest, each from where the last one ended.
    """
    n, mean = sums[:, 0, 0, None], sums[:, 0, 1:] / sums[:, 0, 0, None]
    cov = sums[:, 1:, 1:] / n[:, :, None] - mean[:, :, None] * mean[:, None, :]
    sd = np.sqrt(np.maximum(np.einsum("pii->pi", cov), 0))
    sd = np.where(sd > 1e-9 * (1 + np.abs(mean)), sd, np.inf)
    corr = cov / (sd[:, :, None] * sd[:, None, :])
    r, g = np.ascontiguousarray(corr[:, :-1, :-1].transpose(1, 2, 0)), np.ascontiguousarray(corr[:, :-1, -1].T)
    b = np.zeros_like(g)
    scaled = np.zeros((len(strengths), *b.T.shape))
    for at in np.argsort(strengths)[::-1]:
        l1, l2 = strengths[at] * mixes, 1 + strengths[at] * (1 - mixes)
        for _ in range(sweeps):
            most = 0.0
            for j, own in enumerate(b):
                x = g[j] + own
                delta = np.sign(x) * np.maximum(np.abs(x) - l1, 0) / l2 - own
                size = float(np.abs(delta).max(initial=0))
                if size:
                    own += delta
                    g -= r[j] * delta
                    most = max(most, size)
            if most < least:
                break
        scaled[at] = b.T
    slope = scaled * np.where(np.isfinite(sd[:, -1:]), sd[:, -1:], 0) / sd[:, :-1]
    return np.concatenate([mean[:, -1:] - (slope * mean[:, :-1]).sum(axis=2, keepdims=True), slope], axis=2), scaled


#: Numbers of the problems that are solved together.
PROBLEM_NUMBERS = 1 << 24
# The grid of the regressions.
MIXES, STRENGTHS, FOLDS, SEEDS = tuple(k / 10 for k in range(1, 11)), tuple(10 ** (-4 + 4 * k / 99) for k in range(100)), 10, tuple(range(10))


def elastic_net(df: DataFrame, label: str, names: Sequence[str], key: Column, folds: int = FOLDS, seeds: Sequence[int] = SEEDS, mixes: Sequence[float] = MIXES, strengths: Sequence[float] = STRENGTHS, features: str = "features") -> tuple[DataFrame, DataFrame]:
    """Cross-validated elastic nets over a grid of mixing weights and strengths, for each seed's folds.

    A row for each seed, mix and strength with the mean R squared of its folds; and a row for each seed and feature with
    the absolute standardised coefficient at the seed's best mix and strength, fitted on all rows, with these, their R squared
    and the rank correlation of the label with what each fold's model predicts for its held-out rows.
    """
    spark, seeds = df.sparkSession, list(seeds)
    sums = products(df, label, key, folds, seeds, features)
    m = sums.shape[-1]
    train = np.repeat((sums.sum(axis=1, keepdims=True) - sums).reshape(-1, m, m), len(mixes), axis=0)
    mix_of = np.tile(np.array(mixes), len(seeds) * folds)
    step = max(1, PROBLEM_NUMBERS // (m * m))
    raw = np.concatenate([penalised(train[at : at + step], mix_of[at : at + step], strengths)[0] for at in range(0, len(train), step)], axis=1)
    raw = raw.reshape(len(strengths), len(seeds), folds, len(mixes), m - 1)
    grid = []
    weights = {}
    for s, seed in enumerate(seeds):
        w = np.concatenate([-raw[:, s], np.ones((*raw[:, s].shape[:3], 1))], axis=3)
        n = np.maximum(sums[s][:, 0, 0], 1)
        sst = sums[s][:, -1, -1] - sums[s][:, 0, -1] ** 2 / n
        some = sst > 1e-9 * np.maximum(sums[s][:, -1, -1], 1)  # folds without rows, or with one label only, tell nothing
        sse = np.einsum("lfai,fij,lfaj->lfa", w[:, some], sums[s][some], w[:, some])
        r2 = (1 - sse / sst[some][None, :, None]).mean(axis=1) if some.any() else np.zeros((len(strengths), len(mixes)))
        grid += [(seed, float(a), float(x), float(r2[k, i])) for k, x in enumerate(strengths) for i, a in enumerate(mixes)]
        k, i = np.unravel_index(np.argmax(r2), r2.shape)
        _, scaled = penalised(sums[s].sum(axis=0)[None], np.array([mixes[i]]), [strengths[k]])
        weights[seed] = (float(mixes[i]), float(strengths[k]), float(r2[k, i]), -w[k, :, i, :-1], np.abs(scaled[0, 0]))
    x, held = F.concat(F.array(F.lit(1.0)), vector_to_array(features)), None
    for seed, (*_, w, _) in weights.items():
        of_fold = F.get(F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in w)), F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int"))
        predicted = F.aggregate(F.zip_with(x, of_fold, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        part = df.select(F.lit(seed).alias("seed"), predicted.alias("prediction"), F.col(label).cast("double").alias("label"))
        held = part if held is None else held.unionByName(part)
    rho = {r["seed"]: r["rho"] for r in spearman(stored(held, "held-out"), "prediction", "label", ["seed"]).collect()}
    best = [(seed, n, float(v), a, x, r2, rho.get(seed)) for seed, (a, x, r2, _, imp) in weights.items() for n, v in zip(names, imp, strict=True)]
    return (
        spark.createDataFrame(grid, "seed int, mix double, strength double, r2 double"),
        spark.createDataFrame(best, "seed int, feature string, importance double, mix double, strength double, r2 double, rho double"),
    )


def best_configurations(report: DataFrame, by: str, n: int, order: Sequence[str]) -> DataFrame:
    """The n rows of the highest value; ties in the order of other columns."""
    return report.orderBy(F.desc(by), *order).limit(n)


def mlp(train: DataFrame, inputs: int, hidden: int = 300, classes: int = 2, steps: int = 100, seed: int = 7):
    return MultilayerPerceptronClassifier(layers=[inputs, hidden, classes], maxIter=steps, seed=seed, blockSize=128).fit(train)


def gbt(train: DataFrame, trees: int = 20, seed: int = 7):
    return GBTClassifier(maxIter=trees, seed=seed).fit(train)


def accuracy(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def false_positives(predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the rows that a classifier takes for real though they are made up."""
    return predicted.filter("label = 0 and prediction = 1").select(*keys)


def correlations(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """a, b and their correlation for every pair of columns; rows with nulls are left out."""
    if method == "pearson":
        full = df.select(*(F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(cols))).na.drop()
        pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols))]
        row = full.agg(*(F.corr(f"c{i}", f"c{j}").alias(f"r{i}_{j}") for i, j in pairs))
        return row.select(F.explode(F.array(*(F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), F.col(f"r{i}_{j}").alias("r")) for i, j in pairs))).alias("x")).select("x.*")
    vec = VectorAssembler(inputCols=list(cols), outputCol="f", handleInvalid="skip").transform(df)
    m = Correlation.corr(vec, "f", method).first()[0].toArray()
    return df.sparkSession.createDataFrame([(a, b, float(m[i][j])) for i, a in enumerate(cols) for j, b in enumerate(cols)], "a string, b string, r double")


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance: sums of squares, degrees of freedom and F."""
    g = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("double")).alias("s"), F.sum(F.col(value).cast("double") ** 2).alias("q"))
    t = g.agg(F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum("q").alias("Q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("B"), F.count(F.lit(1)).alias("k"))
    between, within = F.col("B") - F.col("S") * F.col("S") / F.col("N"), F.col("Q") - F.col("B")
    f = F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(within, F.col("N") - F.col("k")))
    return t.select(between.alias("ss_between"), within.alias("ss_within"), (F.col("k") - 1).alias("df_between"), (F.col("N") - F.col("k")).alias("df_within"), f.alias("f_value"))


def two_way_anova(df: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """Sums of squares, degrees of freedom and F of two factors without interaction, from balanced or unbalanced margins.

    A factor's sum of squares is that of its own margin, so factors of unbalanced tables overlap.
    """
    v = F.col(value).cast("double")
    rows = df.filter(F.col(first).isNotNull() & F.col(second).isNotNull() & v.isNotNull())
    total = rows.agg(F.count(F.lit(1)).alias("N"), F.sum(v).alias("S"), F.sum(v * v).alias("Q"))
    out = None
    for name in (first, second):
        g = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"))
        part = g.agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("B"), F.count(F.lit(1)).alias("k")).select(F.lit(name).alias("factor"), "B", "k")
        out = part if out is None else out.unionByName(part)
    both = out.crossJoin(F.broadcast(total)).select("factor", (F.col("B") - F.col("S") * F.col("S") / F.col("N")).alias("ss"), (F.col("k") - 1).alias("df"), (F.col("Q") - F.col("S") * F.col("S") / F.col("N")).alias("ss_total"), "N")
    rest = both.agg((F.max("ss_total") - F.sum("ss")).alias("ss_rest"), (F.max("N") - 1 - F.sum("df")).alias("df_rest"))
    return both.crossJoin(F.broadcast(rest)).select("factor", "ss", "df", "ss_rest", "df_rest", F.try_divide(F.col("ss") / F.col("df"), F.col("ss_rest") / F.col("df_rest")).alias("f_value"))


def linear_summary(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """Least squares: a row for each term with coefficient, standard error, t and p, and the fit's R squared."""
    data = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="skip").transform(df)
    m = LinearRegression(featuresCol="features", labelCol=label, solver="normal").fit(data)
    s = m.summary
    rows = zip([*cols, "(intercept)"], [*m.coefficients.toArray().tolist(), m.intercept], s.coefficientStandardErrors, s.tValues, s.pValues, strict=True)
    return df.sparkSession.createDataFrame([(n, float(c), float(e), float(t), float(p), float(s.r2)) for n, c, e, t, p in rows], "term string, coefficient double, error double, t double, p double, r2 double")


def accuracy_over_sets(scored: DataFrame, by: str) -> DataFrame:
    """Mean and deviation over negative sets of the accuracy in each."""
    per = scored.groupBy(by).agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("a"))
    return per.agg(F.avg("a").alias("mean"), F.stddev_samp("a").alias("std"), F.count(F.lit(1)).alias("sets"))
