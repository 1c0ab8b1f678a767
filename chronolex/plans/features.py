"""Queries of cube, association, similarity, drift and assembly operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.operators import assemble, assoc, drift, models, order, sampling, similarity, vocab
from chronolex.operators.cube import Cube, bin_time
from chronolex.plans.base import AWARE, YEARS, all_cubes_sql, compounds, cooc_sql, cubes, query, r, role_sql, rounded, table, values, with_sql

KEYS = ["modifier", "head", "time"]
K3 = "modifier, head, time"


@query(with_sql(cooc_sql()) + "SELECT * FROM cooc")
def cooc_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compounds(spark, sf_dir).df


def _rebin(width: int):
    expr = "0" if width == 0 else f"time - time % {width}"

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compounds(spark, sf_dir).rebinned(width).df

    f.__name__ = f"time_rebin_{width}"
    query(with_sql(cooc_sql()) + f"SELECT modifier, head, context, CAST({expr} AS INTEGER) AS time, CAST(sum(count) AS BIGINT) AS count FROM cooc GROUP BY 1, 2, 3, 4")(f)


for _w in (0, 10, 20, 50, 100, 10000):
    _rebin(_w)


@query(with_sql(*all_cubes_sql()) + "SELECT 'modifier' AS role, modifier AS word, context, time, count FROM mods UNION ALL SELECT 'head', head, context, time, count FROM heads")
def role_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, m, h = cubes(spark, sf_dir)
    part = lambda cube, role: cube.df.select(F.lit(role).alias("role"), F.col(role).alias("word"), "context", "time", "count")
    return part(m, "modifier").unionByName(part(h, "head"))


@query("""SELECT l_linenumber AS slot, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS count FROM lineitem WHERE year(l_shipdate) BETWEEN 1996 AND 1999 AND l_linestatus <> 'X' GROUP BY 1""")
def decade_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(F.year("l_shipdate").between(1996, 1999) & (F.col("l_linestatus") != "X"))
    return rows.groupBy(F.col("l_linenumber").alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("count"))


def _brand(spark: SparkSession, sf_dir: str) -> Cube:
    """Brands as modifiers: bins of a wide range of mass, on which the reference grid's cutoffs bite."""
    from chronolex.plans.base import facts

    rows = facts(spark, sf_dir).select(F.col("p_brand").alias("modifier"), F.split("p_name", " ").getItem(1).alias("head"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("context"), F.year("l_shipdate").alias("time"), F.col("l_quantity").cast("long").alias("count"))
    return Cube(rows, ("modifier", "head")).regrouped()


BRAND = """brand AS (SELECT p_brand AS modifier, split_part(p_name, ' ', 2) AS head, 's' || l_suppkey AS context, CAST(year(l_shipdate) AS INTEGER) AS time, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS count
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4)"""


@query(with_sql(BRAND, "m AS (SELECT *, sum(count) OVER (PARTITION BY modifier, head, time) AS mass FROM brand)") + " UNION ALL ".join(f"SELECT {k} AS cutoff, time, count(*) AS rows, CAST(sum(count) AS BIGINT) AS count FROM m WHERE mass > {k} GROUP BY 2" for k in (0, 10, 50, 100, 500, 1000)))
def cutoff_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cutoff starts from the base cube."""
    base = _brand(spark, sf_dir)
    base = Cube(base.df.persist(), base.keys)
    parts = [base.above(k).df.groupBy("time").agg(F.count(F.lit(1)).alias("rows"), F.sum("count").alias("count")).select(F.lit(k).alias("cutoff"), "time", "rows", "count") for k in (0, 10, 50, 100, 500, 1000)]
    return reduce(DataFrame.unionByName, parts)


@query(with_sql(BRAND) + "SELECT * EXCLUDE (mass) FROM (SELECT *, sum(count) OVER (PARTITION BY modifier, head, time) AS mass FROM brand) WHERE mass > 500")
def cutoff_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brand(spark, sf_dir).above(500).df


PPMI = """p AS (SELECT *, sum(count) OVER (PARTITION BY modifier, head, time) AS x, sum(count) OVER (PARTITION BY context, time) AS y, sum(count) OVER (PARTITION BY time) AS n FROM cooc)"""


@query(with_sql(cooc_sql(), PPMI, "w AS (SELECT modifier, head, context, time, log2(CAST(count AS DOUBLE) * n / (CAST(x AS DOUBLE) * y)) AS w FROM p)") + f"SELECT modifier, head, context, time, {r('w')} AS count FROM w WHERE w >= 0")
def ppmi_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assoc.ppmi(compounds(spark, sf_dir)).df)


@query(with_sql(cooc_sql(), PPMI) + f"SELECT modifier, head, context, time, {r('greatest(log2(CAST(count AS DOUBLE) * n / (x * pow(CAST(y AS DOUBLE), 0.75))), 0.0)')} AS count FROM p")
def ppmi_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assoc.ppmi(compounds(spark, sf_dir), alpha=0.75, keep_negative_as_zero=True).df)


PROD = """cs AS (SELECT time, count(*) AS comp_size FROM cooc GROUP BY 1), ms AS (SELECT time, count(*) AS own FROM mods GROUP BY 1), hs AS (SELECT time, count(*) AS own FROM heads GROUP BY 1),
mp AS (SELECT modifier, time, count(*) AS p FROM cooc GROUP BY 1, 2), hp AS (SELECT head, time, count(*) AS p FROM cooc GROUP BY 1, 2),
pairs AS (SELECT DISTINCT modifier, head, time FROM cooc),
prod AS (SELECT pairs.*, mp.p AS mod_prod, log2(mp.p / comp_size) AS mod_family_size, log2(mp.p / ms.own) AS mod_family_size_new, hp.p AS head_prod, log2(hp.p / comp_size) AS head_family_size, log2(hp.p / hs.own) AS head_family_size_new
  FROM pairs JOIN mp USING (modifier, time) JOIN hp USING (head, time) JOIN cs USING (time) JOIN ms USING (time) JOIN hs USING (time))"""
PROD_COLS = ", ".join(["mod_prod", f"{r('mod_family_size')} AS mod_family_size", f"{r('mod_family_size_new')} AS mod_family_size_new", "head_prod", f"{r('head_family_size')} AS head_family_size", f"{r('head_family_size_new')} AS head_family_size_new"])


@query(with_sql(*all_cubes_sql(), PROD) + f"SELECT {K3}, {PROD_COLS} FROM prod")
def productivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assoc.productivity(*cubes(spark, sf_dir)))


FAMILY = """pairs AS (SELECT DISTINCT modifier, head, time FROM brand), n AS (SELECT time, count(*) AS n FROM pairs GROUP BY 1), mp AS (SELECT modifier, time, count(*) AS p FROM pairs GROUP BY 1, 2), hp AS (SELECT head, time, count(*) AS p FROM pairs GROUP BY 1, 2),
f AS (SELECT pairs.*, n, mp.p AS mp, hp.p AS hp FROM pairs JOIN n USING (time) JOIN mp USING (modifier, time) JOIN hp USING (head, time))"""


@query(with_sql(BRAND, FAMILY) + f"SELECT {K3}, {r('-log2((mp + 1) / (n - mp + 1))')} AS mod_family_size, {r('-log2((hp + 1) / (n - hp + 1))')} AS head_family_size FROM f")
def family_size_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assoc.family_size_distinct(_brand(spark, sf_dir)))


@query(with_sql(BRAND, FAMILY) + f"SELECT {K3}, {r('1 + log2(n / (mp + 1))')} AS mod_family_size, {r('1 + log2(n / (hp + 1))')} AS head_family_size, {r('(1 + log2(n / (mp + 1))) * (1 + log2(n / (hp + 1)))')} AS const_prod FROM f")
def family_size_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assoc.family_size_distinct(_brand(spark, sf_dir), early=True))


TABLE = """a AS (SELECT modifier, head, time, CAST(sum(count) AS BIGINT) AS a FROM cooc GROUP BY 1, 2, 3),
ct AS (SELECT *, CAST(sum(a) OVER (PARTITION BY modifier, time) AS BIGINT) AS x_star, CAST(sum(a) OVER (PARTITION BY head, time) AS BIGINT) AS star_y, CAST(sum(a) OVER (PARTITION BY time) AS BIGINT) AS N FROM a),
t AS (SELECT *, x_star - a AS b, star_y - a AS c, N - x_star - star_y + a AS d, CAST(a AS DOUBLE) AS fa, CAST(x_star AS DOUBLE) AS fx, CAST(star_y AS DOUBLE) AS fy, CAST(N AS DOUBLE) AS fn FROM ct)"""
LLR = "2 * (fa * log2((fa * fn + 1) / (fx * fy + 1)) + b * log2((b * fn + 1) / (fx * (fn - fy) + 1)) + c * log2((c * fn + 1) / ((fn - fx) * fy + 1)) + d * coalesce(log2((d * fn + 1) / ((fn - fx) * (fn - fy) + 1)), 0))"
PMI = "log2((fa * fn + 1) / (fx * fy + 1))"
ASSOC_COLS = f"{r(LLR, 4)} AS log_ratio, {r(f'greatest({PMI}, 0)')} AS ppmi, {r(f'fa * {PMI}', 4)} AS local_mi"


@query(with_sql(cooc_sql(), TABLE) + f"SELECT {K3}, a, x_star, star_y, N, b, c, d FROM t")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assoc.contingency(compounds(spark, sf_dir))


def _coarse(df: DataFrame, cols: tuple[str, ...], digits: int = 4) -> DataFrame:
    return rounded(df.select(*(F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns)))


@query(with_sql(cooc_sql(), TABLE) + f"SELECT {K3}, {ASSOC_COLS} FROM t")
def llr_pmi_lmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coarse(assoc.association(assoc.contingency(compounds(spark, sf_dir))), ("log_ratio", "local_mi"))


def _ln(cell: str, e: str) -> str:
    c = f"CASE WHEN {cell} = 0 THEN 0.001 ELSE CAST({cell} AS DOUBLE) END"
    return f"({c}) * ln(({c}) * fn / (CASE WHEN {e} = 0 THEN 0.001 ELSE {e} END))"


@query(with_sql(cooc_sql(), TABLE) + f"SELECT {K3}, {r('2 * (' + ' + '.join((_ln('a', 'fx * fy'), _ln('b', 'fx * (fn - fy)'), _ln('c', '(fn - fx) * fy'), _ln('d', '(fn - fx) * (fn - fy)'))) + ')', 4)} AS log_ratio_ln, {r('greatest(log2((fa * fn + 1) / (fx * fy)), 0)')} AS ppmi_plain FROM t")
def llr_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coarse(assoc.association_natural(assoc.contingency(compounds(spark, sf_dir))), ("log_ratio_ln",))


FREQ = """mt AS (SELECT time, sum(count) AS m FROM mods GROUP BY 1), ht AS (SELECT time, sum(count) AS h FROM heads GROUP BY 1)"""
FREQ_COLS = f"a AS comp_freq, x_star AS mod_freq, star_y AS head_freq, {r('log2(1 + fa)')} AS comp_tf, {r('log2(fa / fn)')} AS log_comp_freq, {r('log2(1 + fx)')} AS mod_tf, {r('log2(fx / fn)')} AS log_mod_freq, {r('log2(fx / m)')} AS log_mod_freq_new, {r('log2(1 + fy)')} AS head_tf, {r('log2(fy / fn)')} AS log_head_freq, {r('log2(fy / h)')} AS log_head_freq_new"


@query(with_sql(*all_cubes_sql(), TABLE, FREQ) + f"SELECT {K3}, {FREQ_COLS} FROM t JOIN mt USING (time) JOIN ht USING (time)")
def freq_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m, h = cubes(spark, sf_dir)
    return rounded(assoc.frequency(assoc.contingency(c), m, h))


@query(with_sql(cooc_sql(), TABLE) + f"SELECT {K3}, {r('log2(fn / (fa + 1))')} AS comp_log_inv, {r('log2(fn / (fx + 1))')} AS mod_log_inv, {r('log2(fn / (fy + 1))')} AS head_log_inv FROM t")
def log_freq_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assoc.log_frequency_early(assoc.contingency(compounds(spark, sf_dir))))


@query(with_sql(*all_cubes_sql(), TABLE, FREQ, PROD) + f"SELECT {K3}, {PROD_COLS}, {ASSOC_COLS}, {FREQ_COLS} FROM t JOIN mt USING (time) JOIN ht USING (time) JOIN prod USING (modifier, head, time)")
def assoc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coarse(assoc.features(*cubes(spark, sf_dir)), ("log_ratio", "local_mi"))


NORMS = """nc AS (SELECT modifier, head, time, sqrt(sum(CAST(count AS DOUBLE) * count)) AS nc FROM cooc GROUP BY 1, 2, 3), nm AS (SELECT modifier, time, sqrt(sum(CAST(count AS DOUBLE) * count)) AS nm FROM mods GROUP BY 1, 2), nh AS (SELECT head, time, sqrt(sum(CAST(count AS DOUBLE) * count)) AS nh FROM heads GROUP BY 1, 2)"""
COS = """sm AS (SELECT c.modifier, c.head, c.time, sum(CAST(c.count AS DOUBLE) * m.count) AS dot FROM cooc c JOIN mods m USING (modifier, context, time) GROUP BY 1, 2, 3),
sh AS (SELECT c.modifier, c.head, c.time, sum(CAST(c.count AS DOUBLE) * h.count) AS dot FROM cooc c JOIN heads h USING (head, context, time) GROUP BY 1, 2, 3),
sb AS (SELECT c.modifier, c.head, c.time, sum(CAST(m.count AS DOUBLE) * h.count) AS dot FROM cooc c JOIN mods m USING (modifier, context, time) JOIN heads h USING (head, context, time) GROUP BY 1, 2, 3),
cos AS (SELECT modifier, head, time, sm.dot / (nc * nm) AS sim_with_modifier, sh.dot / (nc * nh) AS sim_with_head, sb.dot / (nm * nh) AS sim_bw_constituents
  FROM sm JOIN sh USING (modifier, head, time) JOIN sb USING (modifier, head, time) JOIN nc USING (modifier, head, time) JOIN nm USING (modifier, time) JOIN nh USING (head, time)),
bt AS (SELECT *, coalesce((sim_with_modifier - sim_with_head * sim_bw_constituents) / nullif((sim_with_modifier + sim_with_head) * (1 - sim_bw_constituents), 0), 0.5) AS beta FROM cos)"""
COS_COLS = f"{r('sim_with_modifier')} AS sim_with_modifier, {r('sim_with_head')} AS sim_with_head, {r('sim_bw_constituents')} AS sim_bw_constituents, {r('beta')} AS beta, {r('sqrt(sim_with_modifier * sim_with_head)')} AS geom_mean_sim, {r('(sim_with_modifier + sim_with_head) / 2')} AS arith_mean_sim"


@query(with_sql(*all_cubes_sql(), NORMS, COS) + f"SELECT {K3}, {COS_COLS} FROM bt")
def cosine_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.cosines(*cubes(spark, sf_dir)))


def _blend_sql() -> str:
    parts = []
    for name, b in similarity.BLENDS:
        z = "(beta * hv + (1 - beta) * mv)" if b is None else f"({b} * hv + {1 - b} * mv)"
        parts.append(f"{r(f'sum(v * {z}) / (sqrt(sum({z} * {z})) * any_value(nc))')} AS sim_cpf_{name}")
    return ", ".join(parts)


@query(with_sql(*all_cubes_sql(), NORMS, COS, "z AS (SELECT c.modifier, c.head, c.time, CAST(c.count AS DOUBLE) AS v, h.count / nh AS hv, m.count / nm AS mv, nc, beta FROM cooc c JOIN mods m USING (modifier, context, time) JOIN heads h USING (head, context, time) JOIN nm USING (modifier, time) JOIN nh USING (head, time) JOIN nc USING (modifier, head, time) JOIN bt USING (modifier, head, time))") + f"SELECT {K3}, {_blend_sql()} FROM z GROUP BY 1, 2, 3")
def blend_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m, h = cubes(spark, sf_dir)
    return rounded(similarity.blends(c, m, h))


def _across_sql(keys: str, a: str, g: str) -> str:
    on = ", ".join(f"{k.strip()}" for k in keys.split(","))
    first = ", ".join(f"x.{k.strip()}" for k in keys.split(","))
    n = len(keys.split(",")) + 1
    groups = ", ".join(str(k + 1) for k in range(n))
    norm = lambda t: f"(SELECT {on}, time, sqrt(sum(CAST(count AS DOUBLE) * count)) AS n, CAST(sum(count) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS k FROM {t} GROUP BY {groups})"
    return f"(SELECT d.*, d.dot / (p.n * q.n) AS cos, p.s / q.s AS tok, p.k / q.k AS typ FROM (SELECT {first}, x.time, sum(CAST(x.count AS DOUBLE) * y.count) AS dot FROM {a} x JOIN {g} y USING ({on}, context, time) GROUP BY {groups}) d JOIN {norm(a)} p USING ({on}, time) JOIN {norm(g)} q USING ({on}, time))"


@query(with_sql(*all_cubes_sql(AWARE, "_a"), *all_cubes_sql(None, "_g")) + f"""SELECT c.modifier, c.head, c.time, {r('c.cos')} AS sim_comp_settings, {r('c.tok')} AS perc_token_comp, {r('c.typ')} AS perc_type_comp, {r('m.cos')} AS sim_modifier_settings, {r('m.tok')} AS perc_token_modifier, {r('m.typ')} AS perc_type_modifier, {r('h.cos')} AS sim_head_settings, {r('h.tok')} AS perc_token_head, {r('h.typ')} AS perc_type_head
FROM {_across_sql('modifier, head', 'cooc_a', 'cooc_g')} c JOIN {_across_sql('modifier', 'mods_a', 'mods_g')} m USING (modifier, time) JOIN {_across_sql('head', 'heads_a', 'heads_g')} h USING (head, time)""")
def setting_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.settings(cubes(spark, sf_dir, AWARE), cubes(spark, sf_dir)))


@query(with_sql(cooc_sql(AWARE, "ca"), cooc_sql(None, "cg")) + f"""SELECT coalesce(p.modifier, q.modifier) AS modifier, coalesce(p.head, q.head) AS head, coalesce(p.time, q.time) AS time, {r('p.s / q.s')} AS perc_token_comp, {r('p.k / q.k')} AS perc_type_comp
FROM (SELECT modifier, head, time, CAST(sum(count) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS k FROM ca GROUP BY 1, 2, 3) p FULL JOIN (SELECT modifier, head, time, CAST(sum(count) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS k FROM cg GROUP BY 1, 2, 3) q ON p.modifier = q.modifier AND p.head = q.head AND p.time = q.time""")
def setting_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.shares(compounds(spark, sf_dir, AWARE), compounds(spark, sf_dir), "comp"))


def _drift_sql(keys: str, cube: str, name: str, suffix: str) -> str:
    on, n = keys, len(keys.split(",")) + 1
    groups = ", ".join(str(k + 1) for k in range(n))
    x = ", ".join(f"x.{k.strip()}" for k in keys.split(","))
    return f"""n{suffix} AS (SELECT {on}, time, sqrt(sum(CAST(count AS DOUBLE) * count)) AS n FROM {cube} GROUP BY {groups}),
s{suffix} AS (SELECT *, lag(time) OVER (PARTITION BY {on} ORDER BY time) AS before, lag(n) OVER (PARTITION BY {on} ORDER BY time) AS nb FROM n{suffix}),
d{suffix} AS (SELECT {x}, x.time, sum(CAST(x.count AS DOUBLE) * y.count) AS dot FROM {cube} x JOIN s{suffix} s USING ({on}, time) JOIN {cube} y ON {' AND '.join(f'x.{k.strip()} = y.{k.strip()}' for k in keys.split(','))} AND x.context = y.context AND y.time = s.before GROUP BY {groups}),
c{suffix} AS (SELECT {', '.join('s.' + k.strip() for k in keys.split(','))}, s.time, CASE WHEN before IS NOT NULL THEN coalesce(dot, 0) / (n * nb) END AS {name} FROM s{suffix} s LEFT JOIN d{suffix} d USING ({on}, time))"""


@query(with_sql(cooc_sql(), _drift_sql("modifier, head", "cooc", "change_comp", "1")) + f"SELECT {K3}, {r('change_comp')} AS change_comp FROM c1")
def drift_compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.change(cubes(spark, sf_dir)[0], "change_comp"))


@query(with_sql(*all_cubes_sql(), _drift_sql("modifier, head", "cooc", "change_comp", "1"), _drift_sql("modifier", "mods", "change_mod", "2"), _drift_sql("head", "heads", "change_head", "3")) + f"SELECT c1.modifier, c1.head, c1.time, {r('change_comp')} AS change_comp, {r('change_mod')} AS change_mod, {r('change_head')} AS change_head FROM c1 JOIN c2 ON c1.modifier = c2.modifier AND c1.time = c2.time JOIN c3 ON c1.head = c3.head AND c1.time = c3.time WHERE change_mod IS NOT NULL AND change_head IS NOT NULL")
def drift_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.features(*cubes(spark, sf_dir)))


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand in for rated pairs: every name of every brand, rated by size; several sources rate one pair."""
    w = F.split("p_name", " ")
    return table(spark, sf_dir, "part").groupBy(w.getItem(0).alias("modifier"), F.col("p_brand").alias("head")).agg(F.round(F.avg("p_size"), 6).alias("rating"), F.count(F.lit(1)).alias("n_ratings"))


RATINGS = "ratings AS (SELECT split_part(p_name, ' ', 1) AS modifier, p_brand AS head, round(avg(p_size), 6) AS rating, count(*) AS n_ratings FROM part GROUP BY 1, 2)"
NAME_PAIRS = "SELECT DISTINCT split_part(p_name, ' ', 1) AS modifier, split_part(p_name, ' ', 2) AS head FROM part"
RARE = "cooc_r AS (SELECT p_brand AS modifier, p_type || '/' || p_size AS head, 's' || l_suppkey AS context, CAST(year(l_shipdate) AS INTEGER) AS time, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4)"


def _rare(spark: SparkSession, sf_dir: str) -> Cube:
    """A sparse cube: brands and sizes of types, of which many pairs are unseen in a year."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("p_brand").alias("modifier"), F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("head"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("context"), F.year("l_shipdate").alias("time"), F.col("l_quantity").cast("long").alias("count"))
    return Cube(rows, ("modifier", "head")).regrouped()


@query(with_sql(RARE) + "SELECT p.modifier, p.head, t.time FROM (SELECT DISTINCT modifier, head FROM cooc_r) p CROSS JOIN (SELECT DISTINCT time FROM cooc_r) t WHERE NOT EXISTS (SELECT 1 FROM cooc_r c WHERE c.modifier = p.modifier AND c.head = p.head AND c.time = t.time)")
def unseen_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by bins that have no rows; bins are years, so few."""
    c = _rare(spark, sf_dir)
    df = c.df.persist()
    return assemble.unseen(df, df.select("time").distinct(), df)


@query(with_sql(RARE, role_sql("modifier", "mr", "cooc_r"), role_sql("head", "hr", "cooc_r"), "u AS (SELECT p.modifier, p.head, t.time FROM (SELECT DISTINCT modifier, head FROM cooc_r) p CROSS JOIN (SELECT DISTINCT time FROM cooc_r) t WHERE NOT EXISTS (SELECT 1 FROM cooc_r c WHERE c.modifier = p.modifier AND c.head = p.head AND c.time = t.time))", "d AS (SELECT c.modifier, c.head, c.time, sum(CAST(m.count AS DOUBLE) * h.count) AS dot FROM cooc_r c JOIN mr m USING (modifier, context, time) JOIN hr h USING (head, context, time) GROUP BY 1, 2, 3 UNION ALL SELECT u.modifier, u.head, u.time, sum(CAST(m.count AS DOUBLE) * h.count) FROM u JOIN hr h USING (head, time) JOIN mr m USING (modifier, context, time) GROUP BY 1, 2, 3)", "nm AS (SELECT modifier, time, sqrt(sum(CAST(count AS DOUBLE) * count)) AS nm FROM mr GROUP BY 1, 2)", "nh AS (SELECT head, time, sqrt(sum(CAST(count AS DOUBLE) * count)) AS nh FROM hr GROUP BY 1, 2)") + f"SELECT modifier, head, time, {r('dot / (nh * nm)')} AS sim_bw_constituents FROM d JOIN nm USING (modifier, time) JOIN nh USING (head, time)")
def unseen_constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _rare(spark, sf_dir)
    c = Cube(c.df.persist(), c.keys)
    missing = assemble.unseen(c.df, c.df.select("time").distinct(), c.df)
    return rounded(similarity.between_constituents(c, c.projected("modifier"), c.projected("head"), missing))


def _wide_sql(features: tuple[str, ...]) -> str:
    return ", ".join(f"""avg(CASE WHEN time = {y} THEN {f} END) AS "{f}:{y}" """ for f in features for y in YEARS)


WIDE = f"""wide AS (SELECT modifier, head, {_wide_sql(('ppmi', 'comp_tf'))} FROM (SELECT modifier, head, time, round(greatest({PMI}, 0), 6) AS ppmi, round(log2(1 + fa), 6) AS comp_tf FROM t) GROUP BY 1, 2)"""
WIDE_NAMES = [f"{f}:{y}" for f in ("ppmi", "comp_tf") for y in YEARS]


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _rare(spark, sf_dir)
    t = assoc.contingency(c)
    long = rounded(t.join(assoc.association(t), KEYS).select(*KEYS, "ppmi", F.log2(1 + F.col("a").cast("double")).alias("comp_tf")))
    return assemble.widen(long, ["modifier", "head"], ["ppmi", "comp_tf"], values(t, "time"))


RARE_TABLE = TABLE.replace("FROM cooc ", "FROM cooc_r ")


@query(with_sql(RARE, RARE_TABLE, WIDE) + "SELECT modifier, head, " + ", ".join(f'{r(chr(34) + c + chr(34))} AS "{c}"' for c in WIDE_NAMES) + " FROM wide")
def wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_wide(spark, sf_dir))


@query(with_sql(RARE, RARE_TABLE, WIDE) + "SELECT modifier, head, " + ", ".join(f'{r(f"coalesce({chr(34)}{c}{chr(34)}, (SELECT median({chr(34)}{c}{chr(34)}) FROM wide))")} AS "{c}"' for c in WIDE_NAMES) + " FROM wide")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _wide(spark, sf_dir).persist()
    return rounded(assemble.medians(wide, [c for c in wide.columns if c not in ("modifier", "head")]))


@query(with_sql(RARE, RARE_TABLE, WIDE) + " UNION ALL ".join(f"""SELECT modifier, head, '{c.split(':')[0]}' AS feature, CAST({c.split(':')[1]} AS INTEGER) AS time, {r(chr(34) + c + chr(34))} AS value FROM wide""" for c in WIDE_NAMES))
def melted_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assemble.lengthen(_wide(spark, sf_dir), ["modifier", "head"]))


@query(with_sql(RARE, RARE_TABLE, WIDE, "melted AS (" + " UNION ALL ".join(f"""SELECT modifier, head, '{c.split(':')[0]}' AS feature, CAST({c.split(':')[1]} AS INTEGER) AS time, "{c}" AS value FROM wide""" for c in WIDE_NAMES) + ")", "full_k AS (SELECT modifier, head, feature FROM melted WHERE value IS NOT NULL AND time >= 1996 GROUP BY 1, 2, 3 HAVING count(DISTINCT time) = 6)") + f"SELECT feature, time, {r('avg(value)', 5)} AS mean_value, count(*) AS n FROM melted JOIN full_k USING (modifier, head, feature) WHERE value IS NOT NULL AND time >= 1996 GROUP BY 1, 2")
def plot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by bin of the pairs that are there in every year since 1996."""
    long = assemble.lengthen(_wide(spark, sf_dir), ["modifier", "head"]).filter("value is not null").persist()
    whole = assemble.gap_free(long, ["modifier", "head", "feature"], 1996, 6)
    return rounded(whole.groupBy("feature", "time").agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n")), 5)


@query(with_sql(cooc_sql(), TABLE, RATINGS, "lng AS (SELECT modifier, head, time, a FROM t)", f"w AS (SELECT modifier, head, {', '.join(f'avg(CASE WHEN time = {y} THEN a END) AS {chr(34)}a:{y}{chr(34)}' for y in YEARS)} FROM lng GROUP BY 1, 2)", f"pairs AS ({NAME_PAIRS})", "rated AS (SELECT modifier, head, 'names' AS source FROM pairs UNION ALL SELECT modifier, 'none' AS head, 'none' AS source FROM (SELECT DISTINCT modifier FROM pairs))") + "SELECT rated.*, " + ", ".join(f'"a:{y}"' for y in YEARS) + " FROM rated LEFT JOIN w USING (modifier, head)")
def rated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated pairs keep their row without features; a source's copies are one row."""
    t = assoc.contingency(compounds(spark, sf_dir))
    wide = assemble.widen(t, ["modifier", "head"], ["a"], values(t, "time"))
    w = F.split("p_name", " ")
    pairs = table(spark, sf_dir, "part").select(w.getItem(0).alias("modifier"), w.getItem(1).alias("head"))
    ratings = pairs.withColumn("source", F.lit("names")).unionByName(pairs.select("modifier", F.lit("none").alias("head"), F.lit("none").alias("source")))
    return assemble.rated(ratings.distinct(), wide)


def _tag_sql(eight: bool) -> str:
    nouns = [(m, h) for m in ("NOUN", "PROPN") for h in ("NOUN", "PROPN")]
    adj = [("ADJ", h) for h in ("NOUN", "PROPN")] + (nouns if eight else [])
    one = lambda tags, test: " UNION ALL ".join(f"SELECT modifier || '_{m}' AS modifier, head || '_{h}' AS head, rating, n_ratings FROM ratings WHERE {test}" for m, h in tags)
    return one(nouns, "modifier NOT IN ('small', 'red')") + " UNION ALL " + one(adj, "modifier IN ('small', 'red')")


@query(with_sql(RATINGS) + _tag_sql(False))
def tag_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.tagged(_ratings(spark, sf_dir), F.col("modifier").isin("small", "red"))


@query(with_sql(RATINGS) + _tag_sql(True))
def tag_expand_eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.tagged(_ratings(spark, sf_dir), F.col("modifier").isin("small", "red"), eight=True)


@query(with_sql(RATINGS) + "SELECT modifier, head, rating, CASE WHEN rating >= 26 THEN 'high' WHEN rating >= 20 THEN 'med' ELSE 'low' END AS level FROM ratings WHERE NOT (rating >= 20 AND rating < 26)")
def rating_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels without the middle one; ratings here are sizes, brought to the scale of the cut points."""
    scaled = F.when(F.col("rating") >= 26, 4.0).when(F.col("rating") >= 20, 2.0).otherwise(0.0)
    return _ratings(spark, sf_dir).select("modifier", "head", "rating", assemble.rating_level(scaled).alias("level")).filter("level <> 'med'")


@query(with_sql(cooc_sql(), TABLE) + f"SELECT modifier, {r('avg(a)')} AS a_mean, {r('coalesce(stddev_samp(a), (SELECT avg(s) FROM (SELECT stddev_samp(a) AS s FROM t GROUP BY modifier)))')} AS a_std FROM t GROUP BY modifier")
def unit_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assemble.by_unit(assoc.contingency(compounds(spark, sf_dir)), "modifier", ["a"]))


@query(with_sql(cooc_sql(), TABLE, "e AS (SELECT min(a) AS lo, max(a) AS hi, min(x_star) AS xlo, max(x_star) AS xhi FROM t)") + f"SELECT {K3}, {r('(a - lo) / CAST(hi - lo AS DOUBLE)')} AS a, {r('(x_star - xlo) / CAST(xhi - xlo AS DOUBLE)')} AS x_star FROM t, e")
def minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = assoc.contingency(compounds(spark, sf_dir)).select(*KEYS, "a", "x_star").persist()
    return rounded(assemble.min_max(t, ["a", "x_star"]))


@query(with_sql(cooc_sql(), TABLE) + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))')} AS r FROM t" for a in ("a", "x_star", "star_y") for b in ("a", "x_star", "star_y")))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.correlations(assoc.contingency(compounds(spark, sf_dir)), ["a", "x_star", "star_y"]))


@query(with_sql(cooc_sql(), TABLE, "g AS (SELECT time, count(*) AS n, sum(fa) AS s, sum(fa * fa) AS q FROM t GROUP BY 1)", "z AS (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b, count(*) AS k FROM g)") + f"SELECT {r('b - s * s / n', 3)} AS ss_between, {r('q - b', 3)} AS ss_within, CAST(k - 1 AS BIGINT) AS df_between, CAST(n - k AS BIGINT) AS df_within, {r('((b - s * s / n) / (k - 1)) / ((q - b) / (n - k))', 4)} AS f_value FROM z")
def anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.anova(assoc.contingency(compounds(spark, sf_dir)), "time", "a")
    return out.select(*(F.round(c, 3 if c.startswith("ss") else 4).alias(c) if c in ("ss_between", "ss_within", "f_value") else F.col(c) for c in out.columns))


@query(with_sql(cooc_sql(), TABLE) + f"SELECT {K3}, {r('CAST(a AS DOUBLE) / lag(a) OVER (PARTITION BY modifier, head ORDER BY time) - 1')} AS pct FROM t")
def pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = assoc.contingency(compounds(spark, sf_dir))
    return rounded(t.select(*KEYS, drift.percent_change(t, ["modifier", "head"], "a").alias("pct")))


@query(with_sql(RARE) + "SELECT modifier, head, " + " || ".join(f"max(CASE WHEN time = {y} THEN '1' ELSE '0' END)" for y in YEARS) + " AS pattern, CAST(count(DISTINCT time) AS INTEGER) AS present FROM cooc_r GROUP BY 1, 2")
def presence_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _rare(spark, sf_dir).df
    return vocab.presence(df, ["modifier", "head"], values(df, "time"))


@query(with_sql(cooc_sql(), TABLE, "e AS (SELECT quantile_cont(a, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM t)") + "SELECT modifier, head, time, a, CAST(len(list_filter(e, lambda x: a > x)) + 1 AS INTEGER) AS bin FROM t, e")
def decile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.edges_bin(assoc.contingency(compounds(spark, sf_dir)).select(*KEYS, "a").persist(), "a")


@query(with_sql(RARE, "c AS (SELECT modifier, head, CAST(sum(count) AS BIGINT) AS count FROM cooc_r GROUP BY 1, 2)", "k AS (SELECT *, row_number() OVER (ORDER BY count DESC, modifier, head) AS k FROM c)") + "SELECT modifier, head, count, CASE WHEN k <= 100 THEN 'top100' WHEN k <= 500 THEN 'top500' WHEN k <= 1000 THEN 'top1000' ELSE 'rest' END AS rank_bin FROM k")
def rank_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _rare(spark, sf_dir).df.groupBy("modifier", "head").agg(F.sum("count").alias("count")).persist()
    return vocab.rank_bins(c, "count", ["modifier", "head"], (100, 500, 1000))


@query(with_sql(cooc_sql()) + "SELECT context, CAST(sum(count) AS BIGINT) AS count FROM cooc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def context_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.top_k(compounds(spark, sf_dir).df, "context", "count", 50)


@query(with_sql(cooc_sql(), "s AS (SELECT time, context, CAST(sum(count) AS BIGINT) AS count FROM cooc GROUP BY 1, 2)") + "SELECT * FROM (SELECT time, context, count, CAST(row_number() OVER (PARTITION BY time ORDER BY count DESC, context) AS INTEGER) AS rank FROM s) WHERE rank <= 20")
def topk_per_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.top_k_per(compounds(spark, sf_dir).df, "time", "context", "count", 20)


@query(with_sql(RARE) + "SELECT head, CAST(sum(n) AS BIGINT) AS count FROM (SELECT head, time, sum(count) AS n FROM cooc_r GROUP BY 1, 2 HAVING sum(count) > 10) GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT time) FROM cooc_r)")
def always_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.always_present(_rare(spark, sf_dir).df.persist(), "head", "time", least=10)


@query(with_sql(cooc_sql(), "s AS (SELECT time, context, CAST(sum(count) AS BIGINT) AS count FROM cooc GROUP BY 1, 2)") + f"SELECT time, context, count, {r('CAST(count AS DOUBLE) / sum(count) OVER (PARTITION BY time)')} AS share FROM s")
def context_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vocab.share_per_bin(compounds(spark, sf_dir).df, "time", "context"))


@query(with_sql(BRAND) + f"""SELECT CAST(b.n AS BIGINT) AS types_before, CAST(b.s AS BIGINT) AS tokens_before, CAST(a.n AS BIGINT) AS types_after, CAST(a.s AS BIGINT) AS tokens_after, {r('a.n / CAST(b.n AS DOUBLE)')} AS types_left, {r('a.s / CAST(b.s AS DOUBLE)')} AS tokens_left
FROM (SELECT count(*) AS n, sum(count) AS s FROM brand) b, (SELECT count(*) AS n, sum(count) AS s FROM (SELECT *, sum(count) OVER (PARTITION BY modifier, head, time) AS mass FROM brand) WHERE mass > 500) a""")
def reduction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _brand(spark, sf_dir)
    base = Cube(base.df.persist(), base.keys)
    return rounded(vocab.reduced(base.df, base.above(500).df))


SPLIT = "k AS (SELECT modifier, head, count(DISTINCT time) AS n, max(CAST(time = 2001 AS INTEGER)) AS l, max(CAST(time = 2000 AS INTEGER)) AS b, max(CAST(time < 2000 AS INTEGER)) AS e FROM cooc_r GROUP BY 1, 2)"


@query(with_sql(RARE, SPLIT) + "SELECT * FROM (SELECT modifier, head, CASE WHEN n = 1 AND l = 1 THEN 'test' WHEN n = 2 AND l = 1 AND b = 1 THEN 'valid' WHEN e = 1 THEN 'train' END AS part FROM k) WHERE part IS NOT NULL")
def novelty_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.novelty_split(_rare(spark, sf_dir).df, ["modifier", "head"], 2000, 2001)


def _negative_sql(replace: str) -> str:
    keep = "modifier" if replace == "head" else "head"
    return with_sql(RARE, "pairs AS (SELECT DISTINCT modifier, head FROM cooc_r)", f"words AS (SELECT {replace} AS word, row_number() OVER (ORDER BY {replace}) - 1 AS slot FROM (SELECT DISTINCT {replace} FROM pairs))", f"kept AS (SELECT DISTINCT {keep} AS k FROM pairs)", f"free AS (SELECT k, word, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS nth, count(*) OVER (PARTITION BY k) AS n FROM kept, words WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.{keep} = k AND p.{replace} = word))", "sizes AS (SELECT DISTINCT k, n FROM free)", f"drawn AS (SELECT modifier, head, s.range AS seed, k, CAST('0x' || substr(md5(modifier || '|' || head || '|' || s.range), 1, 8) AS BIGINT) % n AS nth FROM pairs JOIN sizes ON {keep} = k, range(10) s)") + f"SELECT modifier, head, CAST(seed AS INTEGER) AS seed, word AS new_{replace} FROM drawn JOIN free USING (k, nth)"


def _negatives(spark: SparkSession, sf_dir: str, replace: str) -> DataFrame:
    pairs = _rare(spark, sf_dir).df.select("modifier", "head").distinct().persist()
    words = order.indexed(pairs, replace, "slot").select(F.col(replace).alias("word"), "slot")
    return sampling.negatives(pairs, words, pairs, replace)


@query(_negative_sql("head"))
def negative_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _negatives(spark, sf_dir, "head")


@query(_negative_sql("modifier"))
def negative_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _negatives(spark, sf_dir, "modifier")


@query(with_sql("o AS (SELECT DISTINCT o_orderpriority AS modifier, o_orderstatus AS head FROM orders UNION SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O'", "x AS (SELECT 1)").replace(",\nx AS (SELECT 1)", ")") + "SELECT modifier, head, 1 AS label FROM o UNION ALL SELECT head, modifier, 0 FROM o WHERE NOT EXISTS (SELECT 1 FROM o p WHERE p.modifier = o.head AND p.head = o.modifier)")
def reversed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    pairs = o.select(F.col("o_orderpriority").alias("modifier"), F.col("o_orderstatus").alias("head")).union(o.filter("o_orderstatus = 'O'").select("o_orderstatus", "o_orderpriority")).distinct()
    return sampling.reversed_pairs(pairs)


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5('1991|' || c_custkey) LIMIT 100")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("c_custkey").cast("string"), 100, 1991)


@query("SELECT part, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS s FROM (SELECT c_custkey, CASE WHEN CAST('0x' || substr(md5('1991|' || c_custkey), 1, 8) AS BIGINT) / 4294967296.0 < 0.8 THEN 'train' ELSE 'test' END AS part FROM customer) GROUP BY 1")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sampling.hash_split(table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string"), 0.8, 1991)
    return c.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("s"))


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 50), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 50)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS n_union, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS n_both, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS n_only_a""")
def set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select(F.col("l_suppkey").alias("k"), "l_returnflag")
    return sampling.set_sizes(rows.filter("l_returnflag = 'R'").select("k").distinct(), rows.filter("l_returnflag = 'A'").select("k").distinct(), "k")


@query(with_sql(RATINGS, "g AS (SELECT m.modifier, t.time FROM (SELECT DISTINCT modifier FROM ratings) m CROSS JOIN range(1994, 2003) t(time))", cooc_sql(), role_sql("modifier", "mods"), "k AS (SELECT modifier, time, CAST(sum(count) AS BIGINT) AS mass FROM mods GROUP BY 1, 2)") + "SELECT g.modifier, CAST(g.time AS BIGINT) AS time, k.mass FROM g LEFT JOIN k ON g.modifier = k.modifier AND g.time = k.time")
def grid_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = spark.range(1994, 2003).select(F.col("id").alias("time"))
    m = compounds(spark, sf_dir).projected("modifier")
    return assemble.complete(_ratings(spark, sf_dir).select("modifier").distinct(), times, m.mass(), ["modifier"])


@query(with_sql(RARE) + "SELECT modifier, head, context, time, count FROM (SELECT *, row_number() OVER (PARTITION BY modifier, head ORDER BY count DESC, time, context) AS k FROM cooc_r) WHERE k = 1")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.keep_first(_rare(spark, sf_dir).df, ["modifier", "head"], [F.desc("count"), F.col("time"), F.col("context")])


@query(with_sql(cooc_sql(), "a AS (SELECT context, CAST(sum(count) AS BIGINT) AS count FROM cooc GROUP BY 1)") + "SELECT CAST(sum(count) OVER (ORDER BY context) AS BIGINT) AS cumulative, context, count FROM a")
def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.running_share(compounds(spark, sf_dir).df.groupBy("context").agg(F.sum("count").alias("count")), "context", "count")


@query("""WITH RECURSIVE s AS (SELECT n_nationkey AS key, CAST(count(s_suppkey) + n_nationkey AS BIGINT) AS size, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1),
b AS (SELECT key, size, k, 0 AS bucket, size AS used FROM s WHERE k = 1 UNION ALL SELECT s.key, s.size, s.k, CASE WHEN b.used > 0 AND b.used + s.size > 60 THEN b.bucket + 1 ELSE b.bucket END, CASE WHEN b.used > 0 AND b.used + s.size > 60 THEN s.size ELSE b.used + s.size END FROM b JOIN s ON s.k = b.k + 1)
SELECT key AS n_nationkey, size, bucket FROM b""")
def greedy_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg((F.count("s_suppkey") + F.col("n_nationkey")).alias("size"))
    return vocab.greedy_buckets(n, "n_nationkey", "size", 60)


