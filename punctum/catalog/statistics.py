"""Correlations, ranks, corrections, tests and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctum.catalog.base import granules, readings, sql
from punctum.functions import columns as C
from punctum.operators import stats as S

r6 = lambda c: F.round(c, 6)


def f03_scaled(spark, d):
    return S.scaled(granules(spark, d), "sphere_r", ["gene"], "scaled").select("sphere_id", r6("scaled").alias("scaled"))


def _usable(spark, d):
    return granules(spark, d).where("size IS NOT NULL AND comp IS NOT NULL AND NOT isnan(size) AND NOT isnan(comp) AND size > 0")


def f04_weighted_corr(spark, d):
    return S.weighted_corr(_usable(spark, d), "sphere_r", "size", "comp", ["gene"]).select("gene", r6("corr").alias("corr"))


def f05_weighted_spearman(spark, d):
    return S.weighted_spearman(_usable(spark, d), "sphere_r", "size", "comp", ["gene"]).select("gene", r6("corr").alias("corr"))


def w06_ranks(spark, d):
    return S.average_rank(_usable(spark, d), "size", ["gene"], "rank").select("sphere_id", "rank")


def _p_values(spark, d):
    return _usable(spark, d).where("in_soma_ratio IS NOT NULL AND NOT isnan(in_soma_ratio)").groupBy("sample_id", "gene").agg(F.avg("in_soma_ratio").alias("p"))


def w10_adjusted(spark, d):
    a = S.adjusted(_p_values(spark, d), "p", ["sample_id"])
    return a.select("sample_id", "gene", r6("bh").alias("bh"), r6("bonferroni").alias("bonferroni"))


def f06_stars(spark, d):
    return _p_values(spark, d).select("sample_id", "gene", C.stars(F.col("p")).alias("stars"))


def f08_distances(spark, d):
    return granules(spark, d).select("sphere_id", r6(F.sqrt(F.pow("sphere_x", F.lit(2)) + F.pow("sphere_y", F.lit(2)) + F.pow("sphere_z", F.lit(2)))).alias("norm"))


def f10_log_fold(spark, d):
    """log2 fold change of gene shares between two samples."""
    n = readings(spark, d).groupBy("target").agg(*(F.count_if(F.col("sample_id") == s).alias(s) for s in ("S0001", "S0002")))
    from pyspark.sql import Window

    share = lambda c: F.col(c) / F.sum(c).over(Window.partitionBy())
    return n.select("target", r6(F.log2((share("S0001") + 1e-8) / (share("S0002") + 1e-8))).alias("log2fc"))


def f14_pearson(spark, d):
    """Correlation of x and y of each gene's readings; 1 where it isn't defined."""
    c = readings(spark, d).groupBy("sample_id", "target").agg(F.corr("global_x", "global_y").alias("c"))
    return c.select("sample_id", "target", r6(F.coalesce(F.nanvl("c", F.lit(None)), F.lit(1.0))).alias("corr"))


def f15_t_test(spark, d):
    t = S.t_test(_usable(spark, d), F.log1p("size"), "sample_id", "S0001", "S0002", ["gene"])
    return t.select("gene", r6("t").alias("t"), "df")


def f15_t_test_p(spark, d):
    t = S.t_test(_usable(spark, d), F.log1p("size"), "sample_id", "S0001", "S0002", ["gene"])
    return t.select("gene", r6("p").alias("p"))


def f16_bootstrap(spark, d):
    return S.bootstrap_mean(_usable(spark, d), "size", "sphere_id", ["sample_id"])


def f17_linear_model(spark, d):
    u = _usable(spark, d).where("sample_id IN ('S0001', 'S0002')")
    m = S.linear_model(u, F.log1p("size"), {"radius": F.col("sphere_r")}, ["sample_id"])
    return m.select("sample_id", "term", r6("beta").alias("beta"))


def f17_two_terms(spark, d):
    """Sample and radius as terms, with standard errors and p-values, for genes that determine them."""
    u = _usable(spark, d).where("sample_id IN ('S0001', 'S0002')")
    m = S.linear_model(u, F.log1p("size"), {"second": (F.col("sample_id") == "S0002").cast("int"), "radius": F.col("sphere_r")}, ["gene"])
    return m.where("beta IS NOT NULL").select("gene", "term", *(F.round(c, 5).alias(c) for c in ("beta", "se", "p")))


def f18_rank_sum(spark, d):
    t = S.rank_sum(_usable(spark, d), "size", "sample_id", "S0001", "S0002", ["gene"])
    return t.select("gene", r6("z").alias("z"))


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "fw" and k[1:3].isdigit()}

_U = "us AS MATERIALIZED (SELECT * FROM gr WHERE size IS NOT NULL AND comp IS NOT NULL AND NOT isnan(size) AND NOT isnan(comp) AND size > 0)"
_RK = "rk AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY {0}) + (count(*) OVER (PARTITION BY gene, {0}) - 1) / 2 AS r{1} FROM {2})"
_CORR = "(sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w)) / nullif(sqrt((sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2) * (sum(w * y * y) / sum(w) - (sum(w * y) / sum(w)) ** 2)), 0)"
_P = f"{_U}, pv AS (SELECT sample_id, gene, avg(in_soma_ratio) AS p FROM us WHERE in_soma_ratio IS NOT NULL AND NOT isnan(in_soma_ratio) GROUP BY ALL)"



def _two_sided(t: str, df: str) -> str:
    """Two-sided p-value of a t statistic with a whole number of degrees of freedom, by its finite series."""
    a, half = f"atan(abs({t}) / sqrt({df}))", "0.6931471805599453"
    odd = f"exp(2 * k * {half} + 2 * lgamma(k + 1) - lgamma(2 * k + 2) + (2 * k + 1) * ln(cos({a})))"
    even = f"exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - 2 * k * {half} + 2 * k * ln(cos({a})))"
    total = lambda term, n: f"coalesce(list_sum(list_transform(generate_series(0, CAST({n} AS BIGINT)), lambda k: {term})), 0)"
    return f"CASE WHEN {df} % 2 = 1 THEN 1 - 2 / pi() * ({a} + sin({a}) * {total(odd, f'({df} - 3) / 2')}) ELSE 1 - sin({a}) * {total(even, f'({df} - 2) / 2')} END"


SQL = {
    "f03_scaled": sql("SELECT sphere_id, round((sphere_r - min(sphere_r) OVER w) / nullif(max(sphere_r) OVER w - min(sphere_r) OVER w, 0), 6) AS scaled FROM gr WINDOW w AS (PARTITION BY gene)"),
    "f04_weighted_corr": sql(f"{_U} SELECT gene, round({_CORR}, 6) AS corr FROM (SELECT gene, sphere_r AS x, size AS y, comp AS w FROM us) GROUP BY gene"),
    "f05_weighted_spearman": sql(f"""{_U}, r AS (SELECT gene, comp AS w, rank() OVER (PARTITION BY gene ORDER BY sphere_r) + (count(*) OVER (PARTITION BY gene, sphere_r) - 1) / 2 AS x, rank() OVER (PARTITION BY gene ORDER BY size) + (count(*) OVER (PARTITION BY gene, size) - 1) / 2 AS y FROM us)
SELECT gene, round({_CORR}, 6) AS corr FROM r GROUP BY gene"""),
    "w06_ranks": sql(f"{_U} SELECT sphere_id, rank() OVER (PARTITION BY gene ORDER BY size) + (count(*) OVER (PARTITION BY gene, size) - 1) / 2 AS rank FROM us"),
    "w10_adjusted": sql(f"""{_P}, o AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS m, row_number() OVER (PARTITION BY sample_id ORDER BY p) AS k FROM pv)
SELECT sample_id, gene, round(least(min(p * m / k) OVER (PARTITION BY sample_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS bh, round(least(p * m, 1), 6) AS bonferroni FROM o"""),
    "f06_stars": sql(f"{_P} SELECT sample_id, gene, CASE WHEN p > 0.05 THEN 'ns' WHEN p > 0.01 THEN '*' WHEN p > 0.001 THEN '**' ELSE '***' END AS stars FROM pv"),
    "f08_distances": sql("SELECT sphere_id, round(sqrt(sphere_x ** 2 + sphere_y ** 2 + sphere_z ** 2), 6) AS norm FROM gr"),
    "f10_log_fold": sql("""n AS (SELECT target, count(*) FILTER (sample_id = 'S0001') AS a, count(*) FILTER (sample_id = 'S0002') AS b FROM tx GROUP BY target)
SELECT target, round(log2((a / sum(a) OVER () + 1e-8) / (b / sum(b) OVER () + 1e-8)), 6) AS log2fc FROM n"""),
    "f14_pearson": sql("SELECT sample_id, target, round(CASE WHEN corr(global_x, global_y) IS NULL OR isnan(corr(global_x, global_y)) THEN 1.0 ELSE corr(global_x, global_y) END, 6) AS corr FROM tx GROUP BY sample_id, target"),
    "f15_t_test": sql(f"""{_U}, a AS (SELECT gene, count(*) FILTER (sample_id = 'S0001') n1, count(*) FILTER (sample_id = 'S0002') n2, avg(ln(1 + size)) FILTER (sample_id = 'S0001') m1, avg(ln(1 + size)) FILTER (sample_id = 'S0002') m2,
 var_samp(ln(1 + size)) FILTER (sample_id = 'S0001') v1, var_samp(ln(1 + size)) FILTER (sample_id = 'S0002') v2 FROM us GROUP BY gene)
SELECT gene, CASE WHEN n1 > 1 AND n2 > 1 THEN round((m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 0), 6) END AS t, CAST(n1 + n2 - 2 AS DOUBLE) AS df FROM a"""),
    "f17_two_terms": sql(f"""{_U}, o AS (SELECT gene, ln(1 + size) AS y, CASE WHEN sample_id = 'S0002' THEN 1.0::DOUBLE ELSE 0 END AS s, sphere_r AS r FROM us WHERE sample_id IN ('S0001', 'S0002')),
m AS (SELECT gene, count(*)::DOUBLE AS n, avg(y) AS y, avg(s) AS s, avg(r) AS r FROM o GROUP BY gene),
c AS (SELECT m.gene, any_value(m.n) AS n, any_value(m.y) AS my, any_value(m.s) AS ms, any_value(m.r) AS mr, sum((o.s - m.s) ** 2) AS ss, sum((o.r - m.r) ** 2) AS rr, sum((o.s - m.s) * (o.r - m.r)) AS sr,
 sum((o.s - m.s) * (o.y - m.y)) AS sy, sum((o.r - m.r) * (o.y - m.y)) AS ry, sum((o.y - m.y) ** 2) AS yy FROM o JOIN m ON o.gene = m.gene GROUP BY m.gene),
e AS (SELECT *, ss * rr - sr * sr AS d FROM c WHERE n > 3 AND ss * rr - sr * sr > 1e-9 * ss * rr),
b AS (SELECT *, (sy * rr - ry * sr) / d AS bs, (ry * ss - sy * sr) / d AS br FROM e), v AS (SELECT *, greatest(yy - bs * sy - br * ry, 0) / (n - 3) AS v FROM b),
q AS (SELECT gene, n - 3 AS dof, unnest(['intercept', 'second', 'radius']) AS term, unnest([my - bs * ms - br * mr, bs, br]) AS beta, unnest([sqrt(v * (1 / n + (ms * ms * rr - 2 * ms * mr * sr + mr * mr * ss) / d)), sqrt(v * rr / d), sqrt(v * ss / d)]) AS se FROM v)
SELECT gene, term, round(beta, 5) AS beta, round(se, 5) AS se, round({_two_sided("(beta / se)", "dof")}, 5) AS p FROM q"""),
    "f17_linear_model": sql(f"""{_U}, a AS (SELECT sample_id, regr_slope(ln(1 + size), sphere_r) AS b, regr_intercept(ln(1 + size), sphere_r) AS i FROM us WHERE sample_id IN ('S0001', 'S0002') GROUP BY sample_id)
SELECT sample_id, 'intercept' AS term, round(i, 6) AS beta FROM a UNION ALL SELECT sample_id, 'radius', round(b, 6) FROM a"""),
    "f18_rank_sum": sql(f"""{_U}, r AS (SELECT gene, sample_id, rank() OVER (PARTITION BY gene ORDER BY size) + (count(*) OVER (PARTITION BY gene, size) - 1) / 2 AS k FROM us WHERE sample_id IN ('S0001', 'S0002')),
a AS (SELECT gene, sum(k) FILTER (sample_id = 'S0001') AS s, count(*) FILTER (sample_id = 'S0001') AS n1, count(*) FILTER (sample_id = 'S0002') AS n2 FROM r GROUP BY gene)
SELECT gene, round((s - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 6) AS z FROM a WHERE n1 > 0 AND n2 > 0"""),
}

_EXACT_T = SQL["f15_t_test"].replace("THEN round((m1", "THEN ((m1").replace(", 6) END AS t", ") END AS t")
SQL["f15_t_test_p"] = f"SELECT gene, round({_two_sided('t', 'df')}, 6) AS p FROM ({_EXACT_T})"
