"""Neighbourhood features, embeddings of cells and tiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from punctum.catalog.base import granules, readings, sql, tiles
from punctum.catalog.spatial import _SO, _C07, _D2, _INL, _soma, c07_half_open, subtype_of
from punctum.functions import columns as C
from punctum.operators import embedding as E
from punctum.operators.density import profile
from punctum.operators.spatial import first_box

KEY = ["sample_id"]
R = 10.0
r6 = lambda c: F.round(c, 6)
_AT = {"keys": KEY, "centre_xy": ("global_x", "global_y"), "point_xy": ("sphere_x", "sphere_y")}


def _kinds(spark, d):
    return granules(spark, d).withColumn("subtype", subtype_of())


def _one_place(spark, d):
    """Cells of the soma types that have one position."""
    c = _soma(spark, d)
    return c.join(c.groupBy("cell_id").count().where("count = 1").select("cell_id"), "cell_id", "left_semi")


def _near(spark, d):
    return E.neighbours(_one_place(spark, d), _kinds(spark, d), R, centre_id="cell_id", point_id="sphere_id", carry=["subtype"], **_AT)


def n09_features(spark, d):
    f = E.neighbourhood_features(_one_place(spark, d), _near(spark, d), R, "cell_id")
    return f.select("cell_id", "n", *(r6(c).alias(c) for c in ("mean_d", "std_d", "max_d", "min_d", "density", "offset")), F.round("anisotropy", 3).alias("anisotropy"))


def n09_expression(spark, d):
    w = E.KERNELS["gaussian"][0](F.col("d"), R / 2)
    e = E.weighted_expression(_near(spark, d), profile(readings(spark, d), granules(spark, d)), centre_id="cell_id", point_id="sphere_id", weight=w)
    return e.select("cell_id", "target", r6("value").alias("value"))


def n10_slots(spark, d):
    return E.nearest_slots(_one_place(spark, d), _kinds(spark, d), 5, R, centre_id="cell_id", point_id="sphere_id", label="subtype", **_AT)


def n11_shares(spark, d):
    s = E.label_shares(_one_place(spark, d), _near(spark, d), centre_id="cell_id", label="subtype", weight=F.exp(-F.col("d") / 10.0))
    return s.select("cell_id", "subtype", r6("share").alias("share"))


def _tile_counts(spark, d):
    first = first_box(c07_half_open(spark, d), point_id="sphere_id", box_id="spot_id")
    return first.join(_kinds(spark, d).select("sphere_id", "subtype"), "sphere_id").groupBy("spot_id", "subtype").agg(F.count(F.lit(1)).alias("n"))


def n12_tile_subtypes(spark, d):
    """Granules of each subtype and of all in every tile, each granule in one tile."""
    n = _tile_counts(spark, d).groupBy("spot_id").pivot("subtype", ["mixed", "pair", "single"]).sum("n")
    t = tiles(spark, d).select("spot_id").join(n, "spot_id", "left").fillna(0)
    return t.withColumn("n_granules", F.col("mixed") + F.col("pair") + F.col("single"))


def n13_smoothed(spark, d):
    t = tiles(spark, d)
    near = E.neighbours(t, t.withColumnRenamed("spot_id", "other_spot_id"), 75.0, centre_id="spot_id", point_id="other_spot_id", keys=KEY, centre_xy=("global_x", "global_y"), point_xy=("global_x", "global_y"))
    s = E.smoothed(_tile_counts(spark, d), near, tile_id="spot_id", other_id="other_spot_id", label="subtype", value="n", weight=E.KERNELS["gaussian"][0](F.col("d"), 37.5))
    return s.select("spot_id", "subtype", r6("n").alias("n"))


def _soft(spark, d, kernel, sigma=25.0):
    near = E.neighbours(tiles(spark, d), _kinds(spark, d), E.support(kernel, sigma, 50.0), centre_id="spot_id", point_id="sphere_id", carry=["subtype"], **_AT)
    return E.soft_counts(near, tile_id="spot_id", label="subtype", kernel=kernel, sigma=sigma)


def n14_soft_gaussian(spark, d):
    return _soft(spark, d, "gaussian").select("spot_id", "subtype", r6("value").alias("value"))


def n14_soft_exponential(spark, d):
    return _soft(spark, d, "exponential").select("spot_id", "subtype", r6("value").alias("value"))


def n14_soft_shares(spark, d):
    """Uniform kernel, as shares of each tile."""
    s = _soft(spark, d, "uniform")
    return s.select("spot_id", "subtype", r6(C.proportion(F.col("value"), ["spot_id"])).alias("share"))


def f09_log_normalised(spark, d):
    p = profile(readings(spark, d), granules(spark, d))
    return p.select("sphere_id", "target", r6(C.log_normalised(F.col("n"), ["sphere_id"])).alias("value"))


def f11_proportions(spark, d):
    return _tile_counts(spark, d).select("spot_id", "subtype", r6(C.proportion(F.col("n"), ["spot_id"])).alias("share"))


def f12_ambient(spark, d):
    """Readings outside nuclei that no granule holds, by sample and gene, never below 0."""
    out = readings(spark, d).where("overlaps_nucleus = 0").groupBy("sample_id", "target").agg(F.count(F.lit(1)).alias("outside"))
    g = profile(readings(spark, d), granules(spark, d)).join(granules(spark, d).select("sphere_id", "sample_id"), "sphere_id").groupBy("sample_id", "target").agg(F.sum("n").alias("inside"))
    return out.join(g, ["sample_id", "target"], "left").select("sample_id", "target", F.greatest(F.col("outside") - F.coalesce("inside", F.lit(0)), F.lit(0)).alias("ambient"))


def f13_efficiency(spark, d):
    scaled = F.when(F.col("sample_id") == "S0002", F.col("n") / 0.818691).otherwise(F.col("n"))
    n = granules(spark, d).groupBy("sample_id", "gene").agg(F.count(F.lit(1)).alias("n"))
    return n.select("sample_id", "gene", r6(scaled).alias("n"))


def g08_reads(spark, d):
    p = profile(readings(spark, d), granules(spark, d))
    return p.groupBy("sphere_id").agg(F.sum("n").alias("n_reads"), F.count(F.lit(1)).alias("n_genes"))


def g09_detected_genes(spark, d):
    """Genes found in over 5% of the granules."""
    p = profile(readings(spark, d), granules(spark, d)).groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    total = granules(spark, d).agg(F.count(F.lit(1)).alias("total"))
    return p.crossJoin(total).where("n > 0.05 * total").select("target", "n")


def g20_expression(spark, d):
    return profile(readings(spark, d), granules(spark, d).withColumn("sphere_r", F.lit(1.5)))


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "ngf" and k[1:3].isdigit()}

_PL = "so1 AS (SELECT * FROM so WHERE cell_id IN (SELECT cell_id FROM so GROUP BY cell_id HAVING count(*) = 1))"
_NEAR = f"""{_SO}, {_PL}, kd AS (SELECT *, CASE WHEN comp >= 3 THEN 'mixed' WHEN comp = 2 THEN 'pair' ELSE 'single' END AS subtype FROM gr),
ne AS MATERIALIZED (SELECT so1.cell_id, g.sphere_id, g.subtype, {_D2.format(a="so1")} AS d, g.sphere_x - so1.global_x AS dx, g.sphere_y - so1.global_y AS dy FROM so1 JOIN kd g ON so1.sample_id = g.sample_id AND {_D2.format(a="so1")} <= 10)"""
_PROFILE = f"pf AS MATERIALIZED (SELECT g.sphere_id, t.target, count(*) AS n FROM gr g JOIN tx t ON {_INL} GROUP BY ALL)"
_TC = f"""tc AS MATERIALIZED (SELECT f.spot_id, CASE WHEN g.comp >= 3 THEN 'mixed' WHEN g.comp = 2 THEN 'pair' ELSE 'single' END AS subtype, count(*) AS n
 FROM (SELECT sphere_id, min(spot_id) AS spot_id FROM ({_C07}) GROUP BY sphere_id) f JOIN gr g ON f.sphere_id = g.sphere_id GROUP BY ALL)"""
_SOFT = "ne AS (SELECT s.spot_id, CASE WHEN g.comp >= 3 THEN 'mixed' WHEN g.comp = 2 THEN 'pair' ELSE 'single' END AS subtype, {d} AS d FROM sp s JOIN gr g ON s.sample_id = g.sample_id AND {d} <= {r})"
_soft_sql = lambda r: _SOFT.format(d=_D2.format(a="s"), r=r)

SQL = {
    "n09_features": sql(f"""{_NEAR}, a AS (SELECT cell_id, count(*) AS n, avg(d) AS mean_d, stddev_pop(d) AS std_d, max(d) AS max_d, min(d) AS min_d, sqrt(avg(dx) ** 2 + avg(dy) ** 2) AS offs,
 (var_samp(dx) + var_samp(dy)) / 2 AS mid, sqrt(((var_samp(dx) - var_samp(dy)) / 2) ** 2 + covar_samp(dx, dy) ** 2) AS half FROM ne GROUP BY cell_id)
SELECT so1.cell_id, coalesce(n, 0) AS n, round(mean_d, 6) AS mean_d, round(std_d, 6) AS std_d, round(max_d, 6) AS max_d, round(min_d, 6) AS min_d, round(coalesce(n, 0) / (pi() * 100), 6) AS density, round(offs, 6) AS "offset",
 round(CASE WHEN n > 1 AND mid - half > 1e-9 * (mid + half) THEN (mid + half) / (mid - half) END, 3) AS anisotropy FROM so1 LEFT JOIN a ON so1.cell_id = a.cell_id"""),
    "n09_expression": sql(f"""{_NEAR}, {_PROFILE}, w AS (SELECT *, exp(-d * d / 50.0) AS w FROM ne), tt AS (SELECT cell_id, sum(w) AS total FROM w GROUP BY cell_id)
SELECT w.cell_id, pf.target, round(sum(w.w * pf.n) / any_value(total), 6) AS value FROM w JOIN pf ON w.sphere_id = pf.sphere_id JOIN tt ON w.cell_id = tt.cell_id GROUP BY ALL"""),
    "n10_slots": sql(f"""{_NEAR}, rk AS (SELECT cell_id, subtype, row_number() OVER (PARTITION BY cell_id ORDER BY d, sphere_id) - 1 AS slot FROM ne WHERE d < 10)
SELECT s.cell_id, CAST(s.slot AS INT) AS slot, coalesce(rk.subtype, 'Others') AS subtype FROM (SELECT cell_id, unnest(range(0, 5)) AS slot FROM so1) s LEFT JOIN rk ON s.cell_id = rk.cell_id AND s.slot = rk.slot"""),
    "n11_shares": sql(f"""{_NEAR}, w AS (SELECT cell_id, subtype, sum(exp(-d / 10.0)) AS w FROM ne GROUP BY ALL), q AS (SELECT cell_id, subtype, w / sum(w) OVER (PARTITION BY cell_id) AS share FROM w)
SELECT so1.cell_id, coalesce(subtype, 'Others') AS subtype, round(coalesce(share, 1.0), 6) AS share FROM so1 LEFT JOIN q ON so1.cell_id = q.cell_id"""),
    "n12_tile_subtypes": sql(f"""{_TC} SELECT sp.spot_id, CAST(coalesce(sum(n) FILTER (subtype = 'mixed'), 0) AS BIGINT) AS mixed, CAST(coalesce(sum(n) FILTER (subtype = 'pair'), 0) AS BIGINT) AS pair, CAST(coalesce(sum(n) FILTER (subtype = 'single'), 0) AS BIGINT) AS single, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_granules
FROM sp LEFT JOIN tc ON sp.spot_id = tc.spot_id GROUP BY sp.spot_id"""),
    "n13_smoothed": sql(f"""{_TC}, nb AS (SELECT a.spot_id, b.spot_id AS o, exp(-((a.global_x - b.global_x) ** 2 + (a.global_y - b.global_y) ** 2) / (2 * 37.5 * 37.5)) AS w FROM sp a JOIN sp b ON a.sample_id = b.sample_id AND (a.global_x - b.global_x) ** 2 + (a.global_y - b.global_y) ** 2 <= 5625),
tt AS (SELECT spot_id, sum(w) AS total FROM nb GROUP BY spot_id)
SELECT nb.spot_id, tc.subtype, round(sum(w * tc.n) / any_value(total), 6) AS n FROM nb JOIN tc ON nb.o = tc.spot_id JOIN tt ON nb.spot_id = tt.spot_id GROUP BY ALL"""),
    "n14_soft_gaussian": sql(f"{_soft_sql(75)} SELECT spot_id, subtype, round(sum(exp(-d * d / 1250.0)), 6) AS value FROM ne GROUP BY ALL"),
    "n14_soft_exponential": sql(f"{_soft_sql(100)} SELECT spot_id, subtype, round(sum(exp(-d / 25.0)), 6) AS value FROM ne GROUP BY ALL"),
    "n14_soft_shares": sql(f"{_soft_sql(25)} SELECT spot_id, subtype, round(count(*) / sum(count(*)) OVER (PARTITION BY spot_id), 6) AS share FROM ne GROUP BY spot_id, subtype"),
    "f09_log_normalised": sql(f"{_PROFILE} SELECT sphere_id, target, round(ln(1 + n * 10000.0 / sum(n) OVER (PARTITION BY sphere_id)), 6) AS value FROM pf"),
    "f11_proportions": sql(f"{_TC} SELECT spot_id, subtype, round(n / sum(n) OVER (PARTITION BY spot_id), 6) AS share FROM tc"),
    "f12_ambient": sql(f"""{_PROFILE}, o AS (SELECT sample_id, target, count(*) AS outside FROM tx WHERE overlaps_nucleus = 0 GROUP BY ALL), i AS (SELECT gr.sample_id, pf.target, sum(pf.n) AS inside FROM pf JOIN gr ON pf.sphere_id = gr.sphere_id GROUP BY ALL)
SELECT o.sample_id, o.target, CAST(greatest(outside - coalesce(inside, 0), 0) AS BIGINT) AS ambient FROM o LEFT JOIN i ON o.sample_id = i.sample_id AND o.target = i.target"""),
    "f13_efficiency": sql("SELECT sample_id, gene, round(CASE WHEN sample_id = 'S0002' THEN count(*) / 0.818691 ELSE count(*) END, 6) AS n FROM gr GROUP BY sample_id, gene"),
    "g08_reads": sql(f"{_PROFILE} SELECT sphere_id, CAST(sum(n) AS BIGINT) AS n_reads, count(*) AS n_genes FROM pf GROUP BY sphere_id"),
    "g09_detected_genes": sql(f"{_PROFILE} SELECT target, count(*) AS n FROM pf GROUP BY target HAVING count(*) > 0.05 * (SELECT count(*) FROM gr)"),
    "g20_expression": sql("SELECT g.sphere_id, t.target, count(*) AS n FROM gr g JOIN tx t ON g.sample_id = t.sample_id AND (g.sphere_x - t.global_x) ** 2 + (g.sphere_y - t.global_y) ** 2 + (g.layer_z - t.global_z) ** 2 <= 2.25 GROUP BY ALL"),
}
