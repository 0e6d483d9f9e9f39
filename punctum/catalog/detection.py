"""Density clusters, detected and merged spheres, and their metrics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from punctum.catalog.base import granules, readings, sql
from punctum.catalog.spatial import touching_pairs
from punctum.functions import geometry as G
from punctum.operators import density as D
from punctum.operators.merge import MergeRule, merged_spheres
from punctum.operators.proximity import points_in_spheres
from punctum.plans.shared import written_once
from punctum.sources import table

r6 = lambda c: F.round(c, 6)
PLANES = (0.0, 1.5, 3.0, 4.5, 6.0, 7.5, 9.0)
MARKERS = ["Flout12c", "Broupc", "Dround1", "Brost4", "Mack", "Skein", "Paerk5", "Churk8", "Mund", "Gros17"]
FINE = D.DetectorParams(minspl=3, in_soma_thr=0.5, planes=PLANES)


def e04_least_points(spark, d):
    """Near points that make one central, by the Poisson rule."""
    return D.least_points(readings(spark, d), D.DetectorParams(alpha=10.0), ["sample_id"])


def e05_clusters(spark, d):
    return D.density_clusters(readings(spark, d), eps=1.5, least=3).select("sample_id", "target", "cluster", "tx_id", "central")


def e06_cluster_places(spark, d):
    """Size, distinct positions and commonest cell of clusters with at least three positions."""
    found = D.density_clusters(readings(spark, d), eps=1.5, least=3)
    m = found.join(readings(spark, d).select("tx_id", "cell_id", "overlaps_nucleus", *D.XYZ), "tx_id")
    out = m.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.countDistinct(*D.XYZ).alias("places"), F.mode("cell_id", True).alias("cell_id"), r6(F.avg("overlaps_nucleus")).alias("in_soma"))
    return out.where("places >= 3")


def _spheres(spark, d, params=FINE, markers=None):
    return written_once(D.detected_spheres(readings(spark, d), params, markers=markers), "spheres")


def _rounded(s):
    return s.select(*(r6(c).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes))


def e08_planes(spark, d):
    return granules(spark, d).select("sphere_id", G.nearest_plane(F.col("sphere_z"), list(PLANES)).alias("layer_z"))


def e11_merged_marker(spark, d):
    """All markers clustered as one."""
    return _rounded(_spheres(spark, d, D.DetectorParams(minspl=3, in_soma_thr=0.5, merge_genes=True, planes=PLANES)))


def e12_spheres(spark, d):
    return _rounded(_spheres(spark, d))


def e12_marker_spheres(spark, d):
    """Detection within a list of markers only."""
    return _rounded(_spheres(spark, d, markers=MARKERS))


def e14_merged(spark, d):
    return _rounded(merged_spheres(_spheres(spark, d), readings(spark, d), MergeRule(threshold=0.2, planes=PLANES)))


def e15_control_filter(spark, d):
    g = granules(spark, d).where("size > 0").drop("nc_ratio")
    kept = D.control_filter(g, readings(spark, d), table(spark, d, "negative_controls"), D.DetectorParams(nc_top=5, nc_thr=0.1))
    return kept.select("sphere_id", r6("nc_ratio").alias("nc_ratio"))


def e16_detect(spark, d):
    """Detection, merge and control filter in a row."""
    r = readings(spark, d)
    merged = merged_spheres(_spheres(spark, d), r, MergeRule(threshold=0.2, planes=PLANES))
    return _rounded(D.control_filter(merged, r, table(spark, d, "negative_controls"), FINE))


def e17_profile(spark, d):
    return D.profile(readings(spark, d), granules(spark, d))


def e19_simulator_detector(spark, d):
    """Thresholds that include their values, in-soma from the sphere's points."""
    return _rounded(D.detected_spheres(readings(spark, d), D.DetectorParams(minspl=4, in_soma_thr=0.5, planes=PLANES), radius_first=True))


def e20_composition(spark, d):
    """Spheres with at least two markers."""
    return _rounded(D.detected_spheres(readings(spark, d), D.DetectorParams(minspl=3, in_soma_thr=0.5)).where("comp >= 2"))


def e22_ranking(spark, d):
    return D.gene_ranking(granules(spark, d))


def e23_rough(spark, d):
    """Detection without filters."""
    return _rounded(_spheres(spark, d, D.DetectorParams(minspl=3, size_thr=1e5, in_soma_thr=1.01, planes=PLANES)))


def _volumes(g, t):
    r = g.select(F.col("sphere_id"), F.col("sphere_r"))
    t = t.join(r.withColumnsRenamed({"sphere_id": "a_id", "sphere_r": "ra"}), "a_id").join(r.withColumnsRenamed({"sphere_id": "b_id", "sphere_r": "rb"}), "b_id")
    va, vb, both = G.volume(F.col("ra")), G.volume(F.col("rb")), G.shared_volume(F.col("distance"), F.col("ra"), F.col("rb"))
    return t.select("a_id", "b_id", r6(both).alias("shared"), r6(both / F.least(va, vb)).alias("volume"), r6(both / (va + vb - both)).alias("jaccard"), r6(2 * both / (va + vb)).alias("dice"))


def m02_volumes(spark, d):
    """Volumes and shared volumes of touching spheres of different genes, and their overlap measures."""
    g = granules(spark, d).where("sphere_r > 0")
    return _volumes(g, touching_pairs(g))


def _merged_by(by, threshold):
    def query(spark, d):
        rule = MergeRule(by=by, threshold=threshold, planes=PLANES, refresh_layer=False)
        return _rounded(merged_spheres(_spheres(spark, d), readings(spark, d), rule))

    query.__doc__ = f"Spheres merged by {by}."
    return query


m04_volume, m05_jaccard, m06_dice = _merged_by("volume", 0.5), _merged_by("jaccard", 0.3), _merged_by("dice", 0.4)


def m09_unmerged(spark, d):
    """Spheres of all markers put together without a merge."""
    g = granules(spark, d)
    return g.where("gene < 'H'").unionByName(g.where("gene >= 'H'")).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


def m10_membership(spark, d):
    """Spheres per reading, genes and readings per sphere, with the layer centre."""
    g = granules(spark, d)
    hit = points_in_spheres(readings(spark, d), g, sphere_xyz=("sphere_x", "sphere_y", "layer_z"), carry=["target"]).join(g.select("sphere_id", "gene"), "sphere_id")
    per_tx = hit.groupBy("tx_id").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("target") == F.col("gene")).cast("int")).alias("own"), F.max((F.col("target") != F.col("gene")).cast("int")).alias("cross"))
    a = per_tx.agg(r6(F.avg("n")).alias("mean_spheres"), *(r6(F.avg(c.cast("int"))).alias(n) for n, c in (("share_1", F.col("n") == 1), ("share_2", F.col("n") == 2), ("share_3", F.col("n") >= 3), ("own_and_cross", (F.col("own") == 1) & (F.col("cross") == 1)))))
    per_s = hit.groupBy("sphere_id").agg(F.countDistinct("target").alias("genes"), F.count(F.lit(1)).alias("n"))
    return a.crossJoin(per_s.agg(r6(F.avg("genes")).alias("mean_genes"), r6(F.avg("n")).alias("mean_readings")))


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "em" and k[1:3].isdigit()}

_D3 = "(g.sphere_x - t.global_x) * (g.sphere_x - t.global_x) + (g.sphere_y - t.global_y) * (g.sphere_y - t.global_y) + (g.layer_z - t.global_z) * (g.layer_z - t.global_z)"
_INL = f"g.sample_id = t.sample_id AND t.global_x BETWEEN g.sphere_x - g.sphere_r AND g.sphere_x + g.sphere_r AND {_D3} <= g.sphere_r * g.sphere_r"
_CLUSTERS = """kx AS (SELECT tx.*, floor(global_x / 1.5) AS ix, floor(global_y / 1.5) AS iy FROM tx), oo AS (SELECT a.i, b.i AS j FROM (SELECT unnest([-1, 0, 1]) AS i) a, (SELECT unnest([-1, 0, 1]) AS i) b),
nb AS MATERIALIZED (SELECT a.tx_id AS u, b.tx_id AS v FROM kx a, oo JOIN kx b ON a.sample_id = b.sample_id AND a.target = b.target AND a.ix + oo.i = b.ix AND a.iy + oo.j = b.iy
 WHERE (a.global_x - b.global_x) * (a.global_x - b.global_x) + (a.global_y - b.global_y) * (a.global_y - b.global_y) + (a.global_z - b.global_z) * (a.global_z - b.global_z) <= 2.25),
co AS MATERIALIZED (SELECT u FROM nb GROUP BY u HAVING count(*) >= 3), ed AS MATERIALIZED (SELECT u, v FROM nb WHERE u IN (SELECT u FROM co) AND v IN (SELECT u FROM co)),
wa AS (SELECT u AS root, u AS node FROM co UNION SELECT wa.root, ed.v FROM wa JOIN ed ON wa.node = ed.u), cg AS MATERIALIZED (SELECT min(root) AS cluster, node FROM wa GROUP BY node),
cm AS MATERIALIZED (SELECT cluster, node AS tx_id, TRUE AS central FROM cg UNION ALL SELECT min(cluster), nb.u, FALSE FROM nb JOIN cg ON nb.v = cg.node WHERE nb.u NOT IN (SELECT u FROM co) GROUP BY nb.u)"""
_GRID = "b AS (SELECT sample_id, floor(min(global_x)) AS x0, greatest(ceil(max(global_x)) - floor(min(global_x)), 1) AS nx, floor(min(global_y)) AS y0, greatest(ceil(max(global_y)) - floor(min(global_y)), 1) AS ny FROM tx GROUP BY sample_id), ar AS (SELECT sample_id, count(*) AS area FROM (SELECT DISTINCT tx.sample_id, least(floor(global_x - x0), nx - 1) AS ix, least(floor(global_y - y0), ny - 1) AS iy FROM tx JOIN b ON tx.sample_id = b.sample_id) GROUP BY sample_id)"
_PAIRS = """pr AS (SELECT a.sphere_id AS a_id, b.sphere_id AS b_id, a.sphere_r AS ra, b.sphere_r AS rb, sqrt((a.sphere_x - b.sphere_x) * (a.sphere_x - b.sphere_x) + (a.sphere_y - b.sphere_y) * (a.sphere_y - b.sphere_y) + (a.sphere_z - b.sphere_z) * (a.sphere_z - b.sphere_z)) AS d
 FROM gr a JOIN gr b ON a.sample_id = b.sample_id AND a.sphere_id < b.sphere_id AND a.gene <> b.gene AND a.sphere_r > 0 AND b.sphere_r > 0),
vo AS (SELECT *, 4.0 / 3.0 * pi() * ra ** 3 AS va, 4.0 / 3.0 * pi() * rb ** 3 AS vb, CASE WHEN d <= abs(ra - rb) THEN 4.0 / 3.0 * pi() * least(ra, rb) ** 3 ELSE pi() * (ra + rb - d) ** 2 * (d * d + 2 * d * (ra + rb) - 3 * (ra - rb) ** 2) / (12 * d) END AS sv FROM pr WHERE d < ra + rb)"""

SQL = {
    "e04_least_points": sql(f"""{_GRID}, mu AS (SELECT tx.sample_id, target, 10.0 * count(*) / any_value(area) * pi() * 2.25 AS mu FROM tx JOIN ar ON tx.sample_id = ar.sample_id GROUP BY ALL),
ks AS (SELECT sample_id, target, k, sum(exp(-mu + k * ln(mu) - lgamma(k + 1))) OVER (PARTITION BY sample_id, target ORDER BY k) AS cdf FROM mu, (SELECT unnest(range(0, 400)) AS k))
SELECT sample_id, target, greatest(min(k) FILTER (cdf >= 0.95), 3) AS least FROM ks GROUP BY ALL"""),
    "e05_clusters": sql(f"{_CLUSTERS} SELECT tx.sample_id, tx.target, cm.cluster, cm.tx_id, cm.central FROM cm JOIN tx ON cm.tx_id = tx.tx_id"),
    "e06_cluster_places": sql(f"""{_CLUSTERS}, j AS (SELECT cm.cluster, tx.* FROM cm JOIN tx ON cm.tx_id = tx.tx_id), md AS (SELECT cluster, cell_id, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, cell_id) AS k FROM j WHERE cell_id IS NOT NULL GROUP BY cluster, cell_id)
SELECT j.cluster, count(*) AS size, count(DISTINCT (global_x, global_y, global_z)) AS places, any_value(md.cell_id) AS cell_id, round(avg(overlaps_nucleus), 6) AS in_soma FROM j LEFT JOIN md ON j.cluster = md.cluster AND md.k = 1 GROUP BY j.cluster HAVING count(DISTINCT (global_x, global_y, global_z)) >= 3"""),
    "e08_planes": sql("""p AS (SELECT unnest([0.0, 1.5, 3.0, 4.5, 6.0, 7.5, 9.0]::DOUBLE[]) AS v), o AS (SELECT sphere_id, v, row_number() OVER (PARTITION BY sphere_id ORDER BY abs(v - sphere_z), v) AS k FROM gr, p)
SELECT sphere_id, v AS layer_z FROM o WHERE k = 1"""),
    "e15_control_filter": sql(f"""tp AS (SELECT target FROM tx WHERE target IN (SELECT gene FROM negative_controls) GROUP BY target ORDER BY count(*) DESC, target LIMIT 5), nt AS (SELECT * FROM tx WHERE target IN (SELECT target FROM tp)),
nn AS (SELECT g.sphere_id, count(*) AS n FROM gr g JOIN nt t ON {_INL} GROUP BY g.sphere_id), ra AS (SELECT gr.sphere_id, coalesce(n, 0) / size AS q FROM gr LEFT JOIN nn ON gr.sphere_id = nn.sphere_id WHERE size > 0)
SELECT sphere_id, round(q, 6) AS nc_ratio FROM ra WHERE q = 0 OR q < 0.1"""),
    "e17_profile": sql(f"SELECT g.sphere_id, t.target, count(*) AS n FROM gr g JOIN tx t ON {_INL} GROUP BY ALL"),
    "e22_ranking": sql("SELECT gene, n, CAST(cum AS BIGINT) AS cum, cum - n < 0.99 * total AS kept FROM (SELECT gene, n, sum(n) OVER (ORDER BY n DESC, gene) AS cum, sum(n) OVER () AS total FROM (SELECT gene, count(*) AS n FROM gr GROUP BY gene))"),
    "m02_volumes": sql(f"{_PAIRS} SELECT a_id, b_id, round(sv, 6) AS shared, round(sv / least(va, vb), 6) AS volume, round(sv / (va + vb - sv), 6) AS jaccard, round(2 * sv / (va + vb), 6) AS dice FROM vo"),
    "m09_unmerged": sql("SELECT gene, count(*) AS n FROM gr GROUP BY gene"),
    "m10_membership": sql(f"""h AS MATERIALIZED (SELECT g.sphere_id, t.tx_id, t.target, g.gene FROM gr g JOIN tx t ON {_INL}), pt AS (SELECT tx_id, count(*) AS n, max(CASE WHEN target = gene THEN 1 ELSE 0 END) AS own, max(CASE WHEN target <> gene THEN 1 ELSE 0 END) AS crs FROM h GROUP BY tx_id),
ps AS (SELECT count(DISTINCT target) AS genes, count(*) AS n FROM h GROUP BY sphere_id)
SELECT (SELECT round(avg(n), 6) FROM pt) AS mean_spheres, (SELECT round(avg(CASE WHEN n = 1 THEN 1 ELSE 0 END), 6) FROM pt) AS share_1, (SELECT round(avg(CASE WHEN n = 2 THEN 1 ELSE 0 END), 6) FROM pt) AS share_2, (SELECT round(avg(CASE WHEN n >= 3 THEN 1 ELSE 0 END), 6) FROM pt) AS share_3,
 (SELECT round(avg(CASE WHEN own = 1 AND crs = 1 THEN 1 ELSE 0 END), 6) FROM pt) AS own_and_cross, (SELECT round(avg(genes), 6) FROM ps) AS mean_genes, (SELECT round(avg(n), 6) FROM ps) AS mean_readings"""),
}
