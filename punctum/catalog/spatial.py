"""Spatial joins, grids, and aggregations over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctum.catalog.base import cells, granules, readings, sql, tiles
from punctum.operators import spatial as S
from punctum.operators.proximity import points_in_spheres, points_near_points
from punctum.sources import table

KEY = ["sample_id"]
r6 = lambda c: F.round(c, 6)
SOMA = ["projection", "interneuron", "star glia"]
_GRXY = ["sphere_x", "sphere_y"]


def controls(spark, d):
    return readings(spark, d).join(table(spark, d, "negative_controls").select(F.col("gene").alias("target")).distinct(), "target", "left_semi")


def c01_other_markers(spark, d):
    """Readings of other genes in each sphere."""
    g = granules(spark, d)
    inside = points_in_spheres(readings(spark, d), g, carry=["target"])
    return inside.join(g.select("sphere_id", "gene"), "sphere_id").where("target <> gene").groupBy("sphere_id").agg(F.count(F.lit(1)).alias("n_other"), F.countDistinct("target").alias("n_genes"))


def c02_control_counts(spark, d):
    """Negative-control readings around each layer centre, 0 where there are none."""
    g = granules(spark, d)
    n = points_in_spheres(controls(spark, d), g, sphere_xyz=("sphere_x", "sphere_y", "layer_z")).groupBy("sphere_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("sphere_id").join(n, "sphere_id", "left").select("sphere_id", F.coalesce("n", F.lit(0)).alias("n_controls"))


def c03_buffered_profile(spark, d):
    g = granules(spark, d).withColumn("reach", F.col("sphere_r") + 0.5)
    return points_in_spheres(readings(spark, d), g, sphere_xyz=("sphere_x", "sphere_y", "layer_z"), radius="reach", carry=["target"]).groupBy("sphere_id", "target").agg(F.count(F.lit(1)).alias("n"))


def touching_pairs(g):
    """(a_id, b_id, distance) of all touching spheres of different genes, the smaller id first."""
    gene = lambda s: g.select(F.col("sphere_id").alias(f"{s}_id"), F.col("gene").alias(f"{s}_gene")).distinct()
    pairs = S.touching_spheres(g, g).where("a_id < b_id").join(gene("a"), "a_id").join(gene("b"), "b_id")
    return pairs.where("a_gene <> b_gene").select("a_id", "b_id", "distance")


def c04_touching(spark, d):
    """Touching spheres of different genes, of any radius."""
    return touching_pairs(granules(spark, d)).select("a_id", "b_id", r6("distance").alias("distance"))


def _own_points(spark, d, g, pairs):
    own = points_in_spheres(readings(spark, d), g, carry=["target"]).join(g.select("sphere_id", "gene"), "sphere_id").where("gene = target").select("sphere_id", "tx_id")
    sides = [pairs.join(own, pairs[s] == own["sphere_id"]).select("a_id", "b_id", "tx_id") for s in ("a_id", "b_id")]
    return sides[0].unionByName(sides[1]).groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("n_points"))


def c05_own_points_of_pairs(spark, d):
    """For every touching pair of different genes, the readings of each sphere's own gene in either of them, repeated readings kept."""
    g = granules(spark, d)
    return _own_points(spark, d, g, touching_pairs(g))


def _soma(spark, d):
    return cells(spark, d).where(F.col("cell_type").isin(*SOMA)).select("cell_id", "sample_id", "global_x", "global_y").distinct()


def c06_strictly_inside(spark, d):
    return S.points_in_boxes(_soma(spark, d), tiles(spark, d), point_id="cell_id", box_id="spot_id", width=50.0, edges="open", keys=KEY)


def c07_half_open(spark, d):
    return S.points_in_boxes(granules(spark, d), tiles(spark, d), point_id="sphere_id", box_id="spot_id", width=50.0, edges="half", keys=KEY, point_xy=_GRXY)


def c08_first_tile(spark, d):
    return S.first_box(S.points_in_boxes(granules(spark, d), tiles(spark, d), point_id="sphere_id", box_id="spot_id", width=60.0, edges="half", keys=KEY, point_xy=_GRXY), point_id="sphere_id", box_id="spot_id")


def c09_multi_match(spark, d):
    hit = S.points_in_boxes(readings(spark, d), tiles(spark, d), point_id="tx_id", box_id="spot_id", width=60.0, edges="half", keys=KEY, carry=["target"])
    return hit.groupBy("spot_id", "target").agg(F.count(F.lit(1)).alias("n"))


def c10_distance_band(spark, d):
    near = points_near_points(_soma(spark, d), granules(spark, d), distance=10.0, left_id="cell_id", right_id="sphere_id", left_xyz=("global_x", "global_y"), right_xyz=_GRXY, keys=KEY)
    return near.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))


def c11_tile_band(spark, d):
    near = points_near_points(tiles(spark, d), granules(spark, d), distance=40.0, left_id="spot_id", right_id="sphere_id", left_xyz=("global_x", "global_y"), right_xyz=_GRXY, keys=KEY)
    return near.groupBy("spot_id").agg(F.count(F.lit(1)).alias("n"))


def c12_tile_neighbours(spark, d):
    t = tiles(spark, d)
    return points_near_points(t, t, distance=75.0, left_id="spot_id", right_id="spot_id", left_xyz=("global_x", "global_y"), right_xyz=("global_x", "global_y"), keys=KEY)


def c13_nearest_label(spark, d):
    known = tiles(spark, d).where("brain_area IS NOT NULL")
    near = S.nearest(granules(spark, d), known, 1, left_id="sphere_id", right_id="spot_id", keys=KEY, left_xyz=_GRXY, right_xyz=("global_x", "global_y"), cell=50.0)
    return near.join(known.select("spot_id", "brain_area"), "spot_id").select("sphere_id", "spot_id", "brain_area")


def c14_nearest_within(spark, d):
    near = S.nearest(_soma(spark, d), granules(spark, d), 5, left_id="cell_id", right_id="sphere_id", keys=KEY, left_xyz=("global_x", "global_y"), right_xyz=_GRXY, cell=10.0, within=10.0)
    return near.select("cell_id", "sphere_id", r6("distance").alias("distance"), "place")


def c15_nearest_others(spark, d):
    g = granules(spark, d)
    near = S.nearest(g, g, 2, left_id="sphere_id", right_id="sphere_id", keys=KEY, left_xyz=(*_GRXY, "sphere_z"), right_xyz=(*_GRXY, "sphere_z"), cell=16.0, not_self=True)
    return near.groupBy("sphere_id").agg(r6(F.avg("distance")).alias("mean_distance"))


def c16_nearest_tiles(spark, d):
    t = tiles(spark, d)
    near = S.nearest(t, t, 4, left_id="spot_id", right_id="spot_id", keys=KEY, left_xyz=("global_x", "global_y"), right_xyz=("global_x", "global_y"), cell=100.0)
    return near.select("spot_id", "other_spot_id", "place")


def _one_cell(spark, d):
    return cells(spark, d).groupBy("sample_id", "cell_id").agg(F.min("cell_type").alias("cell_type"), F.min("brain_area").alias("brain_area"))


def c17_labels(spark, d):
    g = granules(spark, d).where("cell_id IS NOT NULL").groupBy("sample_id", "cell_id").agg(F.count(F.lit(1)).alias("n"))
    return S.one_to_one(g, _one_cell(spark, d), ["sample_id", "cell_id"])


def c18_covariate(spark, d):
    per_area = _one_cell(spark, d).where("brain_area IS NOT NULL").groupBy("brain_area").agg(F.count(F.lit(1)).alias("n_cells"))
    return S.one_to_one(tiles(spark, d).select("spot_id", "brain_area"), per_area, ["brain_area"], many_left=True)


def c19_three_keys(spark, d):
    g = granules(spark, d)
    a = g.groupBy("sample_id", "gene", "comp").agg(F.count(F.lit(1)).alias("n"))
    b = g.groupBy("sample_id", "gene", "comp").agg(F.max("size").alias("largest"))
    return a.join(b, ["sample_id", "gene", "comp"])


def c20_lookup(spark, d):
    r = readings(spark, d).where("cell_id IS NOT NULL").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    return _one_cell(spark, d).where("cell_id IS NOT NULL").select("cell_id").distinct().join(r, "cell_id", "left")


def c22_sweep(spark, d):
    samples = table(spark, d, "cells").select("sample_id").distinct()
    return samples.crossJoin(spark.createDataFrame([(0.2,), (0.5,)], "rho double")).crossJoin(table(spark, d, "scenario_def").select("scenario"))


def c24_hits_per_truth(spark, d):
    """Spheres that hold each cell's centre, on average."""
    c = _soma(spark, d).withColumn("z", F.lit(0.0))
    hit = points_in_spheres(c, granules(spark, d).withColumn("sphere_z", F.lit(0.0)), point_id="cell_id", point_xyz=("global_x", "global_y", "z")).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    return c.select("cell_id").distinct().join(hit, "cell_id", "left").agg(r6(F.avg(F.coalesce("n", F.lit(0)))).alias("mean_hits"))


def e03_tissue_area(spark, d):
    return S.occupied_area(readings(spark, d), 1.0, KEY)


def e18_grid_counts(spark, d):
    return S.grid_counts(readings(spark, d), 25.0, KEY)


def g05_tile_cells(spark, d):
    n = c06_strictly_inside(spark, d).groupBy("spot_id").agg(F.count(F.lit(1)).alias("n"))
    t = tiles(spark, d).select("spot_id").join(n, "spot_id", "left").withColumn("n_cells", F.coalesce("n", F.lit(0)))
    return t.select("spot_id", "n_cells", (F.col("n_cells") > 0).cast("int").alias("has_cell"))


def g06_tile_granules(spark, d):
    hit = S.points_in_boxes(granules(spark, d), tiles(spark, d), point_id="sphere_id", box_id="spot_id", width=50.0, edges="half", keys=KEY, point_xy=_GRXY, carry=["sphere_r", "size", "in_soma_ratio"])
    mean = lambda c: F.avg(F.nanvl(F.col(c), F.lit(None).cast("double")))
    a = hit.groupBy("spot_id").agg(F.count(F.lit(1)).alias("n"), *(mean(c).alias(c) for c in ("sphere_r", "size", "in_soma_ratio")))
    t = tiles(spark, d).select("spot_id").join(a, "spot_id", "left")
    return t.select("spot_id", F.coalesce("n", F.lit(0)).alias("n"), *(F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c) for c in ("sphere_r", "size", "in_soma_ratio")))


def g07_area_density(spark, d):
    t = tiles(spark, d).select("spot_id", "brain_area")
    return t.join(g06_tile_granules(spark, d), "spot_id").where("brain_area IS NOT NULL").groupBy("brain_area").agg(r6(F.avg("n")).alias("density"), F.count(F.lit(1)).alias("n_spots"))


def subtype_of():
    return F.when(F.col("comp") >= 3, "mixed").when(F.col("comp") == 2, "pair").otherwise("single")


def _subtype_counts(spark, d):
    """Granules of each subtype in each tile with an area, zeros included, and of all subtypes together."""
    g = granules(spark, d).withColumn("subtype", subtype_of())
    t = tiles(spark, d).where("brain_area IS NOT NULL").select("sample_id", "spot_id", "brain_area", "global_x", "global_y")
    hit = S.points_in_boxes(g, t, point_id="sphere_id", box_id="spot_id", width=50.0, edges="half", keys=KEY, point_xy=_GRXY, carry=["subtype"])
    n = hit.rollup("spot_id", "subtype").agg(F.count(F.lit(1)).alias("n")).where("spot_id IS NOT NULL").withColumn("subtype", F.coalesce("subtype", F.lit("overall")))
    kinds = spark.createDataFrame([(x,) for x in ("mixed", "pair", "single", "overall")], "subtype string")
    return t.select("sample_id", "spot_id", "brain_area").crossJoin(kinds).join(n, ["spot_id", "subtype"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def g10_subtype_density(spark, d):
    return _subtype_counts(spark, d).groupBy("sample_id", "brain_area", "subtype").agg(r6(F.avg("n")).alias("density"), F.count(F.lit(1)).alias("n_spots"))


def g11_subtype_counts(spark, d):
    return _subtype_counts(spark, d).select("spot_id", "brain_area", "subtype", "n")


SETTINGS = [("default", 1.0, None), ("wide", 1.2, None), ("narrow", 0.8, None), ("fixed", None, 1.0)]


def g19_radius_settings(spark, d):
    """Readings, control ratio and in-soma ratio of each granule at four radius settings; "fixed" is the median radius."""
    return _radius_settings(spark, d, granules(spark, d))


def _radius_settings(spark, d, g):
    median = g.agg(F.median("sphere_r").alias("median_r"))
    settings = spark.createDataFrame(SETTINGS, "setting string, factor double, fixed double")
    g = g.crossJoin(median).crossJoin(settings).withColumn("reach", F.coalesce(F.col("sphere_r") * F.col("factor"), F.col("median_r")))
    g = g.withColumn("key", F.concat_ws("/", F.col("sphere_id").cast("string"), "setting"))
    nc = table(spark, d, "negative_controls").select(F.col("gene").alias("target"), F.lit(1).alias("nc")).distinct()
    r = readings(spark, d).join(nc, "target", "left")
    hit = points_in_spheres(r, g, sphere_id="key", sphere_xyz=("sphere_x", "sphere_y", "layer_z"), radius="reach", carry=["nc", "overlaps_nucleus"])
    n = hit.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count("nc").alias("n_nc"), F.sum("overlaps_nucleus").alias("soma"))
    out = g.select("sphere_id", "setting", "key").join(n, "key", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "n_nc": F.coalesce("n_nc", F.lit(0))})
    return out.select("sphere_id", "setting", "n", r6(F.when(F.col("n") > 0, F.col("n_nc") / F.col("n")).otherwise(0.0)).alias("nc_ratio"), r6(F.when(F.col("n") > 0, F.col("soma") / F.col("n"))).alias("in_soma"))


def g22_control_ratio(spark, d):
    return c02_control_counts(spark, d).join(granules(spark, d).select("sphere_id", "size"), "sphere_id").where("size > 0").select("sphere_id", r6(F.col("n_controls") / F.col("size")).alias("nc_ratio"))


def g21_tile_gene_sums(spark, d):
    """Expression of the granules of each tile, summed by gene."""
    first = S.first_box(c07_half_open(spark, d), point_id="sphere_id", box_id="spot_id")
    profile = points_in_spheres(readings(spark, d), granules(spark, d), sphere_xyz=("sphere_x", "sphere_y", "layer_z"), carry=["target"]).groupBy("sphere_id", "target").agg(F.count(F.lit(1)).alias("n"))
    return first.join(profile, "sphere_id").groupBy("spot_id", "target").agg(F.sum("n").alias("n"))


def n15_subdivided(spark, d):
    return S.subdivided(tiles(spark, d).select("spot_id", "global_x", "global_y", "sample_id"), tile_id="spot_id", width=50.0, into=25.0)


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "cegn" and k[1:3].isdigit()}

_SOMA = "('projection', 'interneuron', 'star glia')"
_D3 = "(g.sphere_x - t.global_x) * (g.sphere_x - t.global_x) + (g.sphere_y - t.global_y) * (g.sphere_y - t.global_y) + ({z} - t.global_z) * ({z} - t.global_z)"
_IN = f"g.sample_id = t.sample_id AND t.global_x BETWEEN g.sphere_x - g.sphere_r AND g.sphere_x + g.sphere_r AND {_D3.format(z='g.sphere_z')} <= g.sphere_r * g.sphere_r"
_INL = f"g.sample_id = t.sample_id AND t.global_x BETWEEN g.sphere_x - g.sphere_r AND g.sphere_x + g.sphere_r AND {_D3.format(z='g.layer_z')} <= g.sphere_r * g.sphere_r"
_TOUCH = """pr AS MATERIALIZED (SELECT a.sphere_id AS a_id, b.sphere_id AS b_id, sqrt((a.sphere_x - b.sphere_x) * (a.sphere_x - b.sphere_x) + (a.sphere_y - b.sphere_y) * (a.sphere_y - b.sphere_y) + (a.sphere_z - b.sphere_z) * (a.sphere_z - b.sphere_z)) AS distance,
 a.sphere_r + b.sphere_r AS reach FROM gr a JOIN gr b ON a.sample_id = b.sample_id AND a.sphere_id < b.sphere_id AND a.gene <> b.gene
 AND abs(a.sphere_x - b.sphere_x) <= a.sphere_r + b.sphere_r AND abs(a.sphere_y - b.sphere_y) <= a.sphere_r + b.sphere_r)"""
_SO = f"so AS (SELECT DISTINCT cell_id, sample_id, global_x, global_y FROM ce WHERE cell_type IN {_SOMA})"
_D2 = "sqrt((g.sphere_x - {a}.global_x) * (g.sphere_x - {a}.global_x) + (g.sphere_y - {a}.global_y) * (g.sphere_y - {a}.global_y))"
_C07 = "SELECT s.spot_id, g.sphere_id FROM sp s JOIN gr g ON s.sample_id = g.sample_id AND g.sphere_x >= s.global_x - 25 AND g.sphere_x < s.global_x + 25 AND g.sphere_y >= s.global_y - 25 AND g.sphere_y < s.global_y + 25"
_C02 = f"""nct AS (SELECT * FROM tx WHERE target IN (SELECT gene FROM negative_controls)), nn AS (SELECT g.sphere_id, count(*) AS n FROM gr g JOIN nct t ON {_INL} GROUP BY g.sphere_id),
cc AS (SELECT gr.sphere_id, gr.size, coalesce(n, 0) AS n_controls FROM gr LEFT JOIN nn ON gr.sphere_id = nn.sphere_id)"""
_SUB = f"""sub AS (SELECT s.spot_id, g.sphere_id, CASE WHEN g.comp >= 3 THEN 'mixed' WHEN g.comp = 2 THEN 'pair' ELSE 'single' END AS subtype FROM ({_C07}) s JOIN gr g ON s.sphere_id = g.sphere_id),
subn AS (SELECT spot_id, subtype, count(*) AS n FROM sub GROUP BY ALL UNION ALL SELECT spot_id, 'overall', count(*) FROM sub GROUP BY spot_id),
sc AS (SELECT sp.sample_id, sp.spot_id, sp.brain_area, k.subtype, coalesce(subn.n, 0) AS n FROM sp CROSS JOIN (SELECT unnest(['mixed', 'pair', 'single', 'overall']) AS subtype) k
 LEFT JOIN subn ON subn.spot_id = sp.spot_id AND subn.subtype = k.subtype WHERE sp.brain_area IS NOT NULL)"""
_G06 = f"""h AS (SELECT c.spot_id, count(*) AS n, avg(CASE WHEN isnan(g.sphere_r) THEN NULL ELSE g.sphere_r END) AS r, avg(CASE WHEN isnan(g.size) THEN NULL ELSE g.size END) AS s, avg(CASE WHEN isnan(g.in_soma_ratio) THEN NULL ELSE g.in_soma_ratio END) AS i
 FROM ({_C07}) c JOIN gr g ON c.sphere_id = g.sphere_id GROUP BY c.spot_id),
tg AS (SELECT sp.spot_id, sp.brain_area, coalesce(n, 0) AS n, round(coalesce(r, 0), 9) AS sphere_r, round(coalesce(s, 0), 9) AS size, round(coalesce(i, 0), 9) AS in_soma_ratio FROM sp LEFT JOIN h ON sp.spot_id = h.spot_id)"""
_ONE = "oc AS (SELECT sample_id, cell_id, min(cell_type) AS cell_type, min(brain_area) AS brain_area FROM ce GROUP BY sample_id, cell_id)"
_GRID = "b AS (SELECT sample_id, floor(min(global_x) / {w}) * {w} AS x0, greatest(ceil(max(global_x) / {w}) - floor(min(global_x) / {w}), 1) AS nx, floor(min(global_y) / {w}) * {w} AS y0, greatest(ceil(max(global_y) / {w}) - floor(min(global_y) / {w}), 1) AS ny FROM tx GROUP BY sample_id), bn AS (SELECT tx.sample_id, least(floor((global_x - x0) / {w}), nx - 1) AS ix, least(floor((global_y - y0) / {w}), ny - 1) AS iy FROM tx JOIN b ON tx.sample_id = b.sample_id)"

SQL = {
    "c01_other_markers": sql(f"SELECT g.sphere_id, count(*) AS n_other, count(DISTINCT t.target) AS n_genes FROM gr g JOIN tx t ON {_IN} AND t.target <> g.gene GROUP BY g.sphere_id"),
    "c02_control_counts": sql(f"{_C02} SELECT sphere_id, n_controls FROM cc"),
    "c03_buffered_profile": sql(f"SELECT g.sphere_id, t.target, count(*) AS n FROM gr g JOIN tx t ON {_INL.replace('g.sphere_r', '(g.sphere_r + 0.5)')} GROUP BY ALL"),
    "c04_touching": sql(f"{_TOUCH} SELECT a_id, b_id, round(distance, 6) AS distance FROM pr WHERE distance < reach"),
    "c05_own_points_of_pairs": sql(f"""{_TOUCH}, own AS (SELECT g.sphere_id, t.tx_id FROM gr g JOIN tx t ON {_IN} AND t.target = g.gene)
SELECT a_id, b_id, count(*) AS n_points FROM (SELECT a_id, b_id, tx_id FROM pr JOIN own ON a_id = sphere_id WHERE distance < reach UNION ALL SELECT a_id, b_id, tx_id FROM pr JOIN own ON b_id = sphere_id WHERE distance < reach) GROUP BY ALL"""),
    "c06_strictly_inside": sql(f"{_SO} SELECT DISTINCT s.spot_id, so.cell_id FROM so JOIN sp s ON s.sample_id = so.sample_id AND abs(so.global_x - s.global_x) < 25 AND abs(so.global_y - s.global_y) < 25"),
    "c07_half_open": sql(_C07),
    "c08_first_tile": sql(f"SELECT sphere_id, min(spot_id) AS spot_id FROM ({_C07.replace('25', '30')}) GROUP BY sphere_id"),
    "c09_multi_match": sql("SELECT s.spot_id, t.target, count(*) AS n FROM sp s JOIN tx t ON s.sample_id = t.sample_id AND t.global_x >= s.global_x - 30 AND t.global_x < s.global_x + 30 AND t.global_y >= s.global_y - 30 AND t.global_y < s.global_y + 30 GROUP BY ALL"),
    "c10_distance_band": sql(f"{_SO} SELECT so.cell_id, count(DISTINCT g.sphere_id) AS n FROM so JOIN gr g ON so.sample_id = g.sample_id AND {_D2.format(a='so')} <= 10 GROUP BY so.cell_id"),
    "c11_tile_band": sql(f"SELECT s.spot_id, count(*) AS n FROM sp s JOIN gr g ON s.sample_id = g.sample_id AND {_D2.format(a='s')} <= 40 GROUP BY s.spot_id"),
    "c12_tile_neighbours": sql("SELECT a.spot_id, b.spot_id AS other_spot_id FROM sp a JOIN sp b ON a.sample_id = b.sample_id AND (a.global_x - b.global_x) * (a.global_x - b.global_x) + (a.global_y - b.global_y) * (a.global_y - b.global_y) <= 5625"),
    "c13_nearest_label": sql(f"""o AS (SELECT g.sphere_id, s.spot_id, s.brain_area, row_number() OVER (PARTITION BY g.sphere_id ORDER BY {_D2.format(a="s")}, s.spot_id) AS k FROM gr g JOIN sp s ON g.sample_id = s.sample_id WHERE s.brain_area IS NOT NULL)
SELECT sphere_id, spot_id, brain_area FROM o WHERE k = 1"""),
    "c14_nearest_within": sql(f"""{_SO}, o AS (SELECT so.cell_id, g.sphere_id, {_D2.format(a="so")} AS dd, row_number() OVER (PARTITION BY so.sample_id, so.cell_id ORDER BY {_D2.format(a="so")}, g.sphere_id) AS place FROM so JOIN gr g ON so.sample_id = g.sample_id AND {_D2.format(a="so")} < 10)
SELECT cell_id, sphere_id, round(dd, 6) AS distance, CAST(place AS INT) AS place FROM o WHERE place <= 5"""),
    "c15_nearest_others": sql("""o AS (SELECT a.sphere_id, sqrt((a.sphere_x - b.sphere_x) * (a.sphere_x - b.sphere_x) + (a.sphere_y - b.sphere_y) * (a.sphere_y - b.sphere_y) + (a.sphere_z - b.sphere_z) * (a.sphere_z - b.sphere_z)) AS dd, b.sphere_id AS o FROM gr a JOIN gr b ON a.sample_id = b.sample_id AND a.sphere_id <> b.sphere_id),
k AS (SELECT *, row_number() OVER (PARTITION BY sphere_id ORDER BY dd, o) AS place FROM o)
SELECT sphere_id, round(avg(dd), 6) AS mean_distance FROM k WHERE place <= 2 GROUP BY sphere_id"""),
    "c16_nearest_tiles": sql("""o AS (SELECT a.spot_id, b.spot_id AS other_spot_id, row_number() OVER (PARTITION BY a.spot_id ORDER BY sqrt((a.global_x - b.global_x) * (a.global_x - b.global_x) + (a.global_y - b.global_y) * (a.global_y - b.global_y)), b.spot_id) AS place FROM sp a JOIN sp b ON a.sample_id = b.sample_id)
SELECT spot_id, other_spot_id, CAST(place AS INT) AS place FROM o WHERE place <= 4"""),
    "c17_labels": sql(f"{_ONE}, n AS (SELECT sample_id, cell_id, count(*) AS n FROM gr WHERE cell_id IS NOT NULL GROUP BY ALL) SELECT n.sample_id, n.cell_id, n.n, oc.cell_type, oc.brain_area FROM n LEFT JOIN oc ON n.sample_id = oc.sample_id AND n.cell_id = oc.cell_id"),
    "c18_covariate": sql(f"{_ONE}, n AS (SELECT brain_area, count(*) AS n_cells FROM oc GROUP BY brain_area) SELECT sp.spot_id, sp.brain_area, n.n_cells FROM sp LEFT JOIN n ON sp.brain_area = n.brain_area"),
    "c19_three_keys": sql("SELECT sample_id, gene, comp, count(*) AS n, max(size) AS largest FROM gr WHERE comp IS NOT NULL GROUP BY sample_id, gene, comp"),
    "c20_lookup": sql("SELECT c.cell_id, n FROM (SELECT DISTINCT cell_id FROM ce WHERE cell_id IS NOT NULL) c LEFT JOIN (SELECT cell_id, count(*) AS n FROM tx GROUP BY cell_id) t ON c.cell_id = t.cell_id"),
    "c22_sweep": "SELECT sample_id, rho, scenario FROM (SELECT DISTINCT sample_id FROM cells), (SELECT unnest([0.2::DOUBLE, 0.5::DOUBLE]) AS rho), scenario_def",
    "c24_hits_per_truth": sql(f"""{_SO}, h AS (SELECT so.cell_id, count(DISTINCT g.sphere_id) AS n FROM so JOIN gr g ON so.sample_id = g.sample_id AND (g.sphere_x - so.global_x) * (g.sphere_x - so.global_x) + (g.sphere_y - so.global_y) * (g.sphere_y - so.global_y) <= g.sphere_r * g.sphere_r GROUP BY so.cell_id)
SELECT round(avg(coalesce(n, 0)), 6) AS mean_hits FROM (SELECT DISTINCT cell_id FROM so) s LEFT JOIN h ON s.cell_id = h.cell_id"""),
    "e03_tissue_area": sql(f"{_GRID.format(w='1.0')} SELECT sample_id, count(*) * 1.0::DOUBLE AS area FROM (SELECT DISTINCT sample_id, ix, iy FROM bn) GROUP BY sample_id"),
    "e18_grid_counts": sql(f"""{_GRID.format(w="25.0")}, gx AS (SELECT b.*, unnest(generate_series(0, CAST(nx AS BIGINT) - 1)) AS ix FROM b), gy AS (SELECT gx.*, unnest(generate_series(0, CAST(ny AS BIGINT) - 1)) AS iy FROM gx),
nn AS (SELECT sample_id, ix, iy, count(*) AS n FROM bn GROUP BY ALL)
SELECT gy.sample_id, CAST(gy.ix * gy.ny + gy.iy AS BIGINT) AS spot, gy.x0 + (gy.ix + 0.5) * 25.0::DOUBLE AS global_x, gy.y0 + (gy.iy + 0.5) * 25.0::DOUBLE AS global_y, coalesce(nn.n, 0) AS n FROM gy LEFT JOIN nn ON gy.sample_id = nn.sample_id AND gy.ix = nn.ix AND gy.iy = nn.iy"""),
    "g05_tile_cells": sql(f"""{_SO}, h AS (SELECT s.spot_id, count(DISTINCT so.cell_id) AS n FROM so JOIN sp s ON s.sample_id = so.sample_id AND abs(so.global_x - s.global_x) < 25 AND abs(so.global_y - s.global_y) < 25 GROUP BY s.spot_id)
SELECT sp.spot_id, coalesce(n, 0) AS n_cells, CASE WHEN n > 0 THEN 1 ELSE 0 END AS has_cell FROM sp LEFT JOIN h ON sp.spot_id = h.spot_id"""),
    "g06_tile_granules": sql(f"{_G06} SELECT spot_id, n, sphere_r, size, in_soma_ratio FROM tg"),
    "g07_area_density": sql(f"{_G06} SELECT brain_area, round(avg(n), 6) AS density, count(*) AS n_spots FROM tg WHERE brain_area IS NOT NULL GROUP BY brain_area"),
    "g10_subtype_density": sql(f"{_SUB} SELECT sample_id, brain_area, subtype, round(avg(n), 6) AS density, count(*) AS n_spots FROM sc GROUP BY sample_id, brain_area, subtype"),
    "g11_subtype_counts": sql(f"{_SUB} SELECT spot_id, brain_area, subtype, n FROM sc"),
    "g19_radius_settings": sql(f"""md AS (SELECT median(sphere_r) AS m FROM gr), gs AS (SELECT gr.* EXCLUDE (sphere_r), k.setting, CASE k.setting WHEN 'default' THEN sphere_r WHEN 'wide' THEN sphere_r * 1.2::DOUBLE WHEN 'narrow' THEN sphere_r * 0.8::DOUBLE ELSE m END AS sphere_r
 FROM gr, md, (SELECT unnest(['default', 'wide', 'narrow', 'fixed']) AS setting) k),
h AS (SELECT g.sphere_id, g.setting, count(*) AS n, count(*) FILTER (t.target IN (SELECT gene FROM negative_controls)) AS nc, sum(t.overlaps_nucleus) AS soma FROM gs g JOIN tx t ON {_INL} GROUP BY g.sphere_id, g.setting)
SELECT gs.sphere_id, gs.setting, coalesce(h.n, 0) AS n, round(coalesce(nc / h.n, 0), 6) AS nc_ratio, round(soma / h.n, 6) AS in_soma FROM gs LEFT JOIN h ON gs.sphere_id = h.sphere_id AND gs.setting = h.setting"""),
    "g21_tile_gene_sums": sql(f"""f AS (SELECT sphere_id, min(spot_id) AS spot_id FROM ({_C07}) GROUP BY sphere_id)
SELECT f.spot_id, t.target, count(*) AS n FROM f JOIN gr g ON f.sphere_id = g.sphere_id JOIN tx t ON {_INL} GROUP BY ALL"""),
    "g22_control_ratio": sql(f"{_C02} SELECT sphere_id, round(n_controls / size, 6) AS nc_ratio FROM cc WHERE size > 0"),
    "n15_subdivided": sql("SELECT spot_id || '_25um_q' || i AS spot_id, global_x + dx AS global_x, global_y + dy AS global_y, sample_id FROM sp, (SELECT unnest([0, 1, 2, 3]) AS i, unnest([-12.5, 12.5, -12.5, 12.5]::DOUBLE[]) AS dx, unnest([-12.5, -12.5, 12.5, 12.5]::DOUBLE[]) AS dy)"),
}
