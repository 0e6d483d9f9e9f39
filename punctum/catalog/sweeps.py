"""Grid expression, masks, real folders, smoothing and soft expression, sweeps and tests against the rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctum.catalog.base import granules, readings, sql, tiles
from punctum.catalog.detection import PLANES
from punctum.catalog.profiles import _PROFILE, _TC, KEY, _AT, _kinds, _one_place, _tile_counts
from punctum.catalog.relational import _SIM
from punctum.catalog.simulation import _metrics, _PTS
from punctum.catalog.spatial import _C07, _D2, _GRID, _INL, _SO, touching_pairs
from punctum.catalog.subtypes import _scores
from punctum.functions import geometry as G
from punctum.operators import embedding as E
from punctum.operators import evaluate as V
from punctum.operators import simulate as M
from punctum.operators import spatial as S
from punctum.operators import stats as T
from punctum.operators import subtype as U
from punctum.operators.compaction import identified_points
from punctum.operators.density import DetectorParams, detected_spheres, profile
from punctum.operators.merge import simulation_rule
from punctum.operators.proximity import points_in_spheres
from punctum.operators.raster import MaskParams, images, mask_pixels
from punctum.plans.shared import staging_path, written_once
from punctum.sources import files, table

r6 = lambda c: F.round(c, 6)
PIXEL = 10.0


def a07_mask_lookup(spark, d):
    """Readings by plane in and out of the bright pixels of an image of all readings of that plane."""
    r = readings(spark, d).select(G.nearest_plane(F.col("global_z"), list(PLANES)).alias("z"), F.floor(F.col("global_x") / PIXEL).alias("col"), F.floor(F.col("global_y") / PIXEL).alias("row"))
    n = written_once(r.groupBy("z", "row", "col").agg(F.count(F.lit(1)).alias("n")), "pixels")
    ends = n.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    size = {"n_rows": F.col("r1") - F.col("r0") + 1, "n_cols": F.col("c1") - F.col("c0") + 1}
    n = n.crossJoin(ends).withColumns({"row": (F.col("row") - F.col("r0")).cast("int"), "col": (F.col("col") - F.col("c0")).cast("int"), **{k: v.cast("int") for k, v in size.items()}})
    mask = mask_pixels(images(n.withColumn("value", F.col("n").cast("double"))), MaskParams(block=5, c=-1.0, area=1, radius=1))
    hit = n.select("z", "row", "col", "n").join(mask.withColumn("in", F.lit(1)), ["z", "row", "col"], "left")
    return hit.groupBy("z").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("in").isNotNull(), F.col("n")).otherwise(0)).alias("n_in"))


def a09_real_folders(spark, d):
    """Points written below a folder for each scenario and seed, found again by pattern, with both told by the path."""
    p = identified_points(table(spark, d, "simulated_parquet"), table(spark, d, "scenario_def")).where("scenario IS NOT NULL AND seed IS NOT NULL")
    rows = p.select(F.col("scenario").alias("kind"), (F.col("seed") % 7).alias("fold"), "point_no")
    path = files.write_shards(rows, staging_path(spark, "found"), ["kind", "fold"])
    found = files.discover(spark, f"{path}/kind=*/fold=*/*.parquet", {"scenario": "kind=([^/]+)", "remainder": "fold=([0-9]+)"})
    return found.groupBy(F.url_decode("scenario").alias("scenario"), F.col("remainder").cast("long").alias("remainder")).agg(F.count(F.lit(1)).alias("n"), F.max("point_no").alias("last"))


def b10_scaled_planes(spark, d):
    """Plane numbers to micrometres."""
    return readings(spark, d).select("tx_id", (F.col("global_z") * 1.5).alias("global_z"))


def c21_profile_zip(spark, d):
    """Granules beside the totals of their profile, under a guard that each side has every id once."""
    g = granules(spark, d).select("sphere_id", "gene")
    totals = profile(readings(spark, d), granules(spark, d)).groupBy("sphere_id").agg(F.sum("n").alias("n"))
    return S.one_to_one(g, totals, ["sphere_id"]).select("sphere_id", "gene", F.coalesce("n", F.lit(0)).alias("n_reads"))


def e18_gene_expression(spark, d):
    """Readings of each gene in each cell of the grid."""
    return S.grid_expression(readings(spark, d), 25.0, KEY)


def f14_settings_correlation(spark, d):
    """Correlation of each gene's expression in the granules at their radius and at 1.2 times it."""
    r, g = readings(spark, d), granules(spark, d)
    wide = profile(r, g.withColumn("sphere_r", F.col("sphere_r") * 1.2))
    return T.profile_correlation(profile(r, g), wide, table(spark, d, "gene_panel").where("gene IS NOT NULL"), g).select("gene", r6("corr").alias("corr"))


def _by_count(spark, d):
    g = granules(spark, d).select("sphere_id", F.when(F.col("comp") >= 3, "mixed").when(F.col("comp") == 2, "pair").otherwise("single").alias("subtype"))
    e = profile(readings(spark, d), granules(spark, d)).select("sphere_id", "target", F.log1p("n").alias("value"))
    return T.t_test_against_rest(e, g, "sphere_id", "subtype")


def f19_against_rest(spark, d):
    """Expression of each gene in the granules of a subtype against all others."""
    return _by_count(spark, d).select("subtype", "target", F.round("t", 4).alias("t"), F.round("df", 3).alias("df"))


def f19_against_rest_p(spark, d):
    return _by_count(spark, d)


def f20_mixture(spark, d):
    return T.mixture_labels(_scores(spark, d), list(U.PARTS), 5, 1, "sphere_id")


def f20_topics(spark, d):
    genes = [r[0] for r in table(spark, d, "gene_panel").where("gene IS NOT NULL").select("gene").distinct().orderBy("gene").collect()]  # a panel of fixed size
    return T.topic_shares(profile(readings(spark, d), granules(spark, d)), genes, 5, 1, "sphere_id")


def f21_number_sweep(spark, d):
    """Inertia, silhouette and agreement over five seeds for several numbers of clusters."""
    return T.cluster_number_sweep(_scores(spark, d), list(U.PARTS), [3, 5, 8], "sphere_id")


def f21_pairwise_agreement(spark, d):
    """Agreement of every two of the labels gene, composition and size of the granules."""
    g = granules(spark, d).select(F.col("gene").alias("a"), F.coalesce(F.col("comp").cast("string"), F.lit("-")).alias("b"), F.coalesce(F.col("size").cast("string"), F.lit("-")).alias("c"))
    return T.pairwise_rand(g, ["a", "b", "c"]).select("first", "second", r6("ari").alias("ari"))


SHARES = (0.0, 0.2, 0.5, 0.8, 1.0)


def m08_simulation_rules(spark, d):
    """Crossing spheres that each rule of the simulation study would merge, by its share and l."""
    g = granules(spark, d).where("sphere_r > 0")
    r = g.select("sphere_id", "sphere_r")
    t = touching_pairs(g).join(r.withColumnsRenamed({"sphere_id": "a_id", "sphere_r": "ra"}), "a_id").join(r.withColumnsRenamed({"sphere_id": "b_id", "sphere_r": "rb"}), "b_id").where("distance > abs(ra - rb)")
    va, vb, both = G.volume(F.col("ra")), G.volume(F.col("rb")), G.shared_volume(F.col("distance"), F.col("ra"), F.col("rb"))
    by = {"volume": both / F.least(va, vb), "jaccard": both / (va + vb - both), "dice": 2 * both / (va + vb), "distance": F.col("distance") / (F.col("ra") + F.col("rb"))}
    t = t.select(*(F.round(c, 9).alias(n) for n, c in by.items()))
    rules = [simulation_rule(n, p, l) for n in by for p in SHARES for l in (1.0, 1.25)]  # noqa: E741
    counts = [F.count_if(F.col(x.by) < F.lit(x.threshold * x.l) if x.by == "distance" else F.col(x.by) >= F.lit(x.threshold)).alias(f"r{i}") for i, x in enumerate(rules)]
    rows = [F.struct(F.lit(x.by).alias("by"), F.lit(x.threshold).alias("threshold"), F.lit(x.l).alias("l"), F.col(f"r{i}").alias("n")) for i, x in enumerate(rules)]
    return t.agg(*counts).select(F.explode(F.array(*rows)).alias("r")).select("r.by", r6("r.threshold").alias("threshold"), "r.l", "r.n")


def n07_custom_markers(spark, d):
    """Subtypes by markers of the caller: two categories, the others without a gene."""
    markers = table(spark, d, "gene_panel").select("gene", F.when(F.col("gene") < "M", "pre").otherwise("post").alias("category"))
    scores = U.category_scores(profile(readings(spark, d), granules(spark, d)), granules(spark, d).select("sphere_id"), markers, "sphere_id")
    return U.classified(scores).groupBy("subtype", "subtype_simple").agg(F.count(F.lit(1)).alias("n"))


def n12_tile_soma(spark, d):
    """Expression of the cells of each tile, each cell in its first tile, summed by gene."""
    c = _one_place(spark, d)
    first = S.first_box(S.points_in_boxes(c, tiles(spark, d), point_id="cell_id", box_id="spot_id", width=50.0, edges="half", keys=KEY), point_id="cell_id", box_id="spot_id")
    counts = readings(spark, d).where("cell_id IS NOT NULL").groupBy("cell_id", "target").agg(F.count(F.lit(1)).alias("n"))
    return first.join(counts, "cell_id").groupBy("spot_id", "target").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_cells"))


def n13_mean(spark, d):
    """Plain mean over the tiles within 75 µm."""
    t = tiles(spark, d)
    near = E.neighbours(t, t.withColumnRenamed("spot_id", "other_spot_id"), 75.0, centre_id="spot_id", point_id="other_spot_id", keys=KEY, centre_xy=("global_x", "global_y"), point_xy=("global_x", "global_y"))
    return E.smoothed(_tile_counts(spark, d), near, tile_id="spot_id", other_id="other_spot_id", label="subtype", value="n", weight=F.lit(1.0)).select("spot_id", "subtype", r6("n").alias("n"))


def n13_nearest(spark, d):
    """Gaussian mean over the five nearest tiles, itself among them."""
    s = E.smoothed_by_nearest(_tile_counts(spark, d), tiles(spark, d), 5, tile_id="spot_id", label="subtype", value="n", keys=KEY, xy=("global_x", "global_y"), cell=100.0)
    return s.select("spot_id", "subtype", r6("n").alias("n"))


def _around(spark, d, kernel, sigma=25.0):
    return E.neighbours(tiles(spark, d), _kinds(spark, d), E.support(kernel, sigma, 50.0), centre_id="spot_id", point_id="sphere_id", carry=["subtype"], **_AT)


def n14_soft_uniform(spark, d):
    return E.soft_counts(_around(spark, d, "uniform"), tile_id="spot_id", label="subtype", kernel="uniform", sigma=25.0)


def n14_soft_genes(spark, d):
    """Gaussian-weighted expression around each tile centre, as shares of the tile."""
    e = E.soft_expression(_around(spark, d, "gaussian"), profile(readings(spark, d), granules(spark, d)), tile_id="spot_id", point_id="sphere_id", kernel="gaussian", sigma=25.0)
    return e.select("spot_id", "target", r6("value").alias("value"))


def v02_single_gene(spark, d):
    """Aggregates of one gene outside and inside nuclei."""
    s = M.simulation(spark, M.Region(100.0, 100.0), densities={"A": 0.08}, outside=60, inside=12, mean_points=20.0, seed=5)
    return s.groupBy("type", "in_nucleus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("granule_id").alias("n_granules"))


def v04_overlapping_metrics(spark, d):
    """At 0.6 and 0.3 overlapping spheres can hold most of one group, so matches are one to one."""
    return _metrics(spark, d, 0.6, 0.3)


RATIOS = ((0.8, 0.1, 0.1), (0.5, 0.4, 0.1), (0.5, 0.1, 0.4), (0.2, 0.4, 0.4))


def v15_ratio_sweep(spark, d):
    """Detection of simulated aggregates at several shares of background, aggregates outside and inside nuclei."""
    parts = []
    for i, (csr, outside, inside) in enumerate(RATIOS):
        s = M.simulation(spark, M.Region(120.0, 120.0), densities={"A": 0.1 * csr, "B": 0.06 * csr}, outside=int(150 * outside), inside=int(150 * inside), mean_points=16.0, seed=11 + 10 * i)
        parts.append(s.withColumn("sample_id", F.lit(f"{csr}/{outside}/{inside}")))
    s = parts[0]
    for part in parts[1:]:
        s = s.unionByName(part)
    s = written_once(s.withColumn("truth", F.when(F.col("granule_id") >= 0, F.col("granule_id"))), "simulated")
    found = written_once(detected_spheres(s, DetectorParams(minspl=4, in_soma_thr=0.5), keep_cell=False), "spheres")
    m = V.point_metrics(points_in_spheres(s, found), s, found, truth="truth", keys=KEY)
    return m.select(F.col("sample_id").alias("ratio"), "tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"))


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "abcefmnv" and k[1:3].isdigit()}

_KD = "CASE WHEN comp >= 3 THEN 'mixed' WHEN comp = 2 THEN 'pair' ELSE 'single' END"
_T2 = "(a.global_x - b.global_x) ** 2 + (a.global_y - b.global_y) ** 2"
_SOFT = f"ne AS MATERIALIZED (SELECT s.spot_id, g.sphere_id, {_KD} AS subtype, {_D2.format(a='s')} AS d FROM sp s JOIN gr g ON s.sample_id = g.sample_id AND {_D2.format(a='s')} <= {{r}})"


def _rules_sql() -> str:
    rows = [(n, p if n == "distance" else (1 - p) / l, l) for n in ("volume", "jaccard", "dice", "distance") for p in SHARES for l in (1.0, 1.25)]  # noqa: E741
    return " UNION ALL ".join(f"SELECT '{n}' AS \"by\", round({t!r}::DOUBLE, 6) AS threshold, {l!r}::DOUBLE AS l, count(*) FILTER ({n} {'<' if n == 'distance' else '>='} {t * l if n == 'distance' else t!r}::DOUBLE) AS n FROM q" for n, t, l in rows)  # noqa: E741


SQL = {
    "a07_mask_lookup": sql("""pl AS (SELECT unnest([0.0, 1.5, 3.0, 4.5, 6.0, 7.5, 9.0]::DOUBLE[]) AS v), px AS MATERIALIZED (SELECT (SELECT arg_min(v, abs(v - global_z) * 1000000 + v / 1000000) FROM pl) AS z, CAST(floor(global_x / 10) AS BIGINT) AS c, CAST(floor(global_y / 10) AS BIGINT) AS r FROM tx),
en AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM px), zs AS (SELECT DISTINCT z FROM px), gr1 AS (SELECT z, unnest(generate_series(r0, r1)) AS r FROM zs, en), gr2 AS (SELECT gr1.z, gr1.r, unnest(generate_series(c0, c1)) AS c FROM gr1, en),
im AS MATERIALIZED (SELECT g.z, g.r, g.c, coalesce(k.n, 0) AS n FROM gr2 g LEFT JOIN (SELECT z, r, c, count(*) AS n FROM px GROUP BY ALL) k ON g.z = k.z AND g.r = k.r AND g.c = k.c),
mm AS (SELECT z, min(n) AS lo, max(n) AS hi FROM im GROUP BY z), sc AS MATERIALIZED (SELECT im.z, r, c, floor((n - lo) / (hi - lo) * 255) AS v FROM im JOIN mm ON im.z = mm.z WHERE hi > lo),
of AS (SELECT a.i, b.i AS j FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS i) a, (SELECT unnest([-2, -1, 0, 1, 2]) AS i) b),
br AS MATERIALIZED (SELECT a.z, a.r, a.c FROM sc a, of, en JOIN sc b ON b.z = a.z AND b.r = least(greatest(a.r + of.i, en.r0), en.r1) AND b.c = least(greatest(a.c + of.j, en.c0), en.c1) GROUP BY a.z, a.r, a.c, a.v HAVING a.v > sum(b.v) / 25.0 + 1),
ma AS (SELECT DISTINCT br.z, br.r + o.i AS r, br.c + o.j AS c FROM br, (SELECT unnest([0, -1, 1, 0, 0]) AS i, unnest([0, 0, 0, -1, 1]) AS j) o)
SELECT px.z, count(*) AS n, count(ma.z) AS n_in FROM px LEFT JOIN ma ON px.z = ma.z AND px.r = ma.r AND px.c = ma.c GROUP BY px.z"""),
    "a09_real_folders": f"SELECT sc AS scenario, sd % 7 AS remainder, count(*) AS n, max(point_no) AS last FROM {_SIM} WHERE sd IS NOT NULL GROUP BY ALL",
    "b10_scaled_planes": sql("SELECT tx_id, global_z * 1.5::DOUBLE AS global_z FROM tx"),
    "c21_profile_zip": sql(f"{_PROFILE} SELECT gr.sphere_id, any_value(gr.gene) AS gene, CAST(coalesce(sum(pf.n), 0) AS BIGINT) AS n_reads FROM gr LEFT JOIN pf ON gr.sphere_id = pf.sphere_id GROUP BY gr.sphere_id"),
    "e18_gene_expression": sql(f"{_GRID.format(w='25.0').replace('SELECT tx.sample_id, least', 'SELECT tx.sample_id, tx.target, ny, least')} SELECT sample_id, CAST(ix * ny + iy AS BIGINT) AS spot, target, count(*) AS n FROM bn GROUP BY ALL"),
    "f14_settings_correlation": sql(f"""{_PROFILE}, pw AS (SELECT g.sphere_id, t.target, count(*) AS n FROM (SELECT * EXCLUDE (sphere_r), sphere_r * 1.2::DOUBLE AS sphere_r FROM gr) g JOIN tx t ON {_INL} GROUP BY ALL),
bo AS (SELECT coalesce(pf.target, pw.target) AS gene, coalesce(pf.n, 0)::DOUBLE AS x, coalesce(pw.n, 0)::DOUBLE AS y FROM pf FULL JOIN pw ON pf.sphere_id = pw.sphere_id AND pf.target = pw.target),
s AS (SELECT gene, (SELECT count(*)::DOUBLE FROM gr) AS m, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM bo GROUP BY gene)
SELECT p.gene, round(coalesce((m * sxy - sx * sy) / nullif(sqrt((m * sxx - sx * sx) * (m * syy - sy * sy)), 0), 1.0), 6) AS corr FROM (SELECT DISTINCT gene FROM gene_panel WHERE gene IS NOT NULL) p LEFT JOIN s ON p.gene = s.gene"""),
    "f19_against_rest": sql(f"""{_PROFILE}, kd AS (SELECT sphere_id, {_KD} AS subtype FROM gr), n1 AS (SELECT subtype, count(*)::DOUBLE AS n1, (SELECT count(*) FROM gr) - count(*)::DOUBLE AS n2 FROM kd GROUP BY subtype),
s1 AS (SELECT subtype, target, sum(ln(1 + n)) AS s1, sum(ln(1 + n) ** 2) AS q1 FROM pf JOIN kd ON pf.sphere_id = kd.sphere_id GROUP BY ALL), sa AS (SELECT target, sum(s1) AS s, sum(q1) AS q FROM s1 GROUP BY target),
g AS (SELECT n1.subtype, sa.target, n1, n2, coalesce(s1, 0) AS s1, coalesce(q1, 0) AS q1, s, q FROM n1 CROSS JOIN sa LEFT JOIN s1 ON s1.subtype = n1.subtype AND s1.target = sa.target),
e AS (SELECT *, s1 / n1 AS m1, (s - s1) / n2 AS m2, greatest(q1 - s1 * s1 / n1, 0) / (n1 - 1) / n1 AS e1, greatest(q - q1 - (s - s1) ** 2 / n2, 0) / (n2 - 1) / n2 AS e2 FROM g)
SELECT subtype, target, round((m1 - m2) / nullif(sqrt(e1 + e2), 0), 4) AS t, round((e1 + e2) ** 2 / nullif(e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1), 0), 3) AS df FROM e"""),
    "f21_pairwise_agreement": sql("""l AS (SELECT gene AS a, coalesce(CAST(comp AS VARCHAR), '-') AS b, coalesce(CAST(size AS VARCHAR), '-') AS c FROM gr), pr AS (SELECT 'a' AS first, 'b' AS second, a AS x, b AS y FROM l UNION ALL SELECT 'a', 'c', a, c FROM l UNION ALL SELECT 'b', 'c', b, c FROM l),
ct AS (SELECT first, second, x, y, count(*)::DOUBLE AS n FROM pr GROUP BY ALL), i AS (SELECT first, second, sum(n * (n - 1) / 2) AS i, sum(n) AS t FROM ct GROUP BY ALL),
sx AS (SELECT first, second, sum(n * (n - 1) / 2) AS x FROM (SELECT first, second, x, sum(n) AS n FROM ct GROUP BY ALL) GROUP BY ALL), sy AS (SELECT first, second, sum(n * (n - 1) / 2) AS y FROM (SELECT first, second, y, sum(n) AS n FROM ct GROUP BY ALL) GROUP BY ALL)
SELECT i.first, i.second, round((i - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)), 6) AS ari FROM i JOIN sx ON i.first = sx.first AND i.second = sx.second JOIN sy ON i.first = sy.first AND i.second = sy.second"""),
    "m08_simulation_rules": sql(f"""pr AS (SELECT a.sphere_r AS ra, b.sphere_r AS rb, sqrt((a.sphere_x - b.sphere_x) ** 2 + (a.sphere_y - b.sphere_y) ** 2 + (a.sphere_z - b.sphere_z) ** 2) AS d FROM gr a JOIN gr b ON a.sample_id = b.sample_id AND a.sphere_id < b.sphere_id AND a.gene <> b.gene AND a.sphere_r > 0 AND b.sphere_r > 0),
vo AS (SELECT *, 4.0 / 3.0 * pi() * ra ** 3 AS va, 4.0 / 3.0 * pi() * rb ** 3 AS vb, pi() * (ra + rb - d) ** 2 * (d * d + 2 * d * (ra + rb) - 3 * (ra - rb) ** 2) / (12 * d) AS sv FROM pr WHERE d < ra + rb AND d > abs(ra - rb)),
q AS MATERIALIZED (SELECT round(sv / least(va, vb), 9) AS volume, round(sv / (va + vb - sv), 9) AS jaccard, round(2 * sv / (va + vb), 9) AS dice, round(d / (ra + rb), 9) AS distance FROM vo) {_rules_sql()}"""),
    "n12_tile_soma": sql(f"""{_SO}, so1 AS (SELECT * FROM so WHERE cell_id IN (SELECT cell_id FROM so GROUP BY cell_id HAVING count(*) = 1)),
f AS (SELECT so1.cell_id, min(s.spot_id) AS spot_id FROM so1 JOIN sp s ON s.sample_id = so1.sample_id AND so1.global_x >= s.global_x - 25 AND so1.global_x < s.global_x + 25 AND so1.global_y >= s.global_y - 25 AND so1.global_y < s.global_y + 25 GROUP BY so1.cell_id),
k AS (SELECT cell_id, target, count(*) AS n FROM tx WHERE cell_id IS NOT NULL GROUP BY ALL) SELECT f.spot_id, k.target, CAST(sum(k.n) AS BIGINT) AS n, count(*) AS n_cells FROM f JOIN k ON f.cell_id = k.cell_id GROUP BY ALL"""),
    "n13_mean": sql(f"""{_TC}, nb AS (SELECT a.spot_id, b.spot_id AS o FROM sp a JOIN sp b ON a.sample_id = b.sample_id AND {_T2} <= 5625), tt AS (SELECT spot_id, count(*) AS total FROM nb GROUP BY spot_id)
SELECT nb.spot_id, tc.subtype, round(sum(tc.n) / any_value(total), 6) AS n FROM nb JOIN tc ON nb.o = tc.spot_id JOIN tt ON nb.spot_id = tt.spot_id GROUP BY ALL"""),
    "n13_nearest": sql(f"""{_TC}, rk AS (SELECT a.spot_id, b.spot_id AS o, sqrt({_T2}) AS d, row_number() OVER (PARTITION BY a.spot_id ORDER BY sqrt({_T2}), b.spot_id) AS k FROM sp a JOIN sp b ON a.sample_id = b.sample_id), nb0 AS MATERIALIZED (SELECT * FROM rk WHERE k <= 5),
sg AS (SELECT coalesce(median(d) FILTER (d > 0), 1.0) AS s FROM nb0), nb AS (SELECT nb0.*, exp(-d * d / (2 * s * s)) AS w FROM nb0, sg), tt AS (SELECT spot_id, sum(w) AS total FROM nb GROUP BY spot_id)
SELECT nb.spot_id, tc.subtype, round(sum(w * tc.n) / any_value(total), 6) AS n FROM nb JOIN tc ON nb.o = tc.spot_id JOIN tt ON nb.spot_id = tt.spot_id GROUP BY ALL"""),
    "n14_soft_uniform": sql(f"{_SOFT.format(r=25)} SELECT spot_id, subtype, count(*)::DOUBLE AS value FROM ne GROUP BY ALL"),
    "n14_soft_genes": sql(f"""{_SOFT.format(r=75)}, {_PROFILE}, s AS (SELECT ne.spot_id, pf.target, sum(exp(-d * d / 1250.0) * pf.n) AS s FROM ne JOIN pf ON ne.sphere_id = pf.sphere_id GROUP BY ALL)
SELECT spot_id, target, round(s / sum(s) OVER (PARTITION BY spot_id), 6) AS value FROM s"""),
}


def _custom_markers_sql() -> str:
    from punctum.catalog.subtypes import _CATEGORY, _SC, _SIMPLE, _label

    scores = _SC.replace(_CATEGORY, "CASE WHEN gene < 'M' THEN 'pre' ELSE 'post' END")
    return sql(f"{scores} SELECT subtype, {_SIMPLE} AS subtype_simple, count(*) AS n FROM {_label('sr')} GROUP BY ALL")


SQL["n07_custom_markers"] = _custom_markers_sql()
