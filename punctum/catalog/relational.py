"""Projections, predicates, aggregations, windows and set operations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from punctum.catalog.base import cells, granules, readings, sql, tiles
from punctum.functions import columns as C
from punctum.functions import geometry as G
from punctum.operators.compaction import identified_points
from punctum.plans.shared import staging_path
from punctum.sources import files, table

GNL = ["Flout12c", "Broupc", "Dround1", "Brost4", "Mack"]
_IN = "('Flout12c', 'Broupc', 'Dround1', 'Brost4', 'Mack')"
r6 = lambda c: F.round(c, 6)


def a02_pruned_scan(spark, d):
    return table(spark, d, "transcripts").select("tx_id", "target")


def a03_csv(spark, d):
    panel = table(spark, d, "gene_panel")
    return files.read_csv(spark, files.write_csv(panel, staging_path(spark, "csv")), panel.schema)


def a04_matrix_store(spark, d):
    """Annotated matrix as three tables, written and read back."""
    r = readings(spark, d)
    expr = r.where("cell_id IS NOT NULL").groupBy("cell_id", F.col("target").alias("gene")).agg(F.count(F.lit(1)).alias("n"))
    path = files.write_matrix(staging_path(spark, "matrix"), expr=expr, obs=cells(spark, d), var=table(spark, d, "gene_panel"))
    m = files.read_matrix(spark, path)
    return m["expr"].join(m["obs"].select("cell_id").distinct(), "cell_id").join(m["var"].select("gene"), "gene").groupBy("gene").agg(F.sum("n").alias("n"), F.countDistinct("cell_id").alias("n_cells"))


def a08_atomic_write(spark, d):
    g = granules(spark, d).select("sphere_id", "gene", "sphere_r")
    return spark.read.parquet(files.write_parquet_atomic(g, staging_path(spark, "atomic")))


def a09_discovered_files(spark, d):
    points = identified_points(table(spark, d, "simulated_parquet"), table(spark, d, "scenario_def"))
    return points.where("scenario IS NOT NULL AND seed IS NOT NULL").groupBy("scenario", "seed").agg(F.countDistinct("file_path").alias("n_files"))


def a11_simulated_data(spark, d):
    return spark.read.parquet(files.write_simulated(table(spark, d, "simulated_parquet"), staging_path(spark, "sim"), is_3d=True, extra=["granule_id"]))


def a12_tile_shards(spark, d):
    path = files.write_shards(files.tile_of(readings(spark, d), 100.0, keys=["sample_id"]), staging_path(spark, "shards"), ["sample_id", "tile_row", "tile_col"])
    return spark.read.parquet(path).groupBy("sample_id", "tile_row", "tile_col").agg(F.count(F.lit(1)).alias("n_tx"))


def b01_members(spark, d):
    return readings(spark, d).where(F.col("target").isin(*GNL)).groupBy("sample_id", "target").agg(F.count(F.lit(1)).alias("n"))


def b02_own_or_other(spark, d):
    own = F.when(F.col("target") == GNL[0], "own").otherwise("other").alias("side")
    return readings(spark, d).groupBy("sample_id", own).agg(F.count(F.lit(1)).alias("n"))


def b03_size_filter(spark, d):
    g = granules(spark, d)
    strict, wide = (C.kept(F.col("sphere_r"), F.col("in_soma_ratio"), 1.5, 0.1, s) for s in (True, False))
    return g.select("sphere_id", strict.alias("strict"), wide.alias("inclusive"))


def b04_merged_label(spark, d):
    return readings(spark, d).select("tx_id", C.merged_label(F.col("target"), GNL).alias("target"), F.col("target").alias("target_original"))


def b05_post_filter(spark, d):
    return granules(spark, d).where(C.passes(F.col("in_soma_ratio"), F.coalesce("nc_ratio", F.lit(0.0)), 0.1, 0.02)).select("sphere_id")


def b06_pixels(spark, d):
    x, y = (G.pixel(F.col(c), 0.108, s) for c, s in (("global_x", 3), ("global_y", -2)))
    return readings(spark, d).select("tx_id", y.alias("row"), x.alias("col"))


def _mask(spark, d) -> DataFrame:
    """A raster mask for each plane: the pixels of 2 µm around the readings in nuclei."""
    r = readings(spark, d).where("overlaps_nucleus = 1")
    return r.select("sample_id", F.col("global_z").alias("z"), G.pixel(F.col("global_y"), 2.0).alias("row"), G.pixel(F.col("global_x"), 2.0).alias("col")).distinct()


def b07_raster_lookup(spark, d):
    at = readings(spark, d).select("tx_id", "sample_id", F.col("global_z").alias("z"), G.pixel(F.col("global_y"), 2.0).alias("row"), G.pixel(F.col("global_x"), 2.0).alias("col"))
    hit = at.join(_mask(spark, d).withColumn("inside", F.lit(1)), ["sample_id", "z", "row", "col"], "left")
    return hit.select("tx_id", F.coalesce("inside", F.lit(0)).alias("inside"))


def b08_turned(spark, d):
    x, y = G.rotated(F.col("global_x"), F.col("global_y"), math.pi / 6)
    return readings(spark, d).select("tx_id", r6(G.flipped(x, 500.0) + 12000.0).alias("x"), r6(y + 7200.0).alias("y"), (F.col("global_z") * 1.5).alias("z"))


def b09_half_plane(spark, d):
    side = [G.half_plane(F.col("global_x"), 100.0, s).cast("int") for s in ("smaller", "larger")]
    return readings(spark, d).groupBy("sample_id").agg(F.sum(side[0]).alias("smaller"), F.sum(side[1]).alias("larger"))


def b11_prefixes(spark, d):
    t = table(spark, d, "transcripts")
    return t.where(~F.col("target").startswith("Void")).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


AREAS = {"outer sheet": "cortex", "inner sheet": "cortex", "hilus band": "hippocampus"}


def b12_value_map(spark, d):
    return tiles(spark, d).select("spot_id", C.mapped(F.col("brain_area"), AREAS, F.lit("Others")).alias("area"))


def b13_rules(spark, d):
    x, y, a = F.col("global_x"), F.col("global_y"), F.col("brain_area")
    rules = [(a.isNull() & (y < 0.5 * x + 20.0), "below"), (a.isNull(), "Others"), ((a == "outer sheet") & (x > 400.0), "far sheet")]
    return tiles(spark, d).select("spot_id", C.ruled(rules, a).alias("area"))


def b14_simplified(spark, d):
    both = F.when(F.col("region_markers") != F.lit(" "), F.concat_ws(" & ", "region_markers", F.nullif("cell_type_markers", F.lit(" ")))).otherwise(F.lit("none"))
    return table(spark, d, "gene_panel").select("gene", C.simplified(both).alias("label"))


def b15_not_null(spark, d):
    return tiles(spark, d).where("region_labels IS NOT NULL AND brain_area IS NOT NULL").select("spot_id")


def b16_local(spark, d):
    r = readings(spark, d)
    least = r.groupBy("sample_id").agg(F.min("global_x").alias("x0"), F.min("global_y").alias("y0"))
    at = r.join(least, "sample_id").withColumns({"local_x": F.col("global_x") - F.col("x0"), "local_y": F.col("global_y") - F.col("y0")})
    return at.select("tx_id", "local_x", "local_y", (F.col("local_x") + F.col("x0")).alias("global_x"))


def b17_seed_range(spark, d):
    p = identified_points(table(spark, d, "simulated_parquet"), table(spark, d, "scenario_def"))
    return p.where(F.col("seed").between(1, 10)).groupBy("scenario", "seed").agg(F.countDistinct("point_no").alias("n_points"))


def g01_shares(spark, d):
    n = granules(spark, d).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


def g02_distinct(spark, d):
    return readings(spark, d).groupBy("sample_id").agg(F.countDistinct("target").alias("n_genes"), F.countDistinct("cell_id").alias("n_cells"))


def g03_in_soma(spark, d):
    return readings(spark, d).groupBy("target").agg(r6(F.sum("overlaps_nucleus") / F.count(F.lit(1))).alias("in_soma_ratio"))


def g04_histogram(spark, d):
    return readings(spark, d).groupBy("sample_id", F.floor(F.col("global_x") / 20).alias("ix"), F.floor(F.col("global_y") / 20).alias("iy")).agg(F.count(F.lit(1)).alias("n"))


def g12_spread(spark, d):
    g = granules(spark, d).groupBy("gene").agg(F.stddev_samp("sphere_r").alias("sd"), F.count(F.lit(1)).alias("n"))
    return g.where("n > 1").select("gene", r6("sd").alias("sd"), "n", r6(F.col("sd") / F.sqrt("n")).alias("sem"))


def g13_quantiles(spark, d):
    q = [F.percentile("sphere_r", F.lit(p)).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    return granules(spark, d).groupBy("gene").agg(r6(F.avg("sphere_r")).alias("mean"), *(r6(c).alias(n) for c, n in zip(q, ("q25", "q50", "q75"))))


def g14_summary(spark, d):
    return granules(spark, d).groupBy("sample_id").agg(F.round(F.avg("in_soma_ratio"), 9).alias("mean_in_soma"), F.median("size").alias("median_size"), F.round(F.avg(F.nanvl("nc_ratio", F.lit(None))), 9).alias("mean_nc"))


def g15_group_means(spark, d):
    per = readings(spark, d).where("cell_id IS NOT NULL").groupBy("cell_id", "target").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("target").agg(r6(F.avg("n")).alias("mean_n"), F.count(F.lit(1)).alias("n_cells"))


def g16_seed_means(spark, d):
    p = identified_points(table(spark, d, "simulated_parquet"), table(spark, d, "scenario_def")).where("scenario IS NOT NULL AND seed IS NOT NULL")
    per = p.groupBy("scenario", "seed").agg(F.countDistinct("point_no").alias("n"))
    return per.groupBy("scenario").agg(r6(F.avg("n")).alias("mean_points"), F.count(F.lit(1)).alias("n_seeds"))


def g17_gyration(spark, d):
    p = identified_points(table(spark, d, "simulated_parquet"), table(spark, d, "scenario_def")).where("granule_id >= 0 AND scenario IS NOT NULL AND seed IS NOT NULL")
    p = p.groupBy("scenario", "seed", "point_no").agg(*(F.max(c).alias(c) for c in ("granule_id", "global_x", "global_y", "global_z")))
    spread = F.var_pop("global_x") + F.var_pop("global_y") + F.var_pop("global_z")
    return p.groupBy("scenario", "seed", "granule_id").agg(r6(F.sqrt(spread)).alias("radius"), F.count(F.lit(1)).alias("n"))


def w01_cumulative(spark, d):
    n = granules(spark, d).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "gene").rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn("cum", F.sum("n").over(w))


def w02_threshold_index(spark, d):
    """Place, from 0, of the first gene at which the sum reaches 99% (one row for each gene of the panel at most)."""
    c = w01_cumulative(spark, d)
    one = Window.partitionBy(F.lit(1))
    c = c.withColumns({"place": F.row_number().over(one.orderBy(F.desc("n"), "gene")) - 1, "total": F.sum("n").over(one)})
    return c.where("cum >= 0.99 * total").agg(F.min("place").cast("long").alias("place"))


def w03_closest(spark, d):
    planes = F.array(*map(F.lit, [0.0, 1.5, 3.0, 4.5, 6.0, 7.5, 9.0]))
    return granules(spark, d).select("sphere_id", C.first_closest(planes, F.col("sphere_z")).alias("plane"))


def w04_top_until(spark, d):
    n = readings(spark, d).where("cell_id IS NOT NULL AND cell_id <> '0'").groupBy("cell_id", F.col("target").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    n = n.withColumn("value", C.proportion(F.col("value"), ["cell_id"]))
    top = n.groupBy("cell_id").agg(F.collect_list(F.struct("name", "value")).alias("v"))
    return top.select("cell_id", F.array_join(C.top_until(F.col("v"), 0.5), ",").alias("genes"))


def w05_top_k(spark, d):
    n = readings(spark, d).groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "target").limit(20)


def w07_argmax(spark, d):
    n = readings(spark, d).where("cell_id IS NOT NULL").groupBy("cell_id").agg(*(F.count_if(F.col("target") == g).alias(g) for g in GNL))
    return n.select("cell_id", C.first_argmax(F.array(*GNL)).cast("int").alias("at"))


def w08_high_flag(spark, d):
    base = granules(spark, d).where("sample_id = 'S0001'").groupBy("gene").agg(F.percentile("sphere_r", F.lit(0.9)).alias("q"))
    return granules(spark, d).where("sample_id <> 'S0001'").join(base, "gene").select("sphere_id", (F.col("sphere_r") > F.col("q")).cast("int").alias("high"))


def w09_least_gap(spark, d):
    z = readings(spark, d).select("sample_id", "global_z").distinct()
    gap = F.col("global_z") - F.lag("global_z").over(Window.partitionBy("sample_id").orderBy("global_z"))
    return z.withColumn("gap", gap).groupBy("sample_id").agg(F.min("gap").alias("least_gap"))


def w11_permuted(spark, d):
    """Cells in an order that a seed fixes: by a hash of seed and id."""
    c = cells(spark, d).where("cell_id IS NOT NULL").select("cell_id").distinct()
    return c.withColumn("key", F.xxhash64(F.lit(7), F.col("cell_id"))).orderBy("key", "cell_id").select("cell_id")


def w12_sorted(spark, d):
    return readings(spark, d).groupBy("sample_id", "target").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("target"))


def w13_distinct_places(spark, d):
    return readings(spark, d).dropDuplicates(["sample_id", "global_x", "global_y", "global_z"]).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_places"))


def s01_appended(spark, d):
    a = granules(spark, d).select("sphere_id", "gene", "sphere_r")
    b = readings(spark, d).select(F.col("tx_id").alias("sphere_id"), F.col("target").alias("gene"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.count("sphere_r").alias("n_spheres"))


def s02_batches(spark, d):
    r = readings(spark, d)
    halves = [r.where(F.col("sample_id") == s).withColumn("batch", F.lit(b)) for s, b in (("S0001", "wt"), ("S0002", "ad"))]
    shared = halves[0].select("target").intersect(halves[1].select("target"))
    return halves[0].unionByName(halves[1]).join(shared, "target", "left_semi").groupBy("batch", "target").agg(F.count(F.lit(1)).alias("n"))


def s03_gene_sets(spark, d):
    a, b = table(spark, d, "negative_controls").select("gene"), granules(spark, d).select("gene").distinct()
    both = a.intersect(b).select("gene", F.lit("both").alias("kind"))
    return both.unionByName(a.union(b).distinct().select("gene", F.lit("any").alias("kind")))


def s04_ordered_shared(spark, d):
    """Panel genes, in panel order by name, that both of two samples have."""
    r = readings(spark, d)
    have = [r.where(F.col("sample_id") == s).select(F.col("target").alias("gene")).distinct() for s in ("S0003", "S0004")]
    panel = table(spark, d, "negative_controls").select("gene").distinct()
    return panel.join(have[0], "gene", "left_semi").join(have[1], "gene", "left_semi").orderBy("gene")


def s05_missing_ids(spark, d):
    seen = readings(spark, d).select("cell_id").distinct()
    known = cells(spark, d).select("cell_id").distinct()
    return seen.where("cell_id IS NOT NULL").join(known, "cell_id", "left_anti").groupBy().agg(F.count(F.lit(1)).alias("n_missing")).crossJoin(seen.join(known, "cell_id", "left_semi").groupBy().agg(F.count(F.lit(1)).alias("n_known")))


def s06_first_of_each(spark, d):
    first = granules(spark, d).groupBy("gene").agg(F.min("sphere_id").alias("first_id"))
    return first


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "abgws" and k[1:3].isdigit()}

_SIM = """(SELECT * FROM (SELECT p.*, coalesce(nullif(lower(regexp_replace(p.scenario, '[\\s_-]+', '', 'g')), ''),
 lower(regexp_replace(coalesce(nullif(regexp_extract(file_path, 'scenario=([^/]+)', 1), ''), nullif(regexp_extract(file_path, '([^/]+?)__s[0-9]+', 1), ''), nullif(regexp_extract(file_path, '([^/]+)/seed_[0-9]+', 1), ''), nullif(regexp_extract(file_path, '([^/]+)/[0-9]+/[^/]+$', 1), '')), '[\\s_-]+', '', 'g'))) AS k,
 coalesce(p.seed, CAST(coalesce(nullif(regexp_extract(file_path, 'seed=([0-9]+)', 1), ''), nullif(regexp_extract(file_path, '__s([0-9]+)', 1), ''), nullif(regexp_extract(file_path, '/seed_([0-9]+)', 1), ''), nullif(regexp_extract(file_path, '/([0-9]+)/[^/]+$', 1), '')) AS BIGINT)) AS sd FROM simulated_parquet p) q
 JOIN (SELECT scenario AS sc, lower(regexp_replace(scenario, '[\\s_-]+', '', 'g')) AS kk FROM scenario_def) s ON q.k = s.kk)"""

SQL = {
    "a02_pruned_scan": "SELECT tx_id, target FROM transcripts",
    "a03_csv": "SELECT * FROM gene_panel",
    "a04_matrix_store": sql("SELECT gene, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_cells FROM (SELECT cell_id, target AS gene, count(*) AS n FROM tx WHERE cell_id IN (SELECT cell_id FROM ce) GROUP BY ALL) GROUP BY gene"),
    "a08_atomic_write": sql("SELECT sphere_id, gene, sphere_r FROM gr"),
    "a09_discovered_files": f"SELECT sc AS scenario, sd AS seed, count(DISTINCT file_path) AS n_files FROM {_SIM} WHERE sd IS NOT NULL GROUP BY ALL",
    "a11_simulated_data": "SELECT global_x AS x, global_y AS y, global_z AS z, gene, granule_id FROM simulated_parquet",
    "a12_tile_shards": sql("""b AS (SELECT sample_id, min(global_x) x0, min(global_y) y0, max(global_x) x1, max(global_y) y1 FROM tx GROUP BY sample_id)
SELECT tx.sample_id, CAST(least(floor((global_y - y0) / 100), greatest(ceil((y1 - y0) / 100), 1) - 1) AS INT) AS tile_row, CAST(least(floor((global_x - x0) / 100), greatest(ceil((x1 - x0) / 100), 1) - 1) AS INT) AS tile_col, count(*) AS n_tx FROM tx JOIN b ON tx.sample_id = b.sample_id GROUP BY ALL"""),
    "b01_members": sql(f"SELECT sample_id, target, count(*) AS n FROM tx WHERE target IN {_IN} GROUP BY ALL"),
    "b02_own_or_other": sql("SELECT sample_id, CASE WHEN target = 'Flout12c' THEN 'own' ELSE 'other' END AS side, count(*) AS n FROM tx GROUP BY ALL"),
    "b03_size_filter": sql("SELECT sphere_id, sphere_r < 1.5 AND in_soma_ratio < 0.1 AS strict, sphere_r <= 1.5 AND in_soma_ratio <= 0.1 AS inclusive FROM gr"),
    "b04_merged_label": sql(f"SELECT tx_id, CASE WHEN target IN {_IN} THEN 'merged' ELSE target END AS target, target AS target_original FROM tx"),
    "b05_post_filter": sql("SELECT sphere_id FROM gr WHERE in_soma_ratio < 0.1 AND (coalesce(nc_ratio, 0) = 0 OR coalesce(nc_ratio, 0) < 0.02)"),
    "b06_pixels": sql("SELECT tx_id, CAST(trunc(global_y / 0.108) AS INT) - 2 AS row, CAST(trunc(global_x / 0.108) AS INT) + 3 AS col FROM tx"),
    "b07_raster_lookup": sql("""p AS (SELECT tx_id, sample_id, global_z z, CAST(trunc(global_y / 2) AS INT) r, CAST(trunc(global_x / 2) AS INT) c, overlaps_nucleus o FROM tx), m AS (SELECT DISTINCT sample_id, z, r, c FROM p WHERE o = 1)
SELECT p.tx_id, CASE WHEN m.z IS NULL THEN 0 ELSE 1 END AS inside FROM p LEFT JOIN m ON p.sample_id = m.sample_id AND p.z = m.z AND p.r = m.r AND p.c = m.c"""),
    "b08_turned": sql("SELECT tx_id, round(500.0 - (global_x * cos(pi() / 6) + global_y * sin(pi() / 6)) + 12000.0, 6) AS x, round(global_y * cos(pi() / 6) - global_x * sin(pi() / 6) + 7200.0, 6) AS y, global_z * 1.5 AS z FROM tx"),
    "b09_half_plane": sql("SELECT sample_id, count(*) FILTER (global_x <= 100) AS smaller, count(*) FILTER (global_x >= 100) AS larger FROM tx GROUP BY sample_id"),
    "b11_prefixes": "SELECT sample_id, count(*) AS n FROM transcripts WHERE NOT starts_with(target, 'Void') GROUP BY sample_id",
    "b12_value_map": sql("SELECT spot_id, CASE WHEN brain_area IN ('outer sheet', 'inner sheet') THEN 'cortex' WHEN brain_area = 'hilus band' THEN 'hippocampus' ELSE 'Others' END AS area FROM sp"),
    "b13_rules": sql("SELECT spot_id, CASE WHEN brain_area IS NULL AND global_y < 0.5 * global_x + 20.0 THEN 'below' WHEN brain_area IS NULL THEN 'Others' WHEN brain_area = 'outer sheet' AND global_x > 400.0 THEN 'far sheet' ELSE brain_area END AS area FROM sp"),
    "b14_simplified": "SELECT gene, CASE WHEN region_markers <> ' ' THEN CASE WHEN nullif(cell_type_markers, ' ') IS NOT NULL THEN 'mixed' ELSE region_markers END ELSE 'none' END AS label FROM gene_panel",
    "b15_not_null": sql("SELECT spot_id FROM sp WHERE region_labels IS NOT NULL AND brain_area IS NOT NULL"),
    "b16_local": sql("SELECT tx_id, global_x - min(global_x) OVER w AS local_x, global_y - min(global_y) OVER w AS local_y, global_x FROM tx WINDOW w AS (PARTITION BY sample_id)"),
    "b17_seed_range": f"SELECT sc AS scenario, sd AS seed, count(DISTINCT point_no) AS n_points FROM {_SIM} WHERE sd BETWEEN 1 AND 10 GROUP BY ALL",
    "g01_shares": sql("SELECT gene, count(*) AS n, round(count(*) / (SELECT count(*) FROM gr), 6) AS share FROM gr GROUP BY gene"),
    "g02_distinct": sql("SELECT sample_id, count(DISTINCT target) AS n_genes, count(DISTINCT cell_id) AS n_cells FROM tx GROUP BY sample_id"),
    "g03_in_soma": sql("SELECT target, round(sum(overlaps_nucleus) / count(*), 6) AS in_soma_ratio FROM tx GROUP BY target"),
    "g04_histogram": sql("SELECT sample_id, CAST(floor(global_x / 20) AS BIGINT) AS ix, CAST(floor(global_y / 20) AS BIGINT) AS iy, count(*) AS n FROM tx GROUP BY ALL"),
    "g12_spread": sql("SELECT gene, round(stddev_samp(sphere_r), 6) AS sd, count(*) AS n, round(stddev_samp(sphere_r) / sqrt(count(*)), 6) AS sem FROM gr GROUP BY gene HAVING count(*) > 1"),
    "g13_quantiles": sql("SELECT gene, round(avg(sphere_r), 6) AS mean, round(quantile_cont(sphere_r, 0.25), 6) AS q25, round(quantile_cont(sphere_r, 0.5), 6) AS q50, round(quantile_cont(sphere_r, 0.75), 6) AS q75 FROM gr GROUP BY gene"),
    "g14_summary": sql("SELECT sample_id, round(avg(in_soma_ratio), 9) AS mean_in_soma, median(size) AS median_size, round(avg(CASE WHEN isnan(nc_ratio) THEN NULL ELSE nc_ratio END), 9) AS mean_nc FROM gr GROUP BY sample_id"),
    "g15_group_means": sql("SELECT target, round(avg(n), 6) AS mean_n, count(*) AS n_cells FROM (SELECT cell_id, target, count(*) AS n FROM tx WHERE cell_id IS NOT NULL GROUP BY ALL) GROUP BY target"),
    "g16_seed_means": f"SELECT scenario, round(avg(n), 6) AS mean_points, count(*) AS n_seeds FROM (SELECT sc AS scenario, sd, count(DISTINCT point_no) AS n FROM {_SIM} WHERE sd IS NOT NULL GROUP BY ALL) GROUP BY scenario",
    "g17_gyration": f"""SELECT scenario, seed, granule_id, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) AS radius, count(*) AS n FROM
(SELECT sc AS scenario, sd AS seed, point_no, max(granule_id) AS granule_id, max(global_x) x, max(global_y) y, max(global_z) z FROM {_SIM} WHERE sd IS NOT NULL AND granule_id >= 0 GROUP BY ALL) GROUP BY scenario, seed, granule_id""",
    "w01_cumulative": sql("SELECT gene, n, CAST(sum(n) OVER (ORDER BY n DESC, gene) AS BIGINT) AS cum FROM (SELECT gene, count(*) AS n FROM gr GROUP BY gene)"),
    "w02_threshold_index": sql("""c AS (SELECT gene, n, sum(n) OVER (ORDER BY n DESC, gene) AS cum, row_number() OVER (ORDER BY n DESC, gene) - 1 AS place, sum(n) OVER () AS total FROM (SELECT gene, count(*) AS n FROM gr GROUP BY gene))
SELECT min(place) AS place FROM c WHERE cum >= 0.99 * total"""),
    "w03_closest": sql("""p AS (SELECT unnest([0.0, 1.5, 3.0, 4.5, 6.0, 7.5, 9.0]) AS v, unnest([0, 1, 2, 3, 4, 5, 6]) AS i), o AS (SELECT sphere_id, i, row_number() OVER (PARTITION BY sphere_id ORDER BY abs(v - sphere_z), i) AS k FROM gr, p)
SELECT sphere_id, i AS plane FROM o WHERE k = 1"""),
    "w04_top_until": sql("""n AS (SELECT cell_id, target, count(*) AS n FROM tx WHERE cell_id IS NOT NULL AND cell_id <> '0' GROUP BY ALL), q AS (SELECT *, n / sum(n) OVER (PARTITION BY cell_id) AS v FROM n),
c AS (SELECT *, coalesce(sum(v) OVER (PARTITION BY cell_id ORDER BY v DESC, target ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT cell_id, string_agg(target, ',' ORDER BY v DESC, target) AS genes FROM c WHERE before <= 0.5 GROUP BY cell_id"""),
    "w05_top_k": sql("SELECT target, count(*) AS n FROM tx GROUP BY target ORDER BY n DESC, target LIMIT 20"),
    "w07_argmax": sql("""n AS (SELECT cell_id, count(*) FILTER (target = 'Flout12c') a, count(*) FILTER (target = 'Broupc') b, count(*) FILTER (target = 'Dround1') c, count(*) FILTER (target = 'Brost4') d, count(*) FILTER (target = 'Mack') e FROM tx WHERE cell_id IS NOT NULL GROUP BY cell_id)
SELECT cell_id, CASE greatest(a, b, c, d, e) WHEN a THEN 0 WHEN b THEN 1 WHEN c THEN 2 WHEN d THEN 3 ELSE 4 END AS at FROM n"""),
    "w08_high_flag": sql("""q AS (SELECT gene, quantile_cont(sphere_r, 0.9) AS q FROM gr WHERE sample_id = 'S0001' GROUP BY gene)
SELECT sphere_id, CASE WHEN sphere_r > q THEN 1 ELSE 0 END AS high FROM gr JOIN q ON gr.gene = q.gene WHERE sample_id <> 'S0001'"""),
    "w09_least_gap": sql("SELECT sample_id, min(gap) AS least_gap FROM (SELECT sample_id, z - lag(z) OVER (PARTITION BY sample_id ORDER BY z) AS gap FROM (SELECT DISTINCT sample_id, global_z AS z FROM tx)) GROUP BY sample_id"),
    "w11_permuted": sql("SELECT DISTINCT cell_id FROM ce WHERE cell_id IS NOT NULL"),
    "s04_ordered_shared": sql("SELECT DISTINCT gene FROM negative_controls WHERE gene IN (SELECT target FROM tx WHERE sample_id = 'S0003') AND gene IN (SELECT target FROM tx WHERE sample_id = 'S0004')"),
    "w12_sorted": sql("SELECT sample_id, target, count(*) AS n FROM tx GROUP BY ALL ORDER BY n DESC, target DESC"),
    "w13_distinct_places": sql("SELECT sample_id, count(*) AS n_places FROM (SELECT DISTINCT sample_id, global_x, global_y, global_z FROM tx) GROUP BY sample_id"),
    "s01_appended": sql("SELECT gene, count(*) AS n, count(r) AS n_spheres FROM (SELECT gene, sphere_r AS r FROM gr UNION ALL SELECT target, NULL FROM tx) GROUP BY gene"),
    "s02_batches": sql("""b AS (SELECT CASE sample_id WHEN 'S0001' THEN 'wt' ELSE 'ad' END AS batch, target FROM tx WHERE sample_id IN ('S0001', 'S0002'))
SELECT batch, target, count(*) AS n FROM b WHERE target IN (SELECT target FROM b GROUP BY target HAVING count(DISTINCT batch) = 2) GROUP BY ALL"""),
    "s03_gene_sets": sql("SELECT gene, 'both' AS kind FROM (SELECT gene FROM negative_controls INTERSECT SELECT gene FROM gr) UNION ALL SELECT gene, 'any' FROM (SELECT gene FROM negative_controls UNION SELECT gene FROM gr)"),
    "s05_missing_ids": sql("SELECT count(DISTINCT cell_id) FILTER (cell_id NOT IN (SELECT cell_id FROM ce)) AS n_missing, count(DISTINCT cell_id) FILTER (cell_id IN (SELECT cell_id FROM ce)) AS n_known FROM tx"),
    "s06_first_of_each": sql("SELECT gene, min(sphere_id) AS first_id FROM gr GROUP BY gene"),
}
