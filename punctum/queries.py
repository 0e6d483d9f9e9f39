"""Queries of the core operators over the test tables, and SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctum.functions.names import finite, with_gene
from punctum.operators.balance import middle_rows, salted_aggregate
from punctum.operators.compaction import consolidate_points
from punctum.operators.proximity import points_in_regions, points_in_spheres
from punctum.plans.shared import staging_path, written_once
from punctum.sources import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Readings within each sphere of their sample."""
    return points_in_spheres(table(spark, d, "transcripts"), table(spark, d, "sphere"))


def tile_edges(spots: DataFrame, width: float = 50.0) -> DataFrame:
    """The four sides of each square tile, by its centre."""
    h = width / 2
    corners = [(-h, -h), (h, -h), (h, h), (-h, h)]
    sides = [F.struct(*(F.col(c) + F.lit(v) for c, v in zip(("global_x", "global_y") * 2, (*a, *b)))) for a, b in zip(corners, corners[1:] + corners[:1])]
    named = [s.cast("struct<x1:double,y1:double,x2:double,y2:double>") for s in sides]
    return spots.select("sample_id", F.col("spot_id"), F.explode(F.array(*named)).alias("side")).select("sample_id", "spot_id", "side.*")


def p1_cells_in_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Cells inside or on the border of each tile of their sample, by polygon edges."""
    cells = table(spark, d, "cells")
    return points_in_regions(cells, tile_edges(table(spark, d, "spots")), point_id="cell_id", region_id="spot_id", keys=["sample_id"], cell=50.0)


def distinct_readings(spark: SparkSession, d: str) -> DataFrame:
    """(tx_id, sample_id, cell_id, gene_entry, global_x): each reading with a finite global_x once."""
    t = table(spark, d, "transcripts").select("tx_id", "sample_id", "cell_id", "target", "global_x").where(finite(F.col("global_x")))
    return with_gene(t, table(spark, d, "gene_panel"), "target", how="left").drop("target").distinct()


def by_key(readings: DataFrame) -> DataFrame:
    """(tx_id, sample_id, key_field, key_value, global_x): each reading once for its gene and once for its cell."""
    pairs = [F.struct(F.lit(n).alias("key_field"), F.col(c).alias("key_value")) for n, c in (("target", "gene_entry"), ("cell_id", "cell_id"))]
    return readings.select("tx_id", "sample_id", "global_x", F.explode(F.array(*pairs)).alias("k")).select("tx_id", "sample_id", "k.*", "global_x").where("key_value IS NOT NULL")


def p4_consolidated(spark: SparkSession, d: str) -> DataFrame:
    """The simulated points, read back from the consolidated files."""
    path = staging_path(spark, "points")
    return consolidate_points(table(spark, d, "simulated_parquet"), table(spark, d, "scenario_def"), path)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct simulated point once."""
    return p4_consolidated(spark, d).where("scenario IS NOT NULL AND seed IS NOT NULL AND point_no IS NOT NULL").select("scenario", "seed", "point_no")


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    """Points, seeds and background points of each scenario in the consolidated files."""
    total = p4_consolidated(spark, d).where("scenario IS NOT NULL").groupBy("scenario")
    return total.agg(F.count(F.lit(1)).alias("n_points"), F.countDistinct("seed").alias("n_seeds"), F.count_if(F.col("granule_id") == -1).alias("n_background"))


KEY = ["sample_id", "key_field", "key_value"]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The middle reading by global_x of every value of target and cell_id in each sample."""
    return middle_rows(by_key(written_once(distinct_readings(spark, d), "readings")), KEY, order="global_x", row_id="tx_id")


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    """Readings and the span of global_x of every value of target and cell_id in each sample."""
    partial = {"n": F.count(F.lit(1)), "lo": F.min("global_x"), "hi": F.max("global_x")}
    merge = {"n_readings": F.sum("n"), "x_from": F.min("lo"), "x_to": F.max("hi")}
    return salted_aggregate(by_key(distinct_readings(spark, d)), KEY, F.col("tx_id"), partial, merge)


QUERIES = {"p1_found": p1_found, "p1_cells_in_tiles": p1_cells_in_tiles, "p4_found": p4_found, "p4_totals": p4_totals, "p5_found": p5_found, "p5_totals": p5_totals}

_FINITE = "{0} IS NOT NULL AND NOT isnan({0}) AND NOT isinf({0})"


def _finite(*cols: str) -> str:
    return " AND ".join(_FINITE.format(c) for c in cols)


_GENE = "lower(regexp_replace({}, '[\\s\\p{{Z}}]+', '', 'g'))"
_KEYED = f"""
WITH r AS (SELECT DISTINCT t.tx_id, t.sample_id, t.cell_id, g.gene, t.global_x FROM transcripts t LEFT JOIN gene_panel g ON {_GENE.format("t.target")} = {_GENE.format("g.gene")}
           WHERE {_finite("t.global_x")}),
k AS (SELECT tx_id, sample_id, 'target' AS key_field, gene AS key_value, global_x FROM r WHERE gene IS NOT NULL
      UNION ALL SELECT tx_id, sample_id, 'cell_id', cell_id, global_x FROM r WHERE cell_id IS NOT NULL)"""
_PATH_SCENARIO = ["scenario=([^/]+)", "([^/]+?)__s[0-9]+", "([^/]+)/seed_[0-9]+", "([^/]+)/[0-9]+/[^/]+$"]
_PATH_SEED = ["seed=([0-9]+)", "__s([0-9]+)", "/seed_([0-9]+)", "/([0-9]+)/[^/]+$"]
_PLAIN = "lower(regexp_replace({}, '[\\s_-]+', '', 'g'))"


def _from_path(patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(file_path, '{p}', 1), '')" for p in patterns) + ")"


_POINTS = f"""
WITH p AS (SELECT coalesce(nullif({_PLAIN.format("scenario")}, ''), {_PLAIN.format(_from_path(_PATH_SCENARIO))}) AS k, coalesce(seed, CAST({_from_path(_PATH_SEED)} AS BIGINT)) AS seed, point_no, granule_id FROM simulated_parquet),
q AS (SELECT s.scenario, p.seed, p.point_no, min(p.granule_id) AS granule_id FROM p JOIN scenario_def s ON p.k = {_PLAIN.format("s.scenario")} GROUP BY ALL)"""

SQL = {
    "p4_found": f"{_POINTS} SELECT scenario, seed, point_no FROM q",
    "p4_totals": f"{_POINTS} SELECT scenario, count(*) AS n_points, count(DISTINCT seed) AS n_seeds, count(*) FILTER (granule_id = -1) AS n_background FROM q GROUP BY ALL",
    "p5_found": f"""{_KEYED},
o AS (SELECT *, row_number() OVER (PARTITION BY sample_id, key_field, key_value ORDER BY global_x, tx_id) AS i, count(*) OVER (PARTITION BY sample_id, key_field, key_value) AS n FROM k)
SELECT sample_id, key_field, key_value, tx_id FROM o WHERE i = (n + 1) // 2""",
    "p5_totals": f"""{_KEYED}
SELECT sample_id, key_field, key_value, count(*) AS n_readings, min(global_x) AS x_from, max(global_x) AS x_to FROM k GROUP BY ALL""",
    "p1_found": f"""
WITH p AS (SELECT DISTINCT tx_id, sample_id, global_x x, global_y y, global_z z, floor(global_x / 64) gx, floor(global_y / 64) gy FROM transcripts
           WHERE {_finite("global_x", "global_y", "global_z")}),
s0 AS (SELECT DISTINCT sphere_id, sample_id, sphere_x x, sphere_y y, sphere_z z, sphere_r r FROM sphere
       WHERE {_finite("sphere_x", "sphere_y", "sphere_z", "sphere_r")} AND sphere_r >= 0),
s1 AS (SELECT *, unnest(generate_series(CAST(floor((x - r) / 64) AS BIGINT), CAST(floor((x + r) / 64) AS BIGINT))) gx FROM s0),
s AS (SELECT *, unnest(generate_series(CAST(floor((y - r) / 64) AS BIGINT), CAST(floor((y + r) / 64) AS BIGINT))) gy FROM s1)
SELECT DISTINCT s.sphere_id, p.tx_id FROM s JOIN p ON s.sample_id = p.sample_id AND s.gx = p.gx AND s.gy = p.gy
WHERE (s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y) + (s.z - p.z) * (s.z - p.z) <= s.r * s.r""",
    "p1_cells_in_tiles": f"""
SELECT DISTINCT t.spot_id, c.cell_id FROM cells c JOIN spots t ON c.sample_id = t.sample_id
WHERE abs(c.global_x - t.global_x) <= 25 AND abs(c.global_y - t.global_y) <= 25 AND {_finite("c.global_x", "c.global_y")}""",
}
