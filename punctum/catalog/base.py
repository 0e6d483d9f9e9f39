"""Clean views of the test tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctum.functions.names import finite, with_gene
from punctum.sources import table

XYZ = ("global_x", "global_y", "global_z")


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Distinct readings with a finite position and a known gene, which ``target`` names."""
    t = table(spark, d, "transcripts").select("tx_id", "sample_id", "cell_id", "overlaps_nucleus", "target", *XYZ)
    for c in XYZ:
        t = t.where(finite(F.col(c)))
    return with_gene(t, table(spark, d, "gene_panel"), "target").drop("target").withColumnRenamed("gene_entry", "target").distinct()


def granules(spark: SparkSession, d: str) -> DataFrame:
    """Distinct spheres with a finite centre, a radius of 0 or more and a known gene; ``layer_z`` falls back to sphere_z."""
    s = table(spark, d, "sphere").drop("loaded_at")
    for c in ("sphere_x", "sphere_y", "sphere_z", "sphere_r"):
        s = s.where(finite(F.col(c)))
    s = with_gene(s.where("sphere_r >= 0"), table(spark, d, "gene_panel"), "gene").drop("gene").withColumnRenamed("gene_entry", "gene")
    return s.withColumn("layer_z", F.coalesce(F.nanvl("layer_z", F.lit(None).cast("double")), "sphere_z")).distinct()


def plain_name(name: Column) -> Column:
    """``name`` in lower case with single spaces and none around it."""
    return F.trim(F.lower(F.regexp_replace(name, r"(?U)[\s\p{Z}]+", " ")))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Distinct cells with a finite position; ``cell_type`` in lower case with single spaces."""
    c = table(spark, d, "cells").drop("loaded_at").where(finite(F.col("global_x")) & finite(F.col("global_y")))
    return c.withColumn("cell_type", plain_name(F.col("cell_type"))).distinct()


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """Distinct tiles by centre, with a number that follows their id."""
    return table(spark, d, "spots").distinct()


_FINITE = "({0} IS NOT NULL AND NOT isnan({0}) AND NOT isinf({0}))"


def finite_sql(*cols: str) -> str:
    return " AND ".join(_FINITE.format(c) for c in cols)


GENE_SQL = "lower(regexp_replace({}, '[\\s\\p{{Z}}]+', '', 'g'))"

#: The clean views as common table expressions: tx, gr, ce, sp.
VIEWS = f"""
WITH RECURSIVE tx AS MATERIALIZED (SELECT DISTINCT t.tx_id, t.sample_id, t.cell_id, t.overlaps_nucleus, g.gene AS target, t.global_x, t.global_y, t.global_z FROM transcripts t
  JOIN gene_panel g ON {GENE_SQL.format("t.target")} = {GENE_SQL.format("g.gene")} WHERE {finite_sql("t.global_x", "t.global_y", "t.global_z")}),
gr AS MATERIALIZED (SELECT DISTINCT s.sphere_id, s.sample_id, s.sphere_x, s.sphere_y, s.sphere_z, coalesce(CASE WHEN isnan(s.layer_z) THEN NULL ELSE s.layer_z END, s.sphere_z) AS layer_z, s.sphere_r,
  s.size, s.comp, s.in_soma_ratio, g.gene, s.cell_id, s.nc_ratio FROM sphere s JOIN gene_panel g ON {GENE_SQL.format("s.gene")} = {GENE_SQL.format("g.gene")}
  WHERE {finite_sql("s.sphere_x", "s.sphere_y", "s.sphere_z", "s.sphere_r")} AND s.sphere_r >= 0),
ce AS MATERIALIZED (SELECT DISTINCT cell_id, sample_id, trim(lower(regexp_replace(cell_type, '[\\s\\p{{Z}}]+', ' ', 'g'))) AS cell_type, brain_area, global_x, global_y FROM cells
  WHERE {finite_sql("global_x", "global_y")}),
sp AS MATERIALIZED (SELECT DISTINCT * FROM spots)
"""


def sql(body: str) -> str:
    """``body`` over the clean views; it may begin with further expressions, each followed by a comma where one comes next."""
    return f"{VIEWS}{', ' if not body.lstrip().upper().startswith('SELECT') else ''}{body}"
