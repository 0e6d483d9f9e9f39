"""Queries of this subpackage over the test tables, and SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctum.functions.names import with_gene
from punctum.llm.clusters import similarity_clusters, typical_members
from punctum.llm.encoding import encode_corpus
from punctum.llm.groups import group_matches, matched_spheres
from punctum.llm.languages import main_language, named_language, passages, with_segments
from punctum.llm.leaks import leaked_items
from punctum.sources import table

#: Distance in the plane at which two spheres match.
MATCH_DISTANCE = 1.25


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every sphere that matches another, with its group."""
    spheres = with_gene(table(spark, d, "sphere"), table(spark, d, "gene_panel"), "gene")
    return group_matches(*matched_spheres(spheres, distance=MATCH_DISTANCE))


def p2_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Groups by their number of spheres."""
    sizes = p2_found(spark, d).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_spheres"))
    return sizes.groupBy("n_spheres").agg(F.count(F.lit(1)).alias("n_groups"))


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    readings = with_gene(table(spark, d, "transcripts"), table(spark, d, "gene_panel"), "target")
    return similarity_clusters(readings, row_id="tx_id", keys=["sample_id"], block="gene_entry", xyz=["global_x", "global_y", "global_z"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reading of every aggregate."""
    return _clusters(spark, d).select("cluster_id", "tx_id")


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical readings of every aggregate."""
    return typical_members(_clusters(spark, d), row_id="tx_id")


def p3_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Readings and central readings of every aggregate, without its typical ones."""
    return p3_clusters(spark, d).select("cluster_id", "size", "n_central")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a stretch of an evaluation passage."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).where("held").select("doc_id", "item_id")


def p7_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an evaluation passage, or one with its slots filled otherwise."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _segmented(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", F.col("lang").alias("label"), "text")
    return with_segments(documents, table(spark, d, "lang_samples"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of passages of a document that its label doesn't name."""
    found = passages(_segmented(spark, d))
    named = table(spark, d, "documents").select("doc_id", named_language(F.col("lang")).alias("lang")).where("lang IS NOT NULL")
    return found.join(named, ["doc_id", "lang"], "left_anti")


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    """The main language of every document, with a confidence value."""
    return main_language(_segmented(spark, d))


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every document, with its language and a confidence value."""
    return _segmented(spark, d).select("doc_id", F.posexplode("segments").alias("segment_no", "s")).select("doc_id", "segment_no", F.col("s.start").alias("from_char"), F.col("s.end").alias("to_char"), "s.lang", "s.confidence")


QUERIES = {"p2_found": p2_found, "p2_sizes": p2_sizes, "p3_found": p3_found, "p3_clusters": p3_clusters, "p3_sizes": p3_sizes, "p6_ids": p6_ids, "p7_found": p7_found, "p7_kinds": p7_kinds, "p8_found": p8_found, "p8_documents": p8_documents, "p8_segments": p8_segments}

_GENE = "lower(regexp_replace({}, '[\\s\\p{{Z}}]+', '', 'g'))"
_MATCHES = f"""
WITH RECURSIVE s AS MATERIALIZED (SELECT DISTINCT sphere_id, sample_id, p.gene, sphere_x x, sphere_y y, floor(sphere_x / 1.25) ix, floor(sphere_y / 1.25) iy FROM sphere
      JOIN gene_panel p ON {_GENE.format("sphere.gene")} = {_GENE.format("p.gene")} WHERE NOT isnan(sphere_x) AND NOT isnan(sphere_y) AND NOT isinf(sphere_x) AND NOT isinf(sphere_y)),
o AS (SELECT unnest([-1, 0, 1]) AS i), oo AS (SELECT a.i, b.i AS j FROM o a, o b),
k AS (SELECT s.*, ix + i AS kx, iy + j AS ky FROM s, oo),
m AS MATERIALIZED (SELECT a.sphere_id u, b.sphere_id v FROM k a JOIN s b ON a.sample_id = b.sample_id AND a.kx = b.ix AND a.ky = b.iy
      WHERE a.gene <> b.gene AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.5625),
r AS (SELECT u AS root, u AS node FROM (SELECT DISTINCT u FROM m) UNION SELECT r.root, m.v FROM r JOIN m ON r.node = m.u),
g AS (SELECT min(root) AS group_id, node AS sphere_id FROM r GROUP BY node)
"""
_NEAR = f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT DISTINCT tx_id, sample_id, p.gene, global_x x, global_y y, global_z z, floor(global_x / 1.5) ix, floor(global_y / 1.5) iy FROM transcripts
      JOIN gene_panel p ON {_GENE.format("transcripts.target")} = {_GENE.format("p.gene")}
      WHERE NOT isnan(global_x) AND NOT isnan(global_y) AND NOT isnan(global_z) AND NOT isinf(global_x) AND NOT isinf(global_y) AND NOT isinf(global_z)),
o AS (SELECT unnest([-1, 0, 1]) AS i), oo AS (SELECT a.i, b.i AS j FROM o a, o b),
k AS (SELECT t.*, ix + i AS kx, iy + j AS ky FROM t, oo),
m AS MATERIALIZED (SELECT a.tx_id u, b.tx_id v FROM k a JOIN t b ON a.sample_id = b.sample_id AND a.gene = b.gene AND a.kx = b.ix AND a.ky = b.iy
      WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 2.25),
c AS MATERIALIZED (SELECT u FROM m GROUP BY u HAVING count(*) >= 3),
e AS MATERIALIZED (SELECT u, v FROM m WHERE u IN (FROM c) AND v IN (FROM c)),
r AS (SELECT u AS root, u AS node FROM c UNION SELECT r.root, e.v FROM r JOIN e ON r.node = e.u),
g AS MATERIALIZED (SELECT min(root) AS cluster_id, node FROM r GROUP BY node),
f AS (SELECT cluster_id, node AS tx_id FROM g UNION ALL SELECT min(cluster_id), m.u FROM m JOIN g ON m.v = g.node WHERE m.u NOT IN (FROM c) GROUP BY m.u)
"""

SQL = {
    "p3_found": f"{_NEAR} SELECT cluster_id, tx_id FROM f",
    "p3_sizes": f"{_NEAR} SELECT cluster_id, count(*) AS size, count(*) FILTER (tx_id IN (FROM c)) AS n_central FROM f GROUP BY cluster_id",
    "p2_found": f"{_MATCHES} SELECT group_id, sphere_id FROM g",
    "p2_sizes": f"{_MATCHES} SELECT n_spheres, count(*) AS n_groups FROM (SELECT count(*) AS n_spheres FROM g GROUP BY group_id) GROUP BY n_spheres",
}
