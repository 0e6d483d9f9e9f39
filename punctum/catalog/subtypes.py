"""Subtypes by standard scores, their tuning, and clusterings."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctum.catalog.base import granules, readings, sql
from punctum.catalog.spatial import _INL
from punctum.operators import subtype as T
from punctum.operators.density import profile
from punctum.operators.stats import adjusted_rand, kmeans_labels, principal_components
from punctum.sources import table

r6 = lambda c: F.round(c, 6)
_CATEGORY = "CASE WHEN gene < 'D' THEN 'pre' WHEN gene < 'H' THEN 'post' WHEN gene < 'R' THEN 'dendrite' ELSE 'axon' END"


def _markers(spark, d):
    category = F.when(F.col("gene") < "D", "pre").when(F.col("gene") < "H", "post").when(F.col("gene") < "R", "dendrite").otherwise("axon")
    return table(spark, d, "gene_panel").select("gene", category.alias("category"))


def _expr(spark, d):
    return profile(readings(spark, d), granules(spark, d))


def _scores(spark, d):
    return T.category_scores(_expr(spark, d), granules(spark, d).select("sphere_id"), _markers(spark, d), "sphere_id")


def n02_standard_scores(spark, d):
    z = T.standard_scores(_expr(spark, d), granules(spark, d).select("sphere_id"), "sphere_id")
    return z.select("sphere_id", "target", r6("z").alias("z"))


def n04_scores(spark, d):
    return _scores(spark, d).select("sphere_id", *(r6(c).alias(c) for c in T.PARTS))


def n05_subtypes(spark, d):
    return T.classified(_scores(spark, d)).select("sphere_id", "subtype", "subtype_simple")


def n03_cluster_scores(spark, d):
    """Scores by cluster; the granule's gene stands for its cluster."""
    m = granules(spark, d).select("sphere_id", F.col("gene").alias("cluster"))
    s = T.cluster_scores(_expr(spark, d), m, table(spark, d, "gene_panel"), _markers(spark, d), "sphere_id", "cluster")
    return s.select("cluster", *(r6(c).alias(c) for c in T.PARTS))


def n06_cluster_labels(spark, d):
    """Cluster labels mapped back to the granules."""
    m = granules(spark, d).select("sphere_id", F.col("gene").alias("cluster"))
    s = T.cluster_scores(_expr(spark, d), m, table(spark, d, "gene_panel"), _markers(spark, d), "sphere_id", "cluster")
    return m.join(T.classified(s).select("cluster", "subtype"), "cluster").select("sphere_id", "subtype")


MANUAL = [("pre-syn", 0.16), ("post-syn", 0.34), ("dendrites", 0.17), ("mixed", 0.33)]


ENRICHMENTS = [0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6]
LEASTS = [-1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0]


def n08_tuning(spark, d):
    """Distance of the subtype shares to the manual ones over 9 x 7 thresholds."""
    manual = spark.createDataFrame(MANUAL, "subtype_simple string, share double")
    return T.tuned(_scores(spark, d), manual, ENRICHMENTS, LEASTS).select("enrichment", "least", r6("error").alias("error"))


def n16_manual_shares(spark, d):
    n = n05_subtypes(spark, d).groupBy("subtype_simple").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    return n.select("subtype_simple", r6(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def f20_kmeans(spark, d):
    return kmeans_labels(_scores(spark, d), list(T.PARTS), 5, 1, "sphere_id")


def f21_agreement(spark, d):
    """Adjusted Rand index of genes and composition as labels of the granules."""
    return adjusted_rand(granules(spark, d), "gene", "comp").select(r6("ari").alias("ari"))


def f22_components(spark, d):
    return principal_components(_scores(spark, d), list(T.PARTS), 2, "sphere_id")


QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "nf" and k[1:3].isdigit()}

_PF = f"pf AS MATERIALIZED (SELECT g.sphere_id, t.target AS gene, count(*) AS n FROM gr g JOIN tx t ON {_INL} GROUP BY ALL), mk AS (SELECT gene, {_CATEGORY} AS category FROM gene_panel)"
_SC = f"""{_PF}, st AS (SELECT gene, sum(n) / (SELECT count(*) FROM gr) AS mean, sqrt(greatest(sum(n * n) / (SELECT count(*) FROM gr) - (sum(n) / (SELECT count(*) FROM gr)) ** 2, 0)) AS sd FROM pf GROUP BY gene),
ms AS (SELECT mk.category, st.* FROM mk JOIN st ON mk.gene = st.gene WHERE sd > 0), ba AS (SELECT category, sum(-mean / sd) AS base FROM ms GROUP BY category),
up AS (SELECT pf.sphere_id, ms.category, sum(pf.n / sd) AS up FROM pf JOIN ms ON pf.gene = ms.gene GROUP BY ALL),
lg AS (SELECT gr.sphere_id, ba.category, base + coalesce(up, 0) AS score FROM gr CROSS JOIN ba LEFT JOIN up ON up.sphere_id = gr.sphere_id AND up.category = ba.category),
sr AS MATERIALIZED (SELECT sphere_id, coalesce(sum(score) FILTER (category = 'pre'), 0) AS pre, coalesce(sum(score) FILTER (category = 'post'), 0) AS post, coalesce(sum(score) FILTER (category = 'dendrite'), 0) AS dendrite, coalesce(sum(score) FILTER (category = 'axon'), 0) AS axon FROM lg GROUP BY sphere_id)"""


def _label(source: str, enrichment: str = "0.35", least: str = "0") -> str:
    on = lambda c: f"(greatest({c}, 0) / tot >= {enrichment} AND {c} >= {least})"
    names = {"pre": "pre-syn", "post": "post-syn", "dendrite": "dendrites", "axon": "axons"}
    joined = "concat_ws(' & ', " + ", ".join(f"CASE WHEN {on(c)} THEN '{n}' END" for c, n in names.items()) + ")"
    return f"(SELECT *, CASE WHEN tot > 0 AND {joined} <> '' THEN {joined} ELSE 'others' END AS subtype FROM (SELECT *, greatest(pre, 0) + greatest(post, 0) + greatest(dendrite, 0) + greatest(axon, 0) AS tot FROM {source}))"


_SIMPLE = "CASE WHEN contains(subtype, ' & ') THEN 'mixed' ELSE subtype END"
_CL = f"""{_PF}, sz AS (SELECT gene AS cluster, count(*) AS size FROM gr GROUP BY gene), su AS (SELECT gr.gene AS cluster, pf.gene, sum(pf.n) AS s FROM pf JOIN gr ON pf.sphere_id = gr.sphere_id GROUP BY ALL),
gd AS (SELECT sz.cluster, p.gene, coalesce(s, 0) / size AS mean FROM sz CROSS JOIN gene_panel p LEFT JOIN su ON su.cluster = sz.cluster AND su.gene = p.gene),
zz AS (SELECT cluster, gene, CASE WHEN stddev_pop(mean) OVER w > 0 THEN (mean - avg(mean) OVER w) / stddev_pop(mean) OVER w ELSE 0 END AS z FROM gd WINDOW w AS (PARTITION BY cluster)),
cs AS MATERIALIZED (SELECT cluster, coalesce(sum(z) FILTER (category = 'pre'), 0) AS pre, coalesce(sum(z) FILTER (category = 'post'), 0) AS post, coalesce(sum(z) FILTER (category = 'dendrite'), 0) AS dendrite, coalesce(sum(z) FILTER (category = 'axon'), 0) AS axon FROM zz JOIN mk ON zz.gene = mk.gene GROUP BY cluster)"""

SQL = {
    "n02_standard_scores": sql(f"{_SC} SELECT pf.sphere_id, pf.gene AS target, round(CASE WHEN sd > 0 THEN (pf.n - mean) / sd ELSE 0 END, 6) AS z FROM pf JOIN st ON pf.gene = st.gene"),
    "n04_scores": sql(f"{_SC} SELECT sphere_id, round(pre, 6) AS pre, round(post, 6) AS post, round(dendrite, 6) AS dendrite, round(axon, 6) AS axon FROM sr"),
    "n05_subtypes": sql(f"{_SC} SELECT sphere_id, subtype, {_SIMPLE} AS subtype_simple FROM {_label('sr')}"),
    "n03_cluster_scores": sql(f"{_CL} SELECT cluster, round(pre, 6) AS pre, round(post, 6) AS post, round(dendrite, 6) AS dendrite, round(axon, 6) AS axon FROM cs"),
    "n06_cluster_labels": sql(f"{_CL} SELECT gr.sphere_id, l.subtype FROM gr JOIN {_label('cs')} l ON gr.gene = l.cluster"),
    "n08_tuning": sql(f"""{_SC}, th AS (SELECT * FROM (SELECT unnest({ENRICHMENTS}::DOUBLE[]) AS enrichment), (SELECT unnest({LEASTS}::DOUBLE[]) AS least)),
mn AS (SELECT unnest(['pre-syn', 'post-syn', 'dendrites', 'mixed']) AS simple, unnest([0.16, 0.34, 0.17, 0.33]::DOUBLE[]) AS want),
lb AS (SELECT enrichment, least, {_SIMPLE} AS simple, count(*) AS n FROM {_label("(SELECT * FROM sr, th)", "enrichment", "least")} GROUP BY ALL), sh AS (SELECT *, n / sum(n) OVER (PARTITION BY enrichment, least) AS share FROM lb)
SELECT th.enrichment, th.least, round(sum((coalesce(share, 0) - want) ** 2), 6) AS error FROM th CROSS JOIN mn LEFT JOIN sh ON sh.enrichment = th.enrichment AND sh.least = th.least AND sh.simple = mn.simple GROUP BY ALL"""),
    "n16_manual_shares": sql(f"{_SC} SELECT {_SIMPLE} AS subtype_simple, round(count(*) / (SELECT count(*) FROM gr), 6) AS share FROM {_label('sr')} GROUP BY ALL"),
    "f21_agreement": sql("""c AS (SELECT gene, comp, count(*) AS n FROM gr GROUP BY ALL), i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS t FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY gene)), y AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT sum(n) AS n FROM c GROUP BY comp))
SELECT round((i - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)), 6) AS ari FROM i, x, y"""),
}
