"""Rule-based subtypes from standardised expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctum.functions.columns import simplified

#: Order of the categories in a label, with the names of pure ones; fixed values.
PARTS = {"pre": "pre-syn", "post": "post-syn", "dendrite": "dendrites", "axon": "axons"}


@dataclass(frozen=True)
class SubtypeParams:
    """enrichment: least share of a category in the positive scores; least: least score of an enriched category."""

    enrichment: float = 0.35
    least: float = 0.0


def category_scores(expr: DataFrame, ids: DataFrame, markers: DataFrame, row_id: str) -> DataFrame:
    """(row_id, pre, post, dendrite, axon): sums of the genes' standard scores over all rows of ``ids``, absent genes as 0.

    Scores are over the zero-filled matrix with the population's spread, 0 for genes that don't vary; the matrix itself is
    never built: a gene's absence everywhere enters as a constant. ``expr`` is (row_id, target, n) with positive n, ``markers``
    (category, gene); a gene may be in two categories, one that no row expresses counts in none.
    """
    n_rows = ids.agg(F.count(F.lit(1)).cast("double").alias("N"))
    sums = expr.groupBy(F.col("target").alias("gene")).agg(F.sum("n").cast("double").alias("s"), F.sum(F.col("n") * F.col("n")).cast("double").alias("q")).crossJoin(n_rows)
    mean = F.col("s") / F.col("N")
    stat = sums.select("gene", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("N") - mean * mean, F.lit(0.0))).alias("sd")).where("sd > 0")
    m = markers.join(stat, "gene")
    absent = m.groupBy("category").agg(F.sum(-F.col("mean") / F.col("sd")).alias("base"))
    present = expr.join(m, expr["target"] == m["gene"]).groupBy(row_id, "category").agg(F.sum(F.col("n") / F.col("sd")).alias("up"))
    cross = ids.select(row_id).crossJoin(absent)
    score = cross.join(present, [row_id, "category"], "left").select(row_id, "category", (F.col("base") + F.coalesce("up", F.lit(0.0))).alias("score"))
    return score.groupBy(row_id).pivot("category", list(PARTS)).agg(F.sum("score")).fillna(0.0)


def standard_scores(expr: DataFrame, ids: DataFrame, row_id: str) -> DataFrame:
    """(row_id, target, z) of every positive entry: its standard score over all rows of ``ids``, absent entries counted as 0.

    The population's spread is used; a gene that doesn't vary has 0. Absent entries have the same score in all rows, which
    is left out.
    """
    n_rows = ids.agg(F.count(F.lit(1)).cast("double").alias("N"))
    sums = expr.groupBy("target").agg(F.sum("n").cast("double").alias("s"), F.sum(F.col("n") * F.col("n")).cast("double").alias("q")).crossJoin(n_rows)
    mean = F.col("s") / F.col("N")
    stat = sums.select("target", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("N") - mean * mean, F.lit(0.0))).alias("sd"))
    return expr.join(stat, "target").select(row_id, "target", F.when(F.col("sd") > 0, (F.col("n") - F.col("mean")) / F.col("sd")).otherwise(0.0).alias("z"))


def cluster_scores(expr: DataFrame, members: DataFrame, genes: DataFrame, markers: DataFrame, row_id: str, cluster: str) -> DataFrame:
    """(cluster, pre, post, dendrite, axon) from cluster means, standardised within each cluster across all ``genes``."""
    size = members.groupBy(cluster).agg(F.count(F.lit(1)).cast("double").alias("size"))
    s = expr.join(members, row_id).groupBy(cluster, F.col("target").alias("gene")).agg(F.sum("n").cast("double").alias("s"))
    grid = size.crossJoin(genes.select("gene").distinct()).join(s, [cluster, "gene"], "left").withColumn("mean", F.coalesce("s", F.lit(0.0)) / F.col("size"))
    w = Window.partitionBy(cluster)
    sd = F.stddev_pop("mean").over(w)
    z = grid.withColumn("z", F.when(sd > 0, (F.col("mean") - F.avg("mean").over(w)) / sd).otherwise(0.0))
    return z.join(markers, "gene").groupBy(cluster).pivot("category", list(PARTS)).agg(F.sum("z")).fillna(0.0)


def subtype(p: SubtypeParams = SubtypeParams(), parts: Sequence[str] = tuple(PARTS)) -> Column:
    """Label of the scores in the columns ``parts``: names of the enriched categories joined by " & ", or "others".

    A category is enriched if its share of the positive scores reaches ``enrichment`` and its score ``least``.
    """
    total = sum((F.greatest(F.col(c), F.lit(0.0)) for c in parts[1:]), F.greatest(F.col(parts[0]), F.lit(0.0)))
    on = [F.when((F.greatest(F.col(c), F.lit(0.0)) / total >= p.enrichment) & (F.col(c) >= p.least), F.lit(PARTS[c])) for c in parts]
    label = F.array_join(F.filter(F.array(*on), lambda v: v.isNotNull()), " & ")
    return F.when((total > 0) & (label != ""), label).otherwise("others")


def classified(scores: DataFrame, p: SubtypeParams = SubtypeParams()) -> DataFrame:
    """``scores`` with subtype, and subtype_simple in which several parts are "mixed"."""
    return scores.withColumn("subtype", subtype(p)).withColumn("subtype_simple", simplified(F.col("subtype")))


def tuned(scores: DataFrame, manual: DataFrame, enrichments: Sequence[float], leasts: Sequence[float]) -> DataFrame:
    """(enrichment, least, error): squared distance of the subtype shares to ``manual`` (subtype_simple, share) for each pair of thresholds.

    All pairs are computed in one job; the smallest error, then the smallest thresholds, come first.
    """
    spark = scores.sparkSession
    grid = spark.createDataFrame([(float(a), float(b)) for a in enrichments for b in leasts], "enrichment double, least double")
    parts = list(PARTS)
    total = sum((F.greatest(F.col(c), F.lit(0.0)) for c in parts[1:]), F.greatest(F.col(parts[0]), F.lit(0.0)))
    on = [F.when((F.greatest(F.col(c), F.lit(0.0)) / total >= F.col("enrichment")) & (F.col(c) >= F.col("least")), F.lit(PARTS[c])) for c in parts]
    label = F.array_join(F.filter(F.array(*on), lambda v: v.isNotNull()), " & ")
    label = simplified(F.when((total > 0) & (label != ""), label).otherwise("others"))
    n = scores.crossJoin(F.broadcast(grid)).groupBy("enrichment", "least", label.alias("subtype_simple")).agg(F.count(F.lit(1)).alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("enrichment", "least")))
    want = grid.crossJoin(manual.withColumnRenamed("share", "want"))
    e = want.join(share, ["enrichment", "least", "subtype_simple"], "left").groupBy("enrichment", "least").agg(F.sum(F.pow(F.coalesce("share", F.lit(0.0)) - F.col("want"), 2)).alias("error"))
    return e.orderBy("error", "enrichment", "least")
