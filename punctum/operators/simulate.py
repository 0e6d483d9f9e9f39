"""Simulated points: uniform background and aggregates of one or several genes.

Random numbers are hashes of seed, row and purpose, so every run and every retry of a task gives the same points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Region:
    """width x height with ``layers`` planes ``gap`` apart."""

    width: float = 200.0
    height: float = 200.0
    layers: int = 8
    gap: float = 1.5

    @property
    def depth(self) -> float:
        return (self.layers - 1) * self.gap

    def count(self, density: float) -> int:
        return math.floor(self.width * self.height * density)


def uniform(seed: int, *parts: Column | str | int) -> Column:
    """A number strictly between 0 and 1 for each combination of seed and parts."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _plane(z: Column, region: Region) -> Column:
    return F.least(F.greatest(F.round(z / region.gap), F.lit(0.0)), F.lit(float(region.layers - 1))) * region.gap


def background(spark: SparkSession, region: Region, density: float, gene: str, seed: int) -> DataFrame:
    """Points spread evenly: granule_id -1, target, positions, in_nucleus 0, type "CSR"."""
    p = spark.range(region.count(density))
    u = lambda what: uniform(seed, gene, what, F.col("id"))
    return p.select(F.lit(-1).cast("long").alias("granule_id"), F.lit(gene).alias("target"), (u("x") * region.width).alias("global_x"), (u("y") * region.height).alias("global_y"), _plane(u("z") * region.depth, region).alias("global_z"), F.lit(0).alias("in_nucleus"), F.lit("CSR").alias("type"))


def poisson_count(u: Column, mean: Column | float) -> Column:
    """Poisson number for the uniform number ``u``, by summing the probabilities up to it.

    A number over mean + 10 sqrt(mean) + 50 has a chance under exp(-50), less than the step of ``u``, so the sum ends
    before it. Probabilities go by their logarithms, which any mean allows.
    """
    m = mean if isinstance(mean, Column) else F.lit(float(mean))
    zero = F.struct(F.lit(0).alias("k"), (-m).alias("lp"), F.exp(-m).alias("cdf"))
    step = lambda a, i: F.when(u <= a["cdf"], a).otherwise(F.struct(i.alias("k"), (a["lp"] + F.log(m / i)).alias("lp"), (a["cdf"] + F.exp(a["lp"] + F.log(m / i))).alias("cdf")))
    return F.when(m > 0, F.aggregate(F.sequence(F.lit(1), F.ceil(m + 10 * F.sqrt(m) + 50).cast("int")), zero, step)["k"]).otherwise(0)


def aggregates(spark: SparkSession, region: Region, number: int, genes: dict[str, float], *, mean_distance: float, in_nucleus: float, least_genes: int, kind: str, seed: int, first_id: int = 0) -> DataFrame:
    """Points of ``number`` aggregates: for each of ``genes`` a Poisson number of points at exponential distances.

    Parents lie evenly in the region; each point goes in an even direction and is in the nucleus with probability
    ``in_nucleus``. An aggregate of fewer than ``least_genes`` genes has granule_id -1. Each aggregate carries each gene with
    the chance that its mean gives.
    """
    parents = spark.range(number).select(F.col("id"), *((uniform(seed, "parent", c, F.col("id")) * s).alias(f"p{c}") for c, s in (("x", region.width), ("y", region.height), ("z", region.depth))))
    names = F.array(*(F.struct(F.lit(g).alias("target"), F.lit(float(m)).alias("mean")) for g, m in genes.items()))
    rows = parents.withColumn("g", F.explode(names)).select("id", "px", "py", "pz", "g.target", "g.mean")
    rows = rows.withColumn("n", poisson_count(uniform(seed, "n", F.col("id"), F.col("target")), F.col("mean"))).where("n > 0")
    kinds = rows.groupBy("id").agg(F.count(F.lit(1)).alias("kinds"))
    pts = rows.join(kinds, "id").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    u = lambda what: uniform(seed, what, F.col("id"), F.col("target"), F.col("i"))
    r, cos, turn = -mean_distance * F.log(u("r")), 2 * u("cos") - 1, 2 * math.pi * u("turn")
    flat = r * F.sqrt(1 - cos * cos)
    x, y, z = F.col("px") + flat * F.cos(turn), F.col("py") + flat * F.sin(turn), F.col("pz") + r * cos
    ident = F.when(F.col("kinds") >= least_genes, F.col("id") + first_id).otherwise(F.lit(-1))
    return pts.select(ident.cast("long").alias("granule_id"), "target", x.alias("global_x"), y.alias("global_y"), _plane(z, region).alias("global_z"), (u("nucleus") < in_nucleus).cast("int").alias("in_nucleus"), F.lit(kind).alias("type"))


def simulation(spark: SparkSession, region: Region, *, densities: dict[str, float], outside: int, inside: int, mean_points: float, seed: int, mean_distance: float = 0.5, least_genes: int = 1) -> DataFrame:
    """Background of every gene and aggregates outside and inside nuclei, with tx_id, sample_id and overlaps_nucleus."""
    parts = [background(spark, region, dens, g, seed) for g, dens in densities.items()]
    mean = dict.fromkeys(densities, mean_points / len(densities) if least_genes > 1 else mean_points)
    parts.append(aggregates(spark, region, outside, mean, mean_distance=mean_distance, in_nucleus=0.05, least_genes=least_genes, kind="Extranuclear", seed=seed + 1))
    parts.append(aggregates(spark, region, inside, mean, mean_distance=mean_distance, in_nucleus=0.9, least_genes=least_genes, kind="Intranuclear", seed=seed + 2, first_id=outside))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    key = F.xxhash64("target", "global_x", "global_y", "global_z", "type", "granule_id")
    return out.withColumn("tx_id", F.abs(key)).withColumn("overlaps_nucleus", F.col("in_nucleus")).withColumn("sample_id", F.lit("sim")).withColumn("cell_id", F.lit(None).cast("string"))


def balls_of_segments(points: DataFrame, segment: str, *, least: float = 12.5, noise: Sequence[str] = ("0", "")) -> DataFrame:
    """The smallest sphere of every segment with at least ``least`` points; noise segments and NULL are dropped."""
    from punctum.operators.density import enclosing_balls

    p = points.where(F.col(segment).isNotNull() & ~F.col(segment).isin(*noise))
    big = p.groupBy(segment).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return enclosing_balls(p.join(big, segment, "left_semi"), [segment]).join(big, segment)
