"""Neighbourhood and tile embeddings of labelled points."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctum.functions.geometry import distance
from punctum.operators.proximity import points_near_points
from punctum.operators.spatial import nearest

#: Weight of a distance, and the reach in sigmas beyond which it is taken as none.
KERNELS = {
    "gaussian": (lambda d, s: F.exp(-d * d / (2.0 * s * s)), 3.0),
    "exponential": (lambda d, s: F.exp(-d / s), 4.0),
    "uniform": (lambda d, s: F.lit(1.0), None),
}


def neighbours(centres: DataFrame, points: DataFrame, radius: float, *, centre_id: str, point_id: str, keys: Sequence[str], centre_xy: Sequence[str], point_xy: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """(centre_id, point_id, d, dx, dy, *carry) of all points at most ``radius`` from a centre in the plane."""
    c = centres.select(*keys, F.col(centre_id), F.col(centre_xy[0]).alias("__cx"), F.col(centre_xy[1]).alias("__cy")).distinct()
    p = points.select(F.col(point_id), F.col(point_xy[0]).alias("__px"), F.col(point_xy[1]).alias("__py"), *carry).distinct()
    pairs = points_near_points(centres, points, distance=radius, left_id=centre_id, right_id=point_id, left_xyz=centre_xy, right_xyz=point_xy, keys=keys)
    joined = pairs.join(c.drop(*keys), centre_id).join(p, point_id)
    d = distance((F.col("__px"), F.col("__cx")), (F.col("__py"), F.col("__cy")))
    return joined.select(centre_id, point_id, d.alias("d"), (F.col("__px") - F.col("__cx")).alias("dx"), (F.col("__py") - F.col("__cy")).alias("dy"), *carry)


def neighbourhood_features(centres: DataFrame, near: DataFrame, radius: float, centre_id: str) -> DataFrame:
    """Eight features of the points around each centre: n, mean_d, std_d, max_d, min_d, density, offset, anisotropy.

    Spread is over the population; anisotropy is the ratio of the eigenvalues of the sample covariance, NULL for one
    point or points in a line. A centre without points has n and density 0 and NULL for the rest.
    """
    a = near.groupBy(centre_id).agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_d"), F.stddev_pop("d").alias("std_d"), F.max("d").alias("max_d"), F.min("d").alias("min_d"),
        F.avg("dx").alias("mx"), F.avg("dy").alias("my"), F.var_samp("dx").alias("vx"), F.var_samp("dy").alias("vy"), F.covar_samp("dx", "dy").alias("vxy"),
    )
    mid, half = (F.col("vx") + F.col("vy")) / 2, F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, 2) + F.col("vxy") * F.col("vxy"))
    low, high = mid - half, mid + half
    ratio = F.when((F.col("n") > 1) & (low > 1e-9 * high), high / low)
    out = centres.select(centre_id).distinct().join(a, centre_id, "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(centre_id, n.alias("n"), "mean_d", "std_d", "max_d", "min_d", (n / (math.pi * radius**2)).alias("density"), F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my")).alias("offset"), ratio.alias("anisotropy"))


def weighted_expression(near: DataFrame, expr: DataFrame, *, centre_id: str, point_id: str, weight: Column) -> DataFrame:
    """(centre_id, target, value): expression of the points around each centre, weights summing to 1; zeros are left out."""
    w = near.withColumn("w", weight)
    total = w.groupBy(centre_id).agg(F.sum("w").alias("total"))
    return w.join(expr, point_id).groupBy(centre_id, "target").agg(F.sum(F.col("w") * F.col("n")).alias("s")).join(total, centre_id).where("total > 0").select(centre_id, "target", (F.col("s") / F.col("total")).alias("value"))


def nearest_slots(centres: DataFrame, points: DataFrame, k: int, radius: float, *, centre_id: str, point_id: str, label: str, keys: Sequence[str], centre_xy: Sequence[str], point_xy: Sequence[str], padding: str = "Others") -> DataFrame:
    """(centre_id, slot, label): the labels of the ``k`` nearest points strictly within ``radius``; empty slots are padded.

    All k slots of every centre are filled.
    """
    near = nearest(centres, points, k, left_id=centre_id, right_id=point_id, keys=keys, left_xyz=centre_xy, right_xyz=point_xy, cell=radius, within=radius)
    labelled = near.join(points.select(point_id, label).distinct(), point_id).select(centre_id, (F.col("place") - 1).alias("slot"), label)
    slots = centres.select(centre_id).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return slots.join(labelled, [centre_id, "slot"], "left").select(centre_id, "slot", F.coalesce(label, F.lit(padding)).alias(label))


def label_shares(centres: DataFrame, near: DataFrame, *, centre_id: str, label: str, weight: Column, padding: str = "Others") -> DataFrame:
    """(centre_id, label, share): weight of each label around a centre over all weights; without points the padding has 1."""
    w = near.groupBy(centre_id, label).agg(F.sum(weight).alias("w"))
    w = w.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy(centre_id)))
    out = centres.select(centre_id).distinct().join(w, centre_id, "left")
    return out.select(centre_id, F.coalesce(label, F.lit(padding)).alias(label), F.coalesce("share", F.lit(1.0)).alias("share"))


def smoothed(counts: DataFrame, near: DataFrame, *, tile_id: str, other_id: str, label: str, value: str, weight: Column) -> DataFrame:
    """(tile_id, label, value): weighted mean over the neighbours of each tile, itself among them; ``near`` has d."""
    w = near.withColumn("w", weight)
    total = w.groupBy(tile_id).agg(F.sum("w").alias("total"))
    at = counts.select(F.col(tile_id).alias(other_id), label, value)
    s = w.join(at, other_id).groupBy(tile_id, label).agg(F.sum(F.col("w") * F.col(value)).alias("s"))
    return s.join(total, tile_id).select(tile_id, label, (F.col("s") / F.col("total")).alias(value))


def smoothed_by_nearest(counts: DataFrame, tiles: DataFrame, k: int, *, tile_id: str, label: str, value: str, keys: Sequence[str], xy: Sequence[str], cell: float) -> DataFrame:
    """(tile_id, label, value): Gaussian-weighted mean over the ``k`` nearest tiles, the tile itself among them.

    The Gaussian's width is the median of the positive distances, 1 if there is none.
    """
    other = f"other_{tile_id}"
    near = nearest(tiles, tiles, k, left_id=tile_id, right_id=tile_id, keys=keys, left_xyz=xy, right_xyz=xy, cell=cell).withColumnRenamed("distance", "d")
    sigma = near.agg(F.coalesce(F.median(F.when(F.col("d") > 0, F.col("d"))), F.lit(1.0)).alias("sigma"))
    return smoothed(counts, near.crossJoin(sigma), tile_id=tile_id, other_id=other, label=label, value=value, weight=F.exp(-F.col("d") * F.col("d") / (2 * F.col("sigma") * F.col("sigma"))))


def soft_expression(near: DataFrame, expr: DataFrame, *, tile_id: str, point_id: str, kernel: str, sigma: float) -> DataFrame:
    """(tile_id, target, value): kernel-weighted expression of the points around each tile centre, as shares of the tile's sum."""
    w = near.withColumn("w", KERNELS[kernel][0](F.col("d"), sigma))
    s = w.join(expr, point_id).groupBy(tile_id, "target").agg(F.sum(F.col("w") * F.col("n")).alias("s"))
    total = F.sum("s").over(Window.partitionBy(tile_id))
    return s.select(tile_id, "target", F.when(total > 0, F.col("s") / total).otherwise(0.0).alias("value"))


def soft_counts(near: DataFrame, *, tile_id: str, label: str, kernel: str, sigma: float) -> DataFrame:
    """(tile_id, label, value): kernel-weighted counts of the points around each tile centre, within the kernel's support."""
    weight, _ = KERNELS[kernel]
    return near.groupBy(tile_id, label).agg(F.sum(weight(F.col("d"), sigma)).alias("value"))


def support(kernel: str, sigma: float, width: float) -> float:
    """Reach of a kernel: so many sigmas, or half a tile for the uniform one."""
    reach = KERNELS[kernel][1]
    return width / 2 if reach is None else reach * sigma
