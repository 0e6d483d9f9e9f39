"""Density clusters, smallest enclosing spheres and their features."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctum.functions.columns import kept
from punctum.functions.geometry import distance, nearest_plane
from punctum.functions.names import finite
from punctum.operators.proximity import points_in_spheres
from punctum.operators.spatial import occupied_area
from punctum.operators.tileclusters import clusters_by_tiles, exact_clusters
from punctum.plans.components import components
from punctum.plans.shared import written_once

XYZ = ("global_x", "global_y", "global_z")
#: Positions of a cluster that may be gathered as they are.
FEW = 1000


@dataclass(frozen=True)
class DetectorParams:
    """Parameters of the detector, by their usual names and values.

    eps, minspl (None: from the Poisson rule), grid_len, cutoff_prob, alpha, low_bound; size_thr, in_soma_thr; l, rho, s
    of the merge; nc_top, nc_thr of the control filter; merge_genes and merged_gene_label; planes of a discrete platform.
    """

    eps: float = 1.5
    minspl: int | None = None
    grid_len: float = 1.0
    cutoff_prob: float = 0.95
    alpha: float = 5.0
    low_bound: int = 3
    size_thr: float = 4.0
    in_soma_thr: float = 0.1
    l: float = 1.0  # noqa: E741
    rho: float = 0.2
    s: float = 1.0
    nc_top: int = 20
    nc_thr: float | None = 0.1
    merge_genes: bool = False
    merged_gene_label: str = "merged"
    planes: tuple[float, ...] = ()


def poisson_quantile(p: float, mu: float) -> int:
    """Smallest k with P(X <= k) >= p for a Poisson mean ``mu``; 0 for mean 0."""
    if mu <= 0:
        return 0
    k, log_term, total = 0, -mu, math.exp(-mu)
    while total < p:
        k += 1
        log_term += math.log(mu / k)
        total += math.exp(log_term)
    return k


def least_points(points: DataFrame, p: DetectorParams, keys: Sequence[str], gene: str = "target") -> DataFrame:
    """(keys, gene, least): near points that make one central, from the gene's density in the plane."""
    area = occupied_area(points, p.grid_len, keys)
    n = points.groupBy(*keys, gene).agg(F.count(F.lit(1)).alias("n"))
    mu = F.lit(p.alpha) * F.col("n") / F.col("area") * math.pi * p.eps**2

    @F.pandas_udf("long")
    def quantile(m: pd.Series) -> pd.Series:
        return m.map(lambda v: poisson_quantile(p.cutoff_prob, v)).astype("int64")

    joined = n.join(area, list(keys)) if keys else n.crossJoin(area)
    return joined.select(*keys, gene, F.greatest(quantile(mu), F.lit(p.low_bound).cast("long")).alias("least"))


def density_clusters(points: DataFrame, *, eps: float, least: int | DataFrame, groups: Sequence[str] = ("sample_id", "target"), row_id: str = "tx_id", width: float = 160.0, most: int = 400_000, written: bool = False) -> DataFrame:
    """(groups, cluster, row_id, central): density clusters within each group, named by their least central id.

    A point with ``least`` points within ``eps``, itself and copies included, is central. Central points that are near each
    other share a cluster; another point near central ones goes to the cluster of the least id, as it does when
    clusters are grown in row order. ``least`` may be a table of groups with a column least. The last of ``groups`` is
    held apart within a tile, the others make tiles of their own; tiles of over ``most`` rows are cut up. ``points`` is read
    twice, so it is written to the shared folder first, unless it is a table ``written`` already. Rows with a NULL
    group or a position that isn't finite are in no cluster; rows of one ``row_id`` count once and must be equal.
    """
    *outer, inner = groups
    p = points if isinstance(least, int) else points.join(least.select(*groups, "least"), list(groups))
    p = p.select(*(F.col(k).alias(f"key_{i}") for i, k in enumerate(outer)), F.col(inner).alias("block"), F.col(row_id).cast("long").alias("row_id"), *((F.col(c).cast("double") + F.lit(0.0)).alias(n) for c, n in zip(XYZ, "xyz")), (F.lit(least) if isinstance(least, int) else F.col("least")).cast("long").alias("least"))
    keys = [f"key_{i}" for i in range(len(outer))]
    for c in "xyz":
        p = p.where(finite(F.col(c)))
    p = p.where(" AND ".join(f"{c} IS NOT NULL" for c in ("row_id", "block", *keys)))
    rows = clusters_by_tiles(p if written else written_once(p, "points"), keys, exact_clusters(eps), components, eps=eps, width=width, most=most, named=True)
    names = [F.col(a).alias(b) for a, b in zip([*keys, "block"], groups)]
    return rows.select(*names, F.col("cluster_id").alias("cluster"), F.col("row_id").alias(row_id), "central")


def _ball_of(support: np.ndarray) -> tuple[np.ndarray, float]:
    """Smallest sphere with all of at most four points on its surface, in the space they span."""
    base = support[0]
    if len(support) == 1:
        return base, 0.0
    q = support[1:] - base
    if len(support) == 2:
        centre = base + q[0] / 2
    else:
        g, b = 2 * q @ q.T, (q * q).sum(axis=1)
        flat = abs(np.linalg.det(g)) <= 1e-9 * g.diagonal().prod()
        centre = base + (np.linalg.lstsq(g, b, rcond=None)[0] if flat else np.linalg.solve(g, b)) @ q
    return centre, float(((support - centre) ** 2).sum(axis=1).max())


def smallest_ball(xyz: np.ndarray, tolerance: float = 1e-8) -> tuple[np.ndarray, float]:
    """(centre, radius) of the smallest sphere around ``xyz``; works for one, collinear, coplanar and repeated points.

    Grows a support set: the farthest point joins it, and of all its subsets of up to four points the one with the
    smallest sphere that holds the others stays. The radius grows in every step, so it ends.
    """
    from itertools import combinations

    pts = np.unique(np.asarray(xyz, float), axis=0)
    support = pts[:1]
    centre, r2 = _ball_of(support)
    while True:
        d2 = ((pts - centre) ** 2).sum(axis=1)
        far = int(d2.argmax())
        if d2[far] <= r2 * (1 + tolerance) + 1e-18:
            return centre, math.sqrt(max(d2[far], 0.0))
        pool = np.vstack([support, pts[far]])
        best = None
        for size in range(1, min(4, len(pool)) + 1):
            for rows in combinations(range(len(pool) - 1), size - 1):
                sub = pool[[*rows, len(pool) - 1]]
                c, q = _ball_of(sub)
                if (((pool - c) ** 2).sum(axis=1) <= q * (1 + 1e-10) + 1e-18).all() and (best is None or q < best[1]):
                    best = (c, q, sub)
        if best is None or best[1] <= r2 * (1 + 1e-13):
            return centre, math.sqrt(max(d2[far], 0.0))
        centre, r2, support = best


#: Subsets of a support and a farther point, by place, without those that lack the point, which is place 4; smallest first.
_SUBSETS = [(*rows, 4) for size in (1, 2, 3) for rows in itertools.combinations(range(4), size)]


def _grown(pool: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, squared radius, number in _SUBSETS) of the smallest sphere of each pool (4 support places and a new point) around
    all of it. ``count`` of the support places are taken; the radius is infinite where no subset will do. Flat subsets are left
    out, as a subset of theirs has the same sphere."""
    taken = np.concatenate([np.arange(4) < count[:, None], np.ones((len(pool), 1), bool)], axis=1)
    best = np.full(len(pool), np.inf)
    centre, which = np.zeros((len(pool), 3)), np.full(len(pool), -1)
    for number, rows in enumerate(_SUBSETS):
        at = np.flatnonzero(taken[:, rows].all(axis=1))
        sub = pool[at][:, rows]
        base, q = sub[:, 0], sub[:, 1:] - sub[:, :1]
        if len(rows) == 2:
            c = base + q[:, 0] / 2
        else:
            g, b = 2 * q @ q.transpose(0, 2, 1), (q * q).sum(axis=2)
            full = np.abs(np.linalg.det(g)) > 1e-9 * np.diagonal(g, axis1=1, axis2=2).prod(axis=1)
            at, sub, base, q, g, b = at[full], sub[full], base[full], q[full], g[full], b[full]
            c = base + (np.linalg.solve(g, b[:, :, None]) * q).sum(axis=1)
        r2 = ((sub - c[:, None]) ** 2).sum(axis=2).max(axis=1)
        holds = ((((pool[at] - c[:, None]) ** 2).sum(axis=2) <= (r2 * (1 + 1e-10) + 1e-18)[:, None]) | ~taken[at]).all(axis=1) & (r2 < best[at])
        best[at[holds]], centre[at[holds]], which[at[holds]] = r2[holds], c[holds], number
    return centre, best, which


def smallest_balls(xyz: np.ndarray, sizes: np.ndarray, tolerance: float = 1e-8) -> np.ndarray:
    """Rows (x, y, z, radius) of the smallest spheres of groups of ``sizes`` points that follow each other in ``xyz``.

    ``smallest_ball`` for all groups at once, those of about one size together; groups over 64 points are taken one by one.
    """
    out = np.zeros((len(sizes), 4))
    start = np.cumsum(sizes) - sizes
    o = np.lexsort((xyz[:, 2], xyz[:, 1], xyz[:, 0], np.repeat(np.arange(len(sizes)), sizes)))
    xyz = np.asarray(xyz, float)[o]
    alone = list(np.flatnonzero(sizes > 64))
    low = 0
    for high in (4, 8, 16, 32, 64):
        ids = np.flatnonzero((sizes > low) & (sizes <= high))
        low = high
        pts = xyz[start[ids, None] + np.minimum(np.arange(high), sizes[ids, None] - 1)]
        support, count = np.repeat(pts[:, :1], 4, axis=1), np.ones(len(ids), np.int64)
        centre, r2 = pts[:, 0].copy(), np.zeros(len(ids))
        live = np.arange(len(ids))
        while len(live):
            d2 = ((pts[live] - centre[live][:, None]) ** 2).sum(axis=2)
            far = d2.argmax(axis=1)
            most = d2[np.arange(len(live)), far]
            out[ids[live]] = np.column_stack([centre[live], np.sqrt(most)])
            more = most > r2[live] * (1 + tolerance) + 1e-18
            live, far = live[more], far[more]
            pool = np.concatenate([support[live], pts[live, far][:, None]], axis=1)
            c, q, which = _grown(pool, count[live])
            alone += list(ids[live[which < 0]])
            up = (which >= 0) & (q > r2[live] * (1 + 1e-13))
            live, pool, which = live[up], pool[up], which[up]
            centre[live], r2[live] = c[up], q[up]
            for number, rows in enumerate(_SUBSETS):
                mine = which == number
                support[live[mine], : len(rows)] = pool[mine][:, rows]
                count[live[mine]] = len(rows)
    for i in alone:
        c, r = smallest_ball(xyz[start[i] : start[i] + sizes[i]], tolerance)
        out[i] = *c, r
    return out


def _rim(members: DataFrame, by: list[str]) -> DataFrame:
    """The distinct positions of each cluster that may lie on its smallest sphere.

    With the largest distance R from the centroid and half the widest extent as a lower bound q of the radius, the centre is
    at most sqrt(R² - q²) from the centroid, so nothing nearer to it than q less that touches the sphere. This keeps
    large dense clusters from gathering in one row.
    """
    spots = members.select(*by, *XYZ).distinct()
    mean = spots.groupBy(*by).agg(*(F.avg(c).alias(f"m_{c}") for c in XYZ), F.greatest(*(F.max(c) - F.min(c) for c in XYZ)).alias("wide"))
    far = spots.join(mean, by).withColumn("d", distance(*((F.col(c), F.col(f"m_{c}")) for c in XYZ)))
    reach = far.groupBy(*by).agg(F.max("d").alias("R"))
    q = F.col("wide") / 2
    slack = F.sqrt(F.greatest(F.col("R") * F.col("R") - q * q, F.lit(0.0)))
    return far.join(reach, by).where(F.col("d") >= q - slack - 1e-9).select(*by, *XYZ)


def enclosing_balls(members: DataFrame, by: Sequence[str], *, least: int = 1, distinct: bool = False) -> DataFrame:
    """(by, sphere_x, sphere_y, sphere_z, sphere_r): the smallest sphere around each cluster of ``least`` positions or more.

    Positions of a cluster are gathered in one row; of clusters with over ``FEW`` only those that may lie on the sphere.
    ``distinct`` tells that ``members`` is a written table with each position of a cluster once.
    """
    by = list(by)
    spots = members if distinct else written_once(members.select(*by, *XYZ).distinct(), "spots")
    n = written_once(spots.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")), "sizes")
    gathered = lambda df: df.groupBy(*by).agg(*(F.collect_list(c).alias(c) for c in XYZ))
    n = n.where(F.col("__n") >= least)
    many = n.where(F.col("__n") > FEW)
    if many.isEmpty():
        rim = gathered(spots).where(F.size(XYZ[0]) >= least)
    else:
        rim = gathered(spots.join(n.where(F.col("__n") <= FEW), by, "left_semi")).unionByName(gathered(_rim(spots.join(many, by, "left_semi"), by)))

    @F.pandas_udf("sphere_x double, sphere_y double, sphere_z double, sphere_r double")
    def ball(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.DataFrame:
        sizes = x.map(len).to_numpy(np.int64)
        xyz = np.column_stack([np.concatenate([np.zeros(0), *c]) for c in (x, y, z)])
        return pd.DataFrame(smallest_balls(xyz, sizes), columns=["sphere_x", "sphere_y", "sphere_z", "sphere_r"])

    spark = members.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a row costs far more than its bytes tell, so adaptive execution mustn't merge partitions here
    return rim.repartition(tasks, *by).select(*by, ball(*XYZ).alias("b")).select(*by, "b.*")


def detected_spheres(points: DataFrame, p: DetectorParams, *, markers: Sequence[str] | None = None, keys: Sequence[str] = ("sample_id",), radius_first: bool = False, keep_cell: bool = True, candidates: DataFrame | None = None) -> DataFrame:
    """Spheres of the density clusters of every marker, with features, in one job for all markers.

    Columns: keys, gene, sphere_id (the cluster's least central id), sphere_x, sphere_y, sphere_z, layer_z, sphere_r, size,
    comp, in_soma_ratio, cell_id. Clusters with fewer than ``low_bound`` distinct positions are dropped. size is the members,
    copies included, and the other markers' points in the sphere; comp the distinct markers among these; in_soma_ratio
    the share in nuclei. With ``merge_genes`` all markers cluster as one, and size, comp and in_soma_ratio are
    taken over all their points in the sphere. Thresholds are strict. A marker without points gives no rows. ``candidates``,
    if given, has all of the points that can be in a cluster, and both are written tables; only these are clustered.
    """
    k = list(keys)
    pts = points if markers is None else points.where(F.col("target").isin(*markers))
    pts = pts.withColumn("group", F.lit(p.merged_gene_label) if p.merge_genes else F.col("target"))
    pts = pts.select(*k, "tx_id", "target", "group", "overlaps_nucleus", "cell_id", *XYZ)
    if candidates is None:
        pts = written_once(pts, "points")  # read by every step below
        some = pts
    else:
        some = candidates.withColumn("group", F.lit(p.merged_gene_label) if p.merge_genes else F.col("target"))
    least = p.minspl if p.minspl is not None else least_points(pts.drop("target").withColumnRenamed("group", "target"), p, k).withColumnRenamed("target", "group")
    found = density_clusters(some, eps=p.eps, least=least, groups=[*k, "group"], written=True)
    by = [*k, "group", "cluster"]
    members = found.join(some.select("tx_id", "overlaps_nucleus", *(["cell_id"] if keep_cell else []), *XYZ), "tx_id")
    if keep_cell:
        members = written_once(members, "members")
    spots = written_once(members.groupBy(*by, *XYZ).agg(F.count(F.lit(1)).alias("n"), F.sum("overlaps_nucleus").alias("soma")), "spots")
    stats = spots.groupBy(*by).agg(F.sum("n").alias("own"), F.sum("soma").alias("own_soma"), F.count(F.lit(1)).alias("places"))
    if keep_cell:
        stats = stats.join(members.groupBy(*by).agg(F.mode("cell_id", True).alias("cell_id")), by)
    balls = enclosing_balls(spots, by, least=p.low_bound, distinct=True)
    s = written_once(balls.join(stats, by).withColumnRenamed("cluster", "sphere_id"), "balls")
    inside = points_in_spheres(pts, s, keys=k, carry=["target", "group", "overlaps_nucleus"]).join(s.select("sphere_id", F.col("group").alias("own_group")), "sphere_id")
    if p.merge_genes:
        f = inside.groupBy("sphere_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target").alias("kinds"), F.sum("overlaps_nucleus").alias("soma"))
        s = s.join(f, "sphere_id").withColumns({"size": F.col("n"), "comp": F.col("kinds"), "soma": F.col("soma")})
    else:
        f = inside.where("group <> own_group").groupBy("sphere_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target").alias("kinds"), F.sum("overlaps_nucleus").alias("soma"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        s = s.join(f, "sphere_id", "left").withColumns({"size": F.col("own") + zero("n"), "comp": 1 + zero("kinds"), "soma": zero("own_soma") + zero("soma")})
    s = s.withColumn("in_soma_ratio", F.col("soma") / F.col("size")).withColumn("layer_z", nearest_plane(F.col("sphere_z"), list(p.planes)))
    s = s.where(kept(F.col("sphere_r"), F.col("in_soma_ratio"), p.size_thr, p.in_soma_thr, strict=not radius_first))
    return s.select(*k, F.col("group").alias("gene"), "sphere_id", "sphere_x", "sphere_y", "sphere_z", "layer_z", "sphere_r", F.col("size").cast("double").alias("size"), F.col("comp").cast("double").alias("comp"), "in_soma_ratio", *(["cell_id"] if keep_cell else []))


def control_filter(spheres: DataFrame, points: DataFrame, controls: DataFrame, p: DetectorParams, *, keys: Sequence[str] = ("sample_id",), all_controls: bool = False) -> DataFrame:
    """``spheres`` with nc_ratio, the readings of the ``nc_top`` commonest controls around the layer centre over size.

    Kept are those with none, or a ratio strictly under ``nc_thr``; without a threshold all. Ties in count go by gene.
    """
    c = points.join(controls.select(F.col("gene").alias("target")).distinct(), "target", "left_semi")
    if not all_controls:
        top = c.groupBy("target").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "target").limit(p.nc_top)
        c = c.join(top.select("target"), "target", "left_semi")
    n = points_in_spheres(c, spheres, keys=keys, sphere_xyz=("sphere_x", "sphere_y", "layer_z")).groupBy("sphere_id").agg(F.count(F.lit(1)).alias("__n"))
    out = spheres.join(n, "sphere_id", "left").withColumn("nc_ratio", F.coalesce("__n", F.lit(0)) / F.col("size"))
    if p.nc_thr is not None:
        out = out.where((F.col("nc_ratio") == 0) | (F.col("nc_ratio") < p.nc_thr))
    return out.drop("__n")


def gene_ranking(spheres: DataFrame, share: float = 0.99) -> DataFrame:
    """(gene, n, cum, kept): genes by number of spheres, with the running sum, and which reach ``share`` of all."""
    n = spheres.groupBy("gene").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1))
    n = n.withColumns({"cum": F.sum("n").over(w.orderBy(F.desc("n"), "gene").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(w)})
    return n.select("gene", "n", "cum", (F.col("cum") - F.col("n") < share * F.col("total")).alias("kept"))


def profile(points: DataFrame, spheres: DataFrame, *, buffer: float = 0.0, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """(sphere_id, target, n): readings of each gene within the radius plus ``buffer`` of each layer centre, as a long table."""
    wide = spheres.withColumn("__reach", F.col("sphere_r") + buffer)
    return points_in_spheres(points, wide, keys=keys, sphere_xyz=("sphere_x", "sphere_y", "layer_z"), radius="__reach", carry=["target"]).groupBy("sphere_id", "target").agg(F.count(F.lit(1)).alias("n"))
