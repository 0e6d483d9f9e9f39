"""Points inside spheres, near other points, or inside polygon regions, by crossing parity.

A ray runs from every point towards +x. A region holds the point if the ray crosses its boundary an odd number of
times. Boundaries, the edges of a polygon or the two arcs that a sphere shows to a ray, are cut into strips of y and, so
that a strip of a wide data set is not one bucket, into columns of x. A point meets only the pieces of its own strip and
column, by a plain equi-join, and its crossings are summed by point and region. Points on a boundary are decided by an
explicit comparison, never by the parity.

Null, NaN or infinite coordinates, radii or keys match nothing. Empty inputs give empty results. Extra columns are
ignored. Repeated rows of a point or a region count once, because results are distinct.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctum.functions.names import finite

#: A level of the grid holds the regions that reach over at most so many cells to either side.
REACH = 12
#: Cell width of a level over that of the level before it.
STEP = 64.0
#: Relative widening of cell ranges, so that rounding cannot lose a boundary cell.
SLACK = 1e-9
#: Widening of squared chords over squared radii, for the same reason.
CHORD_SLACK = 1e-12


def _range(lo: Column, hi: Column, width: Column) -> Column:
    return F.sequence(F.floor(lo / width - SLACK), F.floor(hi / width + SLACK))


def _level(half: Column, cell: float) -> Column:
    """Level of a region that reaches ``half`` to either side; 0 for all small ones, and as high as the largest needs."""
    return F.when(half <= REACH * cell, 0).otherwise(F.ceil(F.log(half / (REACH * cell)) / math.log(STEP)).cast("int"))


def _width(cell: float) -> Column:
    return F.lit(float(cell)) * F.pow(F.lit(STEP), F.col("level").cast("double"))


def _used(regions: DataFrame) -> list[int]:
    """The levels that occur, a handful even for radii of all sizes a double can hold."""
    return sorted(r[0] for r in regions.select("level").distinct().collect())


def _placed(points: DataFrame, used: list[int], cell: float) -> DataFrame:
    """``points`` (px, py) with strip and column on each level in ``used``."""
    if used in ([0], []):
        return points.withColumns({"level": F.lit(0), "strip": F.floor(F.col("py") / cell), "column": F.floor(F.col("px") / cell)})
    points = points.withColumn("level", F.explode(F.array(*map(F.lit, used))))
    return points.withColumns({n: F.floor(F.col(c) / _width(cell)) for n, c in (("strip", "py"), ("column", "px"))})


def sphere_arcs(spheres: DataFrame, cell: float) -> DataFrame:
    """The arcs of spheres (cx, cy, cz, r) by level, strip and column; ``out`` is 1 on the right arc and -1 on the left one.

    A ray leaves the sphere through its right arc and enters it through its left one. The right arc is met by points
    from the chord's left end to its right end; the left arc by those up to the centre, as a ray from beyond doesn't cross it.
    Points left of both cross both, so there is no need to meet them. Chords are those of the strip, the widest in it.
    """
    s = spheres.withColumn("level", _level(F.col("r"), cell)).withColumn("width", _width(cell))
    s = s.withColumn("strip", F.explode(_range(F.col("cy") - F.col("r"), F.col("cy") + F.col("r"), F.col("width"))))
    off = F.greatest(F.lit(0.0), F.col("strip") * F.col("width") - F.col("cy"), F.col("cy") - (F.col("strip") + 1) * F.col("width"))
    share = off / F.nullif(F.col("r"), F.lit(0.0))
    chord = F.col("r") * F.sqrt(F.greatest(1 - share * share, F.lit(0.0)) + CHORD_SLACK)
    s = s.withColumn("half", F.coalesce(chord, F.lit(0.0)))
    arc = lambda out, end: F.transform(_range(F.col("cx") - F.col("half"), end, F.col("width")), lambda c: F.struct(F.lit(out).alias("out"), c.alias("column")))
    s = s.withColumn("arc", F.explode(F.concat(arc(1, F.col("cx") + F.col("half")), arc(-1, F.col("cx")))))
    return s.select("*", "arc.*").drop("arc", "width", "half")


def crosses_arc() -> Column:
    """True if the ray of point (px, py, pz) crosses the arc ``out`` of the sphere (cx, cy, cz, r).

    Squares are compared, so the surface is exact wherever squares of the coordinates are. A point on the right arc
    crosses it, one on the left arc doesn't, which takes the whole surface in.
    """
    dx = F.col("px") - F.col("cx")
    half = F.col("r") * F.col("r") - F.pow(F.col("py") - F.col("cy"), 2) - F.pow(F.col("pz") - F.col("cz"), 2)
    right = (dx <= 0) | (dx * dx <= half)
    left = (dx < 0) & (dx * dx > half)
    return (half >= 0) & F.when(F.col("out") > 0, right).otherwise(left)


def points_in_spheres(
    points: DataFrame,
    spheres: DataFrame,
    *,
    point_id: str = "tx_id",
    sphere_id: str = "sphere_id",
    keys: Sequence[str] = ("sample_id",),
    point_xyz: Sequence[str] = ("global_x", "global_y", "global_z"),
    sphere_xyz: Sequence[str] = ("sphere_x", "sphere_y", "sphere_z"),
    radius: str | float = "sphere_r",
    cell: float = 4.0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(sphere_id, point_id, *carry) for every point at most ``radius`` from a sphere's centre, the surface included.

    ``keys`` must be equal on both sides; ``carry`` names point columns to hand on. A negative radius covers nothing,
    a radius of 0 the points at the centre. Spheres far wider than ``cell`` sit on coarser levels, so that none is cut into
    an unbounded number of pieces; points are repeated only for levels that occur.

    Crossings are summed by point and sphere with their direction, out of the sphere 1 and into it -1. For one row of a
    point that is the parity, 1 or 0; unlike a plain count it stays right when rows of a point or sphere repeat.
    """
    r = F.col(radius) if isinstance(radius, str) else F.lit(float(radius))
    inner = [f"key_{i}" for i in range(len(keys))]
    key_cols = [F.col(k).alias(n) for k, n in zip(keys, inner)]
    xyz = lambda cols, names: [F.col(c).cast("double").alias(n) for c, n in zip(cols, names)]
    pts = points.select(*key_cols, F.col(point_id).alias("pid"), *xyz(point_xyz, ("px", "py", "pz")), *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)))
    sph = spheres.select(*key_cols, F.col(sphere_id).alias("sid"), *xyz(sphere_xyz, ("cx", "cy", "cz")), r.cast("double").alias("r"))
    for c in ("px", "py", "pz"):
        pts = pts.where(finite(F.col(c)))
    for c in ("cx", "cy", "cz", "r"):
        sph = sph.where(finite(F.col(c)))
    pts = pts.where(" AND ".join(f"{c} IS NOT NULL" for c in ("pid", *inner)))
    sph = sph.where(" AND ".join(f"{c} IS NOT NULL" for c in ("sid", *inner))).where("r >= 0").distinct()
    arcs = sphere_arcs(sph, cell)
    met = _placed(pts, _used(sph.select(_level(F.col("r"), cell).alias("level"))), cell).join(arcs, [*inner, "level", "strip", "column"]).where(crosses_arc())
    held = met.groupBy("sid", "pid", *(f"carry_{i}" for i in range(len(carry)))).agg(F.sum("out").alias("crossings")).where("crossings > 0")
    return held.select(F.col("sid").alias(sphere_id), F.col("pid").alias(point_id), *(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)))


def points_near_points(left: DataFrame, right: DataFrame, *, distance: float, left_id: str, right_id: str, left_xyz: Sequence[str], right_xyz: Sequence[str], keys: Sequence[str] = (), cell: float | None = None) -> DataFrame:
    """(left_id, right_id) of all pairs at most ``distance`` apart, the distance included; two coordinates mean a plane.

    If both ids have one name, the right one comes out as ``other_<name>``; a point is near itself then.
    """
    out = f"other_{right_id}" if left_id == right_id else right_id
    pad = lambda df, xyz: df if len(xyz) == 3 else df.withColumn("__flat", F.lit(0.0))
    spheres = pad(left, left_xyz)
    points = pad(right, right_xyz).withColumnRenamed(right_id, out)
    full = lambda xyz: (*xyz, "__flat")[:3]
    return points_in_spheres(points, spheres, point_id=out, sphere_id=left_id, keys=keys, point_xyz=full(right_xyz), sphere_xyz=full(left_xyz), radius=float(distance), cell=cell or max(float(distance), 1e-6) * 2)


def points_in_regions(
    points: DataFrame,
    edges: DataFrame,
    *,
    point_id: str,
    region_id: str = "region_id",
    keys: Sequence[str] = (),
    point_xy: Sequence[str] = ("global_x", "global_y"),
    cell: float,
    boundary: bool = True,
) -> DataFrame:
    """(region_id, point_id) of every point inside a polygon, given as edges (keys, region_id, x1, y1, x2, y2).

    Rings may be concave and may have holes; edges come in any order and direction. Edges are cut into strips of
    height ``cell``; a strip's piece reaches from the region's smallest x to the edge's largest, as points left of the
    region cross it evenly anyway. Regions far wider than ``cell`` sit on coarser levels, as spheres do. Crossings are
    summed by point and region before the parity is taken. With ``boundary`` points on an edge are in, else they are
    out; parity never decides them.
    """
    inner = [f"key_{i}" for i in range(len(keys))]
    key_cols = [F.col(k).alias(n) for k, n in zip(keys, inner)]
    coords = ("x1", "y1", "x2", "y2")
    e = edges.select(*key_cols, F.col(region_id).alias("rid"), *(F.col(c).cast("double").alias(c) for c in coords)).where("rid IS NOT NULL").distinct()
    p = points.select(*key_cols, F.col(point_id).alias("pid"), *(F.col(c).cast("double").alias(n) for c, n in zip(point_xy, ("px", "py")))).where("pid IS NOT NULL").distinct()
    keys = inner
    for c in coords:
        e = e.where(finite(F.col(c)))
    p = p.where(finite(F.col("px")) & finite(F.col("py")))
    ends = lambda v: (F.min(F.least(f"{v}1", f"{v}2")), F.max(F.greatest(f"{v}1", f"{v}2")))
    (x0, x1), (y0, y1) = ends("x"), ends("y")
    size = e.groupBy(*keys, "rid").agg(x0.alias("left"), (F.greatest(x1 - x0, y1 - y0) / 2).alias("half"))
    size = size.withColumn("level", _level(F.col("half"), cell)).drop("half")
    pieces = (
        e.join(size, [*keys, "rid"])
        .withColumn("width", _width(cell))
        .withColumn("strip", F.explode(_range(F.least("y1", "y2"), F.greatest("y1", "y2"), F.col("width"))))
        .withColumn("column", F.explode(_range(F.col("left"), F.greatest("x1", "x2"), F.col("width"))))
        .drop("left", "width")
    )
    p = _placed(p, _used(size), cell)
    side = (F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1")) - (F.col("px") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    on_edge = (side == 0) & F.col("px").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("py").between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    spans = (F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))
    crosses = spans & ((side > 0) == (F.col("y2") > F.col("y1"))) & (side != 0)
    found = (
        p.join(pieces, [*keys, "level", "strip", "column"])
        .groupBy("rid", "pid")
        .agg(F.sum(crosses.cast("int")).alias("crossings"), F.max(on_edge).alias("on_edge"))
    )
    odd = F.col("crossings") % 2 == 1
    keep = odd | F.col("on_edge") if boundary else odd & ~F.col("on_edge")
    return found.where(keep).select(F.col("rid").alias(region_id), F.col("pid").alias(point_id))
