"""Boxes, nearest neighbours, touching spheres and regular grids, as equi-joins on grid cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctum.functions.geometry import distance
from punctum.functions.names import finite
from punctum.operators.proximity import SLACK
from punctum.plans.shared import cut

_EDGES = {
    "open": lambda v, lo, hi: (v > lo) & (v < hi),
    "half": lambda v, lo, hi: (v >= lo) & (v < hi),
    "closed": lambda v, lo, hi: (v >= lo) & (v <= hi),
}


def _covered(lo: Column, hi: Column, width: Column | float) -> Column:
    return F.explode(F.sequence(F.floor(lo / width - SLACK), F.floor(hi / width + SLACK)))


def points_in_boxes(points: DataFrame, boxes: DataFrame, *, point_id: str, box_id: str, width: float, edges: str, keys: Sequence[str] = (), point_xy: Sequence[str] = ("global_x", "global_y"), box_xy: Sequence[str] = ("global_x", "global_y"), carry: Sequence[str] = ()) -> DataFrame:
    """(box_id, point_id, *carry) of all points in squares of ``width`` around centres: edges "open", "half" ([lo, hi)) or "closed".

    A point may lie in several boxes. Positions that aren't finite and NULL keys match nothing.
    """
    inside, keys, h = _EDGES[edges], list(keys), width / 2
    p = points.select(*keys, F.col(point_id).alias("pid"), *(F.col(c).cast("double").alias(n) for c, n in zip(point_xy, ("px", "py"))), *(F.col(c).alias(f"c_{c}") for c in carry))
    b = boxes.select(*keys, F.col(box_id).alias("bid"), *(F.col(c).cast("double").alias(n) for c, n in zip(box_xy, ("bx", "by")))).distinct()
    p = p.where(finite(F.col("px")) & finite(F.col("py"))).withColumns({"ix": F.floor(F.col("px") / width), "iy": F.floor(F.col("py") / width)})
    b = b.where(finite(F.col("bx")) & finite(F.col("by")))
    for n, c in (("ix", "bx"), ("iy", "by")):
        b = b.withColumn(n, _covered(F.col(c) - h, F.col(c) + h, width))
    hit = p.join(b, [*keys, "ix", "iy"]).where(inside(F.col("px"), F.col("bx") - h, F.col("bx") + h) & inside(F.col("py"), F.col("by") - h, F.col("by") + h))
    return hit.select(F.col("bid").alias(box_id), F.col("pid").alias(point_id), *(F.col(f"c_{c}").alias(c) for c in carry)).distinct()


def first_box(pairs: DataFrame, *, point_id: str, box_id: str) -> DataFrame:
    """Each point with the least of its boxes."""
    return pairs.groupBy(point_id).agg(F.min(box_id).alias(box_id))


def touching_spheres(a: DataFrame, b: DataFrame, *, keys: Sequence[str] = ("sample_id",), scale: float = 1.0, cell: float = 8.0) -> DataFrame:
    """(a_id, b_id, distance) of spheres whose x-y boxes meet and whose centres are under ``scale`` times the sum of radii apart.

    Both sides have keys, sphere_id, sphere_x, sphere_y, sphere_z, sphere_r. Boxes meet with their edges included. Spheres
    wider than ``cell`` sit on coarser levels, each four times as wide as the one before it, so that none covers more than a few
    cells; a pair meets on the coarser level of the two, and spheres are repeated only for levels that occur.
    """
    keys = list(keys)
    cols = ("sphere_id", "sphere_x", "sphere_y", "sphere_z", "sphere_r")
    sides = []
    for df, s in ((a, "a"), (b, "b")):
        side = df.select(*keys, *(F.col(c).alias(f"{s}_{c}") for c in cols))
        sides.append(side.withColumn(f"{s}_level", F.greatest(F.ceil(F.log(4.0, F.col(f"{s}_sphere_r") / cell)), F.lit(0)).cast("int")))
    used = sorted({r[0] for side, s in zip(sides, "ab") for r in side.where(f"{s}_level IS NOT NULL").select(f"{s}_level").distinct().collect()})
    for i, s in enumerate("ab"):
        side = sides[i].withColumn("level", F.explode(F.array(*map(F.lit, used)) if used else F.array(F.lit(0)))).where(f"level >= {s}_level")
        width = F.lit(cell) * F.pow(F.lit(4.0), F.col("level").cast("double"))
        for n, c in (("ix", "sphere_x"), ("iy", "sphere_y")):
            side = side.withColumn(n, _covered(F.col(f"{s}_{c}") - F.col(f"{s}_sphere_r"), F.col(f"{s}_{c}") + F.col(f"{s}_sphere_r"), width))
        sides[i] = side
    reach = F.col("a_sphere_r") + F.col("b_sphere_r")
    meet = (F.abs(F.col("a_sphere_x") - F.col("b_sphere_x")) <= reach) & (F.abs(F.col("a_sphere_y") - F.col("b_sphere_y")) <= reach)
    d = distance(*((F.col(f"a_{c}"), F.col(f"b_{c}")) for c in cols[1:4]))
    pairs = sides[0].join(sides[1], [*keys, "level", "ix", "iy"]).where(F.col("level") == F.greatest("a_level", "b_level")).where(meet & (d < scale * reach))
    return pairs.select(F.col("a_sphere_id").alias("a_id"), F.col("b_sphere_id").alias("b_id"), d.alias("distance")).distinct()


_AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def _nearest_of(left: DataFrame, right: DataFrame, keys: list[str], dims: int, k: int, cell: float, levels: Sequence[int], *, bound: Column | None = None, not_self: bool = False) -> DataFrame:
    """(keys, lid, rid, distance, place): the ``k`` nearest within the 3 x 3 cells around each left row on its level."""
    width = F.lit(float(cell)) * F.pow(F.lit(4.0), F.col("level").cast("double"))
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _AROUND))
    at = left.withColumn("o", F.explode(offsets)).withColumns({"ix": F.floor(F.col("l0") / width) + F.col("o.i"), "iy": F.floor(F.col("l1") / width) + F.col("o.j")}).drop("o")
    here = right.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumns({"ix": F.floor(F.col("r0") / width), "iy": F.floor(F.col("r1") / width)})
    pairs = at.join(here, [*keys, "level", "ix", "iy"]).withColumn("distance", distance(*((F.col(f"l{i}"), F.col(f"r{i}")) for i in range(dims))))
    if bound is not None:
        pairs = pairs.where(bound)
    if not_self:
        pairs = pairs.where("lid <> rid")
    # the rank is limited before the shuffle, so no row's candidates are gathered
    place = F.row_number().over(Window.partitionBy(*keys, "lid").orderBy("distance", "rid"))
    return pairs.select(*keys, "lid", "rid", "distance").withColumn("place", place).where(F.col("place") <= k)


def nearest(left: DataFrame, right: DataFrame, k: int, *, left_id: str, right_id: str, keys: Sequence[str] = (), left_xyz: Sequence[str], right_xyz: Sequence[str], cell: float, within: float | None = None, not_self: bool = False) -> DataFrame:
    """(left_id, right_id, distance, place) of the ``k`` nearest on the right of every row on the left, by distance, then right_id.

    Counts of cells tell the finest level, each four times as wide as the one before it, on which the 3 x 3 cells around a
    row hold ``k`` rows; these alone are compared. Their k-th distance bounds the true one, so a row whose bound is wider
    than its cells is compared once more, on the level that reaches it, within the bound. ``within`` takes only
    distances strictly below it. Rows repeat nothing; if both ids have one name the right one comes out as
    ``other_<name>``, and ``not_self`` leaves equal ids out.
    """
    keys = list(keys)
    out_id = f"other_{right_id}" if right_id == left_id else right_id
    dims = len(left_xyz)
    sides = []
    for df, ident, xyz, s in ((left, left_id, left_xyz, "l"), (right, right_id, right_xyz, "r")):
        side = df.select(*keys, F.col(ident).alias(f"{s}id"), *(F.col(c).cast("double").alias(f"{s}{i}") for i, c in enumerate(xyz))).distinct()
        for i in range(dims):
            side = side.where(finite(F.col(f"{s}{i}")))
        sides.append(side)
    named = [F.col("lid").alias(left_id), F.col("rid").alias(out_id), "distance", "place"]
    if within:
        near = _nearest_of(sides[0].withColumn("level", F.lit(0)), sides[1], keys, dims, k, float(within), [0], bound=F.col("distance") < within, not_self=not_self)
        return near.select(*named)
    todo, rows = cut(sides[0]), cut(sides[1])
    ends = [df.agg(*(f(f"{s}{i}") for i in range(2) for f in (F.min, F.max))).first() for df, s in ((todo, "l"), (rows, "r"))]
    extent = 0.0 if any(e[0] is None for e in ends) else max(max(e[2 * i + 1] for e in ends) - min(e[2 * i] for e in ends) for i in range(2))
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _AROUND))
    seeds, level, used = None, 0, []
    while True:
        width = float(cell) * 4.0**level
        last = width > extent
        here, rest = todo, None
        if not last:
            n = rows.groupBy(*keys, F.floor(F.col("r0") / width).alias("ix"), F.floor(F.col("r1") / width).alias("iy")).agg(F.count(F.lit(1)).alias("n"))
            at = todo.select(*keys, "lid", F.floor(F.col("l0") / width).alias("cx"), F.floor(F.col("l1") / width).alias("cy"), F.explode(offsets).alias("o"))
            at = at.select(*keys, "lid", (F.col("cx") + F.col("o.i")).alias("ix"), (F.col("cy") + F.col("o.j")).alias("iy"))
            enough = cut(at.join(n, [*keys, "ix", "iy"]).groupBy(*keys, "lid").agg(F.sum("n").alias("n")).where(F.col("n") >= k + int(not_self)).drop("n"))
            here, rest = todo.join(enough, [*keys, "lid"], "left_semi"), cut(todo.join(enough, [*keys, "lid"], "left_anti"))
        here = here.withColumn("level", F.lit(level))
        seeds = here if seeds is None else seeds.unionByName(here)
        used.append(level)
        if last or rest.isEmpty():
            break
        todo, level = rest, level + 1
    seeds = cut(seeds)
    ranked = cut(_nearest_of(seeds, rows, keys, dims, k, cell, used, not_self=not_self))
    top = 0
    while float(cell) * 4.0**top <= extent:
        top += 1
    reach = F.lit(float(cell)) * F.pow(F.lit(4.0), F.col("level").cast("double"))
    wide = seeds.join(ranked.where(F.col("place") == k).select(*keys, "lid", F.col("distance").alias("most")), [*keys, "lid"]).where((F.col("most") > reach) & (F.col("level") < top))
    wide = cut(wide.withColumn("level", F.least(F.ceil(F.log(4.0, F.col("most") / F.lit(float(cell))) + 1e-9), F.lit(top)).cast("int")))
    again = sorted(r[0] for r in wide.select("level").distinct().collect())  # levels, as few as the extent has
    if again:
        more = _nearest_of(wide, rows, keys, dims, k, cell, again, bound=F.col("distance") <= F.col("most"), not_self=not_self)
        ranked = ranked.join(wide.select(*keys, "lid").distinct(), [*keys, "lid"], "left_anti").unionByName(more)
    return ranked.select(*named)


def grid_bounds(points: DataFrame, width: float, keys: Sequence[str] = (), x: str = "global_x", y: str = "global_y") -> DataFrame:
    """(keys, x0, nx, y0, ny): lower edges and numbers of cells of the grid that covers all positions."""
    lo = [F.floor(F.min(c) / width) * width for c in (x, y)]
    n = [F.greatest(F.ceil(F.max(c) / width) - F.floor(F.min(c) / width), F.lit(1)) for c in (x, y)]
    return points.groupBy(*keys).agg(lo[0].alias("x0"), n[0].alias("nx"), lo[1].alias("y0"), n[1].alias("ny"))


def on_grid(points: DataFrame, width: float, keys: Sequence[str] = (), x: str = "global_x", y: str = "global_y") -> DataFrame:
    """``points`` with ix, iy, nx, ny, x0, y0; the last cell takes the far edge in."""
    g = grid_bounds(points, width, keys, x, y)
    joined = points.join(g, list(keys)) if keys else points.crossJoin(g)
    bin_ = lambda c, lo, n: F.least(F.floor((F.col(c) - F.col(lo)) / width), F.col(n) - 1)
    return joined.withColumns({"ix": bin_(x, "x0", "nx"), "iy": bin_(y, "y0", "ny")})


def occupied_area(points: DataFrame, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, area): the number of occupied grid cells times their size."""
    return on_grid(points, width, keys).groupBy(*keys).agg((F.countDistinct("ix", "iy") * F.lit(width * width)).alias("area"))


def grid_counts(points: DataFrame, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, spot, global_x, global_y, n) of every cell of the grid, empty ones too, numbered along y first."""
    g = grid_bounds(points, width, keys)
    cells = g.select(*keys, "x0", "y0", "ny", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1)).alias("ix")).withColumn("iy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)))
    n = on_grid(points, width, keys).groupBy(*keys, "ix", "iy").agg(F.count(F.lit(1)).alias("n"))
    out = cells.join(n, [*keys, "ix", "iy"], "left")
    return out.select(*keys, (F.col("ix") * F.col("ny") + F.col("iy")).alias("spot"), (F.col("x0") + (F.col("ix") + 0.5) * width).alias("global_x"), (F.col("y0") + (F.col("iy") + 0.5) * width).alias("global_y"), F.coalesce("n", F.lit(0)).alias("n"))


def grid_expression(points: DataFrame, width: float, keys: Sequence[str] = (), gene: str = "target") -> DataFrame:
    """(keys, spot, gene, n): points of each gene in each cell of the grid of ``grid_counts``, which lists the empty cells too."""
    n = on_grid(points, width, keys).groupBy(*keys, (F.col("ix") * F.col("ny") + F.col("iy")).alias("spot"), gene)
    return n.agg(F.count(F.lit(1)).alias("n"))


def density_maxima(points: DataFrame, width: float, keys: Sequence[str], *, sigma: float, least: float) -> DataFrame:
    """(keys, ix, iy, density): grid cells whose smoothed density reaches ``least`` and is the greatest of the 3 x 3 around them.

    Counts are smoothed with a Gaussian of ``sigma`` cells over two cells to each side. Of equal neighbours the one
    first in (ix, iy) stays. Only occupied cells and their neighbours are ever formed.
    """
    k = list(keys)
    n = points.groupBy(*k, F.floor(F.col("global_x") / width).alias("ix"), F.floor(F.col("global_y") / width).alias("iy")).agg(F.count(F.lit(1)).alias("n"))
    around = lambda r: F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-r, r + 1) for j in range(-r, r + 1)))
    w = F.exp(-(F.col("o.i") * F.col("o.i") + F.col("o.j") * F.col("o.j")) / (2.0 * sigma * sigma))
    smooth = n.withColumn("o", F.explode(around(2))).select(*k, (F.col("ix") + F.col("o.i")).alias("ix"), (F.col("iy") + F.col("o.j")).alias("iy"), (F.col("n") * w).alias("v"))
    smooth = smooth.groupBy(*k, "ix", "iy").agg(F.round(F.sum("v"), 9).alias("density"))
    best = smooth.withColumn("o", F.explode(around(1))).select(*k, (F.col("ix") + F.col("o.i")).alias("ix"), (F.col("iy") + F.col("o.j")).alias("iy"), F.struct("density", (-F.col("o.i")).alias("i"), (-F.col("o.j")).alias("j")).alias("s"))
    # seen from a cell, a neighbour lies at -o; the greatest density wins, then the first neighbour
    best = best.groupBy(*k, "ix", "iy").agg(F.max(F.struct(F.col("s.density").alias("density"), (-F.col("s.i")).alias("i"), (-F.col("s.j")).alias("j"))).alias("b"))
    return best.where("b.i = 0 AND b.j = 0 AND b.density >= " + repr(float(least))).select(*k, "ix", "iy", F.col("b.density").alias("density"))


def subdivided(tiles: DataFrame, *, tile_id: str, width: float, into: float) -> DataFrame:
    """Each tile cut into four of half the width, numbered q0 to q3 along x first."""
    h = into / 2
    corners = [(-h, -h), (h, -h), (-h, h), (h, h)]
    if abs(width - 2 * into) > 1e-9:
        raise ValueError("a tile is cut into four of half its width")
    parts = F.array(*(F.struct(F.lit(f"_{into:g}um_q{i}").alias("s"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(corners)))
    rest = [c for c in tiles.columns if c not in (tile_id, "global_x", "global_y")]
    t = tiles.withColumn("part", F.explode(parts))
    return t.select(F.concat(F.col(tile_id), F.col("part.s")).alias(tile_id), (F.col("global_x") + F.col("part.dx")).alias("global_x"), (F.col("global_y") + F.col("part.dy")).alias("global_y"), *rest)


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", *, many_left: bool = False) -> DataFrame:
    """Equi-join that raises ValueError if a key repeats on the right, or on the left unless ``many_left``."""
    for df, side in ((right, "right"), *((left, "left"),) * (not many_left)):
        if not df.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"keys {list(keys)} repeat on the {side}")
    return left.join(right, list(keys), how)
