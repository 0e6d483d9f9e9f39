"""Square tiles with a rim of neighbouring points, each small enough for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctum.plans.shared import cut, forget, written_once

#: A crowded tile is cut into so many tiles along each axis.
SPLIT = 4


def tile_widths(width: float, rim: float) -> list[float]:
    """Width of the tiles of each level: whole, whole but block by block, then cut up as far as they stay as wide as the rim."""
    out = [width, width]
    while out[-1] / SPLIT >= rim:
        out.append(out[-1] / SPLIT)
    return out


def _tiles(level: int, w: float, rim: float) -> Column:
    """All tiles of a level whose square, widened by ``rim``, holds the point."""
    span = lambda c: F.sequence(F.floor((F.col(c) - rim) / w), F.floor((F.col(c) + rim) / w))
    pair = lambda tx: F.transform(span("y"), lambda ty: F.struct(F.lit(level).alias("level"), tx.alias("tx"), ty.alias("ty")))
    return F.flatten(F.transform(span("x"), pair))


def _crowded(points: DataFrame, keys: list[str], w: float, most: int) -> DataFrame:
    at = points.select(*keys, F.floor(F.col("x") / w).alias("tx"), F.floor(F.col("y") / w).alias("ty"))
    return cut(at.groupBy(*keys, "tx", "ty").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).drop("n"))


def _placed(points: DataFrame, level: int, w: float, rim: float) -> DataFrame:
    return points.withColumn("tile", F.explode(_tiles(level, w, rim))).select("*", "tile.*").drop("tile")


def tiled(points: DataFrame, keys: Sequence[str], *, block: str, row_id: str, width: float, rim: float, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows, collapsed): ``points`` (x, y, z, copies, ...) with columns part, level, tx, ty, and what they became first.

    A row comes once for each tile whose square, widened by ``rim``, holds it. Tiles are ``width`` wide and hold all blocks
    (part is empty). Where no tile has more than ``most`` rows, which one aggregation tells, that is all, and ``collapsed``
    is None. Else rows of one ``row_id`` and then points of one block at one position become one row, that of the least id, with
    their number in copies; tiles that are crowded even so are taken block by block (part is the block), then cut into
    ``SPLIT`` x ``SPLIT`` ones, again and again while they stay as wide as the rim. No list of tiles goes to the driver.
    """
    keys = list(keys)
    widths = tile_widths(width, rim)
    whole = points.withColumn("part", F.lit(""))
    crowded = _crowded(points, keys, width, most)
    none = crowded.isEmpty()
    forget(crowded)
    if none:
        return _placed(whole, 0, width, rim), None
    place = [*keys, block, "x", "y", "z"]
    rest = [c for c in points.columns if c not in (*place, row_id, "copies")]
    once = points.select(*place, row_id, *rest).distinct()
    collapsed = written_once(once.groupBy(*place).agg(F.min(row_id).alias(row_id), F.count(F.lit(1)).alias("copies"), *(F.min(c).alias(c) for c in rest)), "positions")
    whole, parted = collapsed.withColumn("part", F.lit("")), collapsed.withColumn("part", F.col(block))
    above, out = None, None
    for level, w in enumerate(widths):
        by = [*keys, *(["part"] if level else [])]
        source = parted if level else whole
        here = _placed(source, level, w, rim)
        if above is not None:
            wider, up_by = above
            ratio = widths[level - 1] / w
            up = wider.select(*up_by, F.col("tx").alias("ux"), F.col("ty").alias("uy"))
            inside = lambda df: df.withColumns({"ux": F.floor(F.col("tx") / ratio), "uy": F.floor(F.col("ty") / ratio)}).join(up, [*up_by, "ux", "uy"], "left_semi").drop("ux", "uy")  # noqa: E731, B023
            here = inside(here)
        if level < len(widths) - 1:
            crowded = _crowded(source, by, w, most)
            if above is not None:
                crowded = cut(inside(crowded))
            more = not crowded.isEmpty()
            if more:
                here = here.join(crowded, [*by, "tx", "ty"], "left_anti")
        else:
            more = False
        out = here if out is None else out.unionByName(here)
        if not more:
            break
        above = (crowded, by)
    return out, collapsed
