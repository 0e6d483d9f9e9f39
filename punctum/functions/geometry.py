"""Column expressions of geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(*pairs: tuple[Column, Column]) -> Column:
    """Euclidean distance over any number of coordinate pairs."""
    return F.sqrt(sum((F.pow(a - b, 2) for a, b in pairs[1:]), F.pow(pairs[0][0] - pairs[0][1], 2)))


def rotated(x: Column, y: Column, radians: float) -> tuple[Column, Column]:
    """(x, y) turned by ``radians``: x cos + y sin, y cos - x sin."""
    c, s = math.cos(radians), math.sin(radians)
    return x * c + y * s, y * c - x * s


def flipped(v: Column, cutoff: float) -> Column:
    """``v`` mirrored so that ``cutoff`` becomes 0."""
    return F.lit(cutoff) - v


def half_plane(v: Column, cutoff: float, direction: str) -> Column:
    """True on the side named "smaller" or "larger", the cut itself included."""
    if direction not in ("smaller", "larger"):
        raise ValueError(f"direction {direction!r} is neither smaller nor larger")
    return v <= cutoff if direction == "smaller" else v >= cutoff


def pixel(v: Column, size: float, shift: int = 0) -> Column:
    """Pixel number of a position: the quotient cut towards 0, then shifted."""
    return (v / F.lit(float(size))).cast("int") + F.lit(shift)


def volume(r: Column) -> Column:
    return F.lit(4.0 / 3.0 * math.pi) * r * r * r


def shared_volume(d: Column, r1: Column, r2: Column) -> Column:
    """Volume that two spheres at distance ``d`` share: 0 if apart, the smaller one's if it lies inside."""
    a, b = F.least(r1, r2), F.greatest(r1, r2)
    lens = F.lit(math.pi) * F.pow(a + b - d, 2) * (d * d + 2.0 * d * (a + b) - 3.0 * F.pow(a - b, 2)) / (12.0 * d)
    return F.when(d >= a + b, 0.0).when(d <= b - a, volume(a)).otherwise(lens)


def nearest_plane(z: Column, planes: list[float]) -> Column:
    """The plane of ``planes`` next to ``z``, the lower one on ties; ``z`` itself without planes."""
    if not planes:
        return z
    return F.array_min(F.array(*(F.struct(F.abs(z - F.lit(p)).alias("d"), F.lit(p).alias("p")) for p in sorted(planes))))["p"]
