"""Spheres of several markers merged in marker order where they overlap.

The rules are sequential: the markers fold into one list, each sphere of the list meets the next marker's spheres in id
order, and what happens to one changes what the next one meets. Spheres that don't touch can't affect each other, so
the fold runs by itself within every connected group of touching spheres, all groups in parallel. Where a merged sphere
grows into another group, or beyond the points it was given, the groups concerned are joined and run again, with points
from twice as far out where these fell short, until no such group is left. Groups only ever join, so it ends.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctum.operators.density import smallest_ball
from punctum.operators.proximity import points_in_spheres
from punctum.operators.spatial import touching_spheres
from punctum.plans.components import components
from punctum.plans.shared import cut, forget

#: Points are first taken from so many radii around a sphere.
FACTOR = 3.0


@dataclass(frozen=True)
class MergeRule:
    """When two spheres merge: by "distance" (share rho of the radii's sum), or by "volume", "jaccard" or "dice" overlap.

    ``l`` scales the sum of radii, ``s`` the new radius, ``planes`` snap layer_z. ``refresh_layer`` moves layer_z on a merge.
    """

    by: str = "distance"
    threshold: float = 0.2
    l: float = 1.0  # noqa: E741
    s: float = 1.0
    planes: tuple[float, ...] = ()
    refresh_layer: bool = True


def simulation_rule(by: str, share: float, l: float = 1.0, s: float = 1.0, planes: tuple[float, ...] = ()) -> MergeRule:  # noqa: E741
    """The rule of the simulation study: spheres merge by distance at ``share``, by an overlap at (1 - ``share``) / ``l``."""
    return MergeRule(by=by, threshold=share if by == "distance" else (1.0 - share) / l, l=l, s=s, planes=planes)


def _overlap(d: float, a: float, b: float) -> float:
    """Volume over 4/3 pi that two crossing spheres share."""
    return (a + b - d) ** 2 * (d * d + 2 * d * (a + b) - 3 * (a - b) ** 2) / (16 * d)


def _merges(rule: MergeRule, d: float, a: float, b: float) -> bool:
    if rule.by == "distance":
        return d < rule.threshold * rule.l * (a + b)
    shared, va, vb = _overlap(d, a, b), a**3, b**3
    ratio = {"volume": shared / min(va, vb), "jaccard": shared / (va + vb - shared), "dice": 2 * shared / (va + vb)}[rule.by]
    return ratio >= rule.threshold


def fold(spheres: pd.DataFrame, points: Callable[[str], np.ndarray], rule: MergeRule) -> pd.DataFrame:
    """The spheres that stay, markers folded in the order of ``marker_rank``, spheres in the order of ``sphere_id``.

    A larger sphere swallows one inside it; the smaller one takes the other's place in the list. Crossing spheres that
    merge become the smallest sphere of both genes' points in them and keep the first one's other columns. A sphere of the
    list meets its partners as it was when its turn came. ``points`` gives a gene's positions.
    """
    rows = spheres.sort_values(["marker_rank", "sphere_id"]).to_dict("records")
    kept: list[dict] = []
    xyz = ("sphere_x", "sphere_y", "sphere_z")
    inside = lambda s: (lambda p: p[((p - [s[c] for c in xyz]) ** 2).sum(axis=1) <= s["sphere_r"] ** 2])(points(s["gene"]))
    start = 0
    while start < len(rows):
        rank = rows[start]["marker_rank"]
        end = start
        while end < len(rows) and rows[end]["marker_rank"] == rank:
            end += 1
        new, start = rows[start:end], end
        for i, a in enumerate(list(kept)):
            state = a
            for b in list(new):
                reach = a["sphere_r"] + b["sphere_r"]
                if abs(a["sphere_x"] - b["sphere_x"]) > reach or abs(a["sphere_y"] - b["sphere_y"]) > reach:
                    continue
                d = float(np.sqrt(sum((a[c] - b[c]) ** 2 for c in xyz)))
                if d >= rule.l * reach:
                    continue
                if d <= rule.l * abs(a["sphere_r"] - b["sphere_r"]):
                    if a["sphere_r"] <= b["sphere_r"]:
                        state = dict(b)
                elif _merges(rule, d, a["sphere_r"], b["sphere_r"]):
                    both = np.vstack([inside(a), inside(b)])
                    if len(both):
                        centre, r = smallest_ball(both)
                        z = centre[2] if not rule.planes else min(sorted(rule.planes), key=lambda p: abs(p - centre[2]))
                        state = dict(state) | dict(zip(xyz, map(float, centre))) | {"sphere_r": rule.s * r} | ({"layer_z": float(z)} if rule.refresh_layer else {})
                else:
                    continue
                new.remove(b)
            kept[i] = state
        kept += new
    return pd.DataFrame(kept, columns=spheres.columns)


def merged_spheres(spheres: DataFrame, points: DataFrame, rule: MergeRule = MergeRule(), *, order: Sequence[str] | None = None, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """``spheres`` (keys, gene, sphere_id, sphere_x, ...) after the fold over markers in ``order``, by name if none is given.

    Of ``points`` (keys, tx_id, target, positions) those of a sphere's own gene count. Columns of a merged sphere other than
    centre, layer_z and radius stay those of the first one. A group of touching spheres is worked on in one task; groups
    are as large as aggregates that touch. Spheres of one marker don't meet each other.
    """
    k = list(keys)
    if order is None:
        rank = F.col("gene")
        s = spheres.withColumn("marker_rank", rank)
    else:
        table = F.create_map(*(F.lit(x) for i, g in enumerate(order) for x in (g, i)))
        s = spheres.withColumn("marker_rank", F.element_at(table, F.col("gene"))).where("marker_rank IS NOT NULL")
    s = cut(s)
    columns = s.columns
    touch = touching_spheres(s, s, keys=k, scale=max(rule.l, 1.0)).where("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    edges, s, kept, todo = cut(touch), s.withColumn("__factor", F.lit(FACTOR)), None, None
    while True:
        group = components(edges)
        grouped = cut(s.join(group, s["sphere_id"] == group["node"], "left").withColumn("grp", F.coalesce("root", "sphere_id")).drop("node", "root"))
        many = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp")
        if todo is None:
            kept = grouped.join(many, "grp", "left_anti").drop("__factor")
        else:
            many = grouped.join(todo, "sphere_id", "left_semi").select("grp").distinct()
        work = grouped.join(many, "grp", "left_semi")
        out = grouped.drop("__factor").schema
        near = points_in_spheres(points, work.withColumn("__reach", F.col("sphere_r") * F.col("__factor")), keys=k, radius="__reach", carry=["target", "global_x", "global_y", "global_z"])
        own = near.join(work.select("sphere_id", "grp"), "sphere_id").join(work.select("grp", F.col("gene").alias("target")).distinct(), ["grp", "target"], "left_semi").select("grp", "tx_id", "target", "global_x", "global_y", "global_z").distinct()
        own = cut(own)

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            by_gene = {g: p[["global_x", "global_y", "global_z"]].to_numpy() for g, p in right.groupby("target")} if len(right) else {}
            none = np.zeros((0, 3))
            result = fold(left.drop(columns="__factor"), lambda g: by_gene.get(g, none), rule)
            centre = left[["sphere_x", "sphere_y", "sphere_z"]].to_numpy()
            c = result[["sphere_x", "sphere_y", "sphere_z"]].to_numpy()
            d = np.sqrt(((c[:, None] - centre[None]) ** 2).sum(axis=2)) + result["sphere_r"].to_numpy()[:, None]
            result["covered"] = (d <= (left["sphere_r"] * left["__factor"]).to_numpy()[None] + 1e-9).any(axis=1)
            return result

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)
        done = cut(work.groupBy("grp").cogroup(own.groupBy("grp")).applyInPandas(run, f"{schema}, covered boolean"))
        forget(own)
        grown = done.drop("covered")
        across = touching_spheres(grown, grouped, keys=k, scale=max(rule.l, 1.0)).join(grown.select(F.col("sphere_id").alias("a_id"), F.col("grp").alias("ga")), "a_id").join(grouped.select(F.col("sphere_id").alias("b_id"), F.col("grp").alias("gb")), "b_id")
        across = cut(across.where("ga <> gb").select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct())
        short = done.where("NOT covered").select("grp").distinct()
        again = cut(across.select(F.col("a").alias("grp")).unionByName(across.select(F.col("b").alias("grp"))).unionByName(short).distinct())
        whole = kept.unionByName(grown)
        if again.isEmpty():
            break
        kept = cut(whole.join(again, "grp", "left_anti"))
        todo = cut(grouped.join(again, "grp", "left_semi").select("sphere_id"))
        more = short.withColumn("__more", F.lit(2.0))
        s = cut(grouped.join(more, "grp", "left").withColumn("__factor", F.col("__factor") * F.coalesce("__more", F.lit(1.0))).drop("grp", "__more"))
        edges = cut(edges.unionByName(across).distinct())
    return whole.select(*columns).drop("marker_rank")
