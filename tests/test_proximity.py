import math
import random

import pytest
from pyspark.sql import functions as F

from punctum.operators.proximity import crosses_arc, points_in_regions, points_in_spheres, points_near_points, sphere_arcs
from punctum.catalog.spatial import touching_pairs
from punctum.operators.spatial import nearest, points_in_boxes

NAN, INF = float("nan"), float("inf")
P = "tx_id long, sample_id string, global_x double, global_y double, global_z double, px int, level string"
S = "sphere_id long, sample_id string, sphere_x double, sphere_y double, sphere_z double, sphere_r double, r string, sid int"


def found(spark, points, spheres, **kw):
    p = spark.createDataFrame([(*r, 1, "x") for r in points], P)
    s = spark.createDataFrame([(*r, "x", 1) for r in spheres], S)
    return sorted(map(tuple, points_in_spheres(p, s, **kw).collect()))


def test_surface_zero_radius_and_broken_values(spark):
    points = [(1, "a", 3.0, 4.0, 0.0), (2, "a", 3.0, 4.0, 0.0078125), (3, "a", 0.0, 0.0, 0.0), (3, "a", 0.0, 0.0, 0.0), (4, "b", 0.0, 0.0, 0.0), (5, "a", NAN, 0.0, 0.0), (6, "a", None, 0.0, 0.0), (7, "a", INF, 0.0, 0.0), (8, None, 0.0, 0.0, 0.0), (None, "a", 0.0, 0.0, 0.0)]
    spheres = [(10, "a", 0.0, 0.0, 0.0, 5.0), (10, "a", 0.0, 0.0, 0.0, 5.0), (11, "a", 0.0, 0.0, 0.0, 0.0), (12, "a", 0.0, 0.0, 0.0, -1.0), (13, "a", 0.0, 0.0, 0.0, NAN), (14, "a", 0.0, 0.0, 0.0, INF), (15, "a", 0.0, 0.0, None, 1.0), (16, None, 0.0, 0.0, 0.0, 9.0)]
    assert found(spark, points, spheres) == [(10, 1), (10, 3), (11, 3)]


def test_empty_sides(spark):
    assert found(spark, [], [(1, "a", 0.0, 0.0, 0.0, 1.0)]) == []
    assert found(spark, [(1, "a", 0.0, 0.0, 0.0)], []) == []


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs_with_radii_of_every_size(spark, seed):
    rng = random.Random(seed)
    grid = lambda lo, hi: rng.randint(lo * 128, hi * 128) / 128
    points = [(i, "a", grid(-300, 300), grid(-300, 300), grid(0, 9)) for i in range(400)]
    spheres = [(i, "a", grid(-300, 300), grid(-300, 300), grid(0, 9), rng.choice([0.5, 3.0, 20.0, 100.0, 5000.0, 1e9])) for i in range(40)]
    want = sorted((s[0], p[0]) for s in spheres for p in points if sum((s[k] - p[k]) ** 2 for k in (2, 3, 4)) <= s[5] ** 2)
    assert found(spark, points, spheres) == want


def test_arcs_are_cut_into_pieces_and_their_crossings_summed(spark):
    s = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0, 9.0)], "key string, sid long, cx double, cy double, cz double, r double")
    arcs = sphere_arcs(s, 4.0).collect()
    at = lambda out: {(r["strip"], r["column"]) for r in arcs if r["out"] == out}
    assert {y for y, _ in at(1)} == set(range(-3, 3)) and {(0, -3), (0, 2)} <= at(1) and (0, 2) not in at(-1) and at(-1) < at(1)
    assert (2, 2) not in at(1)  # the chord of the top strip is short
    # without the left arc a point left of the sphere would be taken for one inside
    left = spark.createDataFrame([(1, "a", -8.5, 4.0, 0.0, 1, "x"), (2, "a", -8.0, 4.0, 0.0, 1, "x")], P)
    one = spark.createDataFrame([(1, "a", 0.0, 0.0, 0.0, 9.0, "x", 1)], S)
    assert [r["tx_id"] for r in points_in_spheres(left, one).collect()] == [2]
    pieces = sphere_arcs(s, 4.0).where("out > 0")
    p = left.select(F.col("tx_id").alias("pid"), F.col("global_x").alias("px"), F.col("global_y").alias("py"), F.col("global_z").alias("pz"))
    assert p.crossJoin(pieces).where(crosses_arc()).select("pid").distinct().count() == 2


def test_rows_of_one_id_at_several_positions_count_each(spark):
    points = [(1, "a", -20.0, 0.0, 0.0), (1, "a", 1.0, 0.0, 0.0), (1, "a", -20.0, 0.0, 0.0), (2, "a", -4.0, 0.0, 0.0), (2, "a", -4.0, 0.0, 0.0)]
    assert found(spark, points, [(9, "a", 0.0, 0.0, 0.0, 5.0)] * 2) == [(9, 1), (9, 2)]


def test_points_near_points_in_the_plane(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 3.0, 4.001), (4, NAN, 0.0)], "id long, x double, y double")
    near = points_near_points(p, p, distance=5.0, left_id="id", right_id="id", left_xyz=("x", "y"), right_xyz=("x", "y"))
    assert sorted(map(tuple, near.collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 2), (3, 3)]


RING = [(0, 0), (10, 0), (10, 10), (5, 3), (0, 10)]  # concave
HOLE = [(1, 1), (2, 1), (2, 2), (1, 2)]


def _inside(x, y):
    edges = [(*a, *b) for ring in (RING, HOLE) for a, b in zip(ring, ring[1:] + ring[:1])]
    on = any((x2 - x1) * (y - y1) == (x - x1) * (y2 - y1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2) for x1, y1, x2, y2 in edges)
    odd = sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for x1, y1, x2, y2 in edges) % 2 == 1
    return on, odd


@pytest.mark.parametrize("cell", [0.7, 4.0, 100.0])
@pytest.mark.parametrize("boundary", [True, False])
def test_concave_region_with_hole_and_its_boundary(spark, cell, boundary):
    edges = [(7, float(a[0]), float(a[1]), float(b[0]), float(b[1]), "x") for ring in (RING, HOLE) for a, b in zip(ring, ring[1:] + ring[:1])]
    points = [(i * 100 + j, i / 2, j / 2, 3) for i in range(-2, 24) for j in range(-2, 24)]
    e = spark.createDataFrame(edges, "region_id long, x1 double, y1 double, x2 double, y2 double, strip string").union(spark.createDataFrame([(None, 0.0, 0.0, 1.0, 1.0, "x"), (8, NAN, 0.0, 1.0, 1.0, "x")], "region_id long, x1 double, y1 double, x2 double, y2 double, strip string"))
    p = spark.createDataFrame([*points, (None, 3.0, 1.0, 3), (1, NAN, 1.0, 3)], "id long, global_x double, global_y double, rid int")
    got = sorted(r["id"] for r in points_in_regions(p, e, point_id="id", cell=cell, boundary=boundary).collect())
    want = sorted(i for i, x, y, _ in points for on, odd in [_inside(x, y)] if (on and boundary) or (odd and not on))
    assert got == want


def test_region_without_points_or_edges(spark):
    e = spark.createDataFrame([], "region_id long, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, 0.0, 0.0)], "id long, global_x double, global_y double")
    assert points_in_regions(p, e, point_id="id", cell=1.0).count() == 0


@pytest.mark.parametrize("edges,inside", [("open", {2}), ("half", {1, 2}), ("closed", {1, 2, 3})])
def test_box_edges(spark, edges, inside):
    b = spark.createDataFrame([(9, 0.0, 0.0)], "spot_id long, global_x double, global_y double")
    p = spark.createDataFrame([(1, -1.0, 0.0), (2, 0.5, 0.5), (3, 0.0, 1.0), (4, 1.5, 0.0), (5, None, 0.0)], "id long, global_x double, global_y double")
    assert {r["id"] for r in points_in_boxes(p, b, point_id="id", box_id="spot_id", width=2.0, edges=edges).collect()} == inside


@pytest.mark.parametrize("cell", [0.5, 8.0])
def test_nearest_against_all_pairs(spark, cell):
    rng = random.Random(4)
    left = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(60)] + [(99, 5000.0, -400.0)]
    right = [(i, float(rng.randint(0, 100)), float(rng.randint(0, 100))) for i in range(50)]
    df = lambda rows, n: spark.createDataFrame(rows, f"{n} long, x double, y double")
    got = nearest(df(left, "l"), df(right, "q"), 3, left_id="l", right_id="q", left_xyz=("x", "y"), right_xyz=("x", "y"), cell=cell)
    want = {(a, b, p + 1) for a, ax, ay in left for p, (_, b) in enumerate(sorted((math.hypot(ax - x, ay - y), b) for b, x, y in right)[:3])}
    assert {(r["l"], r["q"], r["place"]) for r in got.select("l", "q", F.col("place")).collect()} == want


def test_touching_spheres_of_every_radius_and_pair_of_genes(spark):
    rng = random.Random(6)
    rows = [(i, "a", rng.choice("BCXY"), rng.uniform(-200, 200), rng.uniform(-200, 200), 0.0, rng.choice([0.0, 0.5, 8.0, 32.0, 40.0, 1e6])) for i in range(60)]
    g = spark.createDataFrame(rows, "sphere_id long, sample_id string, gene string, sphere_x double, sphere_y double, sphere_z double, sphere_r double")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] != b[2] and math.dist(a[3:6], b[3:6]) < a[6] + b[6])
    assert sorted((r["a_id"], r["b_id"]) for r in touching_pairs(g).collect()) == want
