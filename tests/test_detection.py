import math
import random
from itertools import combinations

import numpy as np
import pytest

from punctum.operators import density as D
from punctum.operators.merge import MergeRule, fold, merged_spheres
from punctum.plans.components import components
from punctum.operators.tileclusters import Columns, completed
from punctum.plans.tiling import tile_widths, tiled

PTS = "tx_id long, sample_id string, target string, global_x double, global_y double, global_z double, overlaps_nucleus int, cell_id string"


def grown(points, eps, least):
    """Clusters by expansion in row order, the textbook way; label -> members."""
    near = lambda p: [q for q in points if sum((p[k] - q[k]) ** 2 for k in (1, 2, 3)) <= eps * eps]
    label, name = {}, {}
    for p in points:
        if p[0] in label or len(near(p)) < least:
            continue
        label[p[0]], queue, name[p[0]] = p[0], near(p), p[0]
        while queue:
            q = queue.pop()
            if q[0] not in label:
                label[q[0]] = p[0]
                if len(near(q)) >= least:
                    queue += near(q)
    return label


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_growing_in_row_order(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randint(0, 14 * 128) / 128, rng.randint(0, 14 * 128) / 128, 1.5 * rng.randint(0, 2)) for i in range(150)]
    rows += [(1000 + i, 3.0, 3.0, 0.0) for i in range(3)]  # copies
    df = spark.createDataFrame([(i, "a", "g", x, y, z, 0, None) for i, x, y, z in rows], PTS)
    got = {r["tx_id"]: r["cluster"] for r in D.density_clusters(df, eps=1.5, least=4).collect()}
    assert got == grown(rows, 1.5, 4)


def test_smallest_ball_against_all_supports():
    rng = np.random.default_rng(0)
    for t in range(120):
        p = rng.integers(0, 5, (rng.integers(1, 9), 3)).astype(float) if t % 2 else rng.normal(size=(rng.integers(1, 9), 3))
        p[:, 2] *= t % 5 != 0
        p[:, 1] *= t % 7 != 0
        u = np.unique(p, axis=0)
        best = min(q for k in range(1, min(4, len(u)) + 1) for s in combinations(range(len(u)), k) for c, q in [D._ball_of(u[list(s)])] if (((u - c) ** 2).sum(axis=1) <= q * (1 + 1e-9) + 1e-12).all())
        centre, r = D.smallest_ball(p)
        assert r == pytest.approx(math.sqrt(best), abs=1e-7)
        assert (np.sqrt(((p - centre) ** 2).sum(axis=1)) <= r + 1e-7).all()


def test_balls_of_many_groups_equal_those_of_each():
    rng = np.random.default_rng(5)
    groups = [np.unique(np.round(rng.normal(0, 0.6, (n, 3)) * 128) / 128, axis=0) for n in [1, 2, 3, *rng.integers(3, 90, 120)]]
    for i, g in enumerate(groups):
        if i % 2:
            g[:, 2] = 1.5 * np.round(g[:, 2])
    got = D.smallest_balls(np.concatenate([g[::-1] for g in groups]), np.array([len(g) for g in groups]))
    want = np.array([(*c, r) for c, r in map(D.smallest_ball, groups)])
    assert np.abs(got - want).max() < 1e-7
    assert D.smallest_balls(np.zeros((0, 3)), np.zeros(0, int)).shape == (0, 4)


@pytest.mark.parametrize("few", [1000, 3])
def test_spheres_among_candidates_equal_those_among_all(spark, monkeypatch, few):
    monkeypatch.setattr(D, "FEW", few)
    rows = [(i, "a", "A", x, y, 0.0, 0, "c") for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.5, 0.5), (20.0, 0.0), (21.0, 0.0), (20.0, 1.0)])]
    rest = [(50, "a", "A", 40.0, 0.0, 0.0, 0, "c"), (51, "a", "B", 0.5, 0.5, 0.0, 1, "c")]
    p = D.DetectorParams(minspl=3, in_soma_thr=0.5)
    want = D.detected_spheres(spark.createDataFrame(rows + rest, PTS), p, keep_cell=False).collect()
    got = D.detected_spheres(spark.createDataFrame(rows + rest, PTS), p, keep_cell=False, candidates=spark.createDataFrame(rows, PTS)).collect()
    assert len(got) == 2 and sorted(got) == sorted(want) and {r["size"] for r in got} == {6.0, 3.0}


def test_sphere_features(spark):
    rows = [(1, "a", "g", 0.0, 0.0, 0.0, 1, "c1"), (2, "a", "g", 1.0, 0.0, 0.0, 0, "c1"), (3, "a", "g", 0.0, 1.0, 0.0, 0, "c0"), (4, "a", "g", 1.0, 1.0, 0.0, 0, "c0"), (5, "a", "h", 0.5, 0.5, 0.1, 1, None), (6, "a", "h", 50.0, 0.5, 0.0, 1, None)]
    rows += [(10 + i, "a", "k", 9.0, 9.0, 0.0, 0, None) for i in range(4)]  # one position: too few places
    s = D.detected_spheres(spark.createDataFrame(rows, PTS), D.DetectorParams(minspl=3, in_soma_thr=1.01, planes=(0.0, 1.5))).collect()
    assert len(s) == 1
    r = s[0]
    assert (r["gene"], r["sphere_id"], r["size"], r["comp"], r["cell_id"], r["layer_z"]) == ("g", 1, 5.0, 2.0, "c0", 0.0)
    assert r["in_soma_ratio"] == pytest.approx(0.4)
    assert (r["sphere_x"], r["sphere_y"], r["sphere_r"]) == pytest.approx((0.5, 0.5, math.sqrt(0.5)))


def test_registered_detection_takes_every_gene(spark, monkeypatch):
    from punctum.catalog import detection, simulation

    rows = [(100 * k + i, "a", g, 30.0 * k + x, y, 0.0, 0, None) for k, g in enumerate(("Flout12c", "Elsewise")) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0)])]
    df = spark.createDataFrame(rows, PTS)
    monkeypatch.setattr(detection, "readings", lambda *_: df)
    monkeypatch.setattr(simulation, "readings", lambda *_: df)
    for query in (detection.e12_spheres, detection.e14_merged, detection.e19_simulator_detector, detection.e23_rough, simulation.v13_parameter_sweep):
        assert {r["gene"] for r in query(spark, None).select("gene").collect()} == {"Flout12c", "Elsewise"}
    assert [r["gene"] for r in detection.e12_marker_spheres(spark, None).collect()] == ["Flout12c"]


def test_no_points_give_no_spheres(spark):
    assert D.detected_spheres(spark.createDataFrame([], PTS), D.DetectorParams(minspl=3)).count() == 0


@pytest.mark.parametrize("p,mu,k", [(0.95, 0.0, 0), (0.95, 3.0, 6), (0.5, 1.0, 1), (0.95, 100.0, 117)])
def test_poisson_quantile(p, mu, k):
    assert D.poisson_quantile(p, mu) == k


def ball(i, rank, x, r, gene=None):
    return {"sphere_id": i, "marker_rank": rank, "gene": gene or f"g{rank}", "sphere_x": x, "sphere_y": 0.0, "sphere_z": 0.0, "layer_z": 0.0, "sphere_r": r, "size": 1.0}


def test_merge_rules():
    import pandas as pd

    run = lambda rows, pts=np.zeros((0, 3)), **kw: fold(pd.DataFrame(rows), lambda g: pts, MergeRule(**kw)).set_index("sphere_id")
    assert list(run([ball(1, 0, 0, 2.0), ball(2, 1, 0.5, 1.0)]).index) == [1]  # swallows
    assert list(run([ball(1, 0, 0, 1.0), ball(2, 1, 0.5, 2.0)]).index) == [2]  # is replaced
    assert list(run([ball(1, 0, 0, 1.0), ball(2, 1, 5.0, 1.0)]).index) == [1, 2]  # apart
    assert list(run([ball(1, 0, 0, 1.0), ball(2, 1, 1.9, 1.0)]).index) == [1, 2]  # touch little
    pts = np.array([[-1.0, 0, 0], [1.3, 0, 0]])
    m = run([ball(1, 0, 0, 1.0), ball(2, 1, 0.3, 1.0)], pts, threshold=0.2, s=2.0)
    assert list(m.index) == [1] and m.loc[1, "sphere_x"] == pytest.approx(0.15) and m.loc[1, "sphere_r"] == pytest.approx(2.3) and m.loc[1, "gene"] == "g0"
    assert list(run([ball(1, 0, 0, 1.0), ball(2, 1, 0.3, 1.0)], pts, threshold=0.0).index) == [1, 2]
    assert list(run([ball(1, 0, 0, 1.0), ball(2, 1, 0.6, 1.0)], pts, by="volume", threshold=0.5).index) == [1]
    assert list(run([ball(1, 0, 0, 1.0), ball(2, 1, 0.6, 1.0)], pts, by="jaccard", threshold=0.9).index) == [1, 2]


def test_merge_in_groups_equals_merge_of_all(spark):
    import pandas as pd

    rng = random.Random(5)
    rows = [(i, "a", f"g{i % 3}", rng.uniform(0, 30), rng.uniform(0, 30), 0.0, 0.0, rng.uniform(0.5, 2.0)) for i in range(60)]
    pts = [(i, "a", f"g{rng.randint(0, 2)}", rng.uniform(-2, 32), rng.uniform(-2, 32), 0.0, 0, None) for i in range(3000)]
    s = spark.createDataFrame(rows, "sphere_id long, sample_id string, gene string, sphere_x double, sphere_y double, sphere_z double, layer_z double, sphere_r double")
    rule = MergeRule(threshold=0.4)
    got = merged_spheres(s, spark.createDataFrame(pts, PTS), rule).toPandas().sort_values("sphere_id")
    all_rows = pd.DataFrame(rows, columns=s.columns).assign(marker_rank=lambda d: d["gene"])
    by = {g: np.array([r[3:6] for r in pts if r[2] == g]) for g in ("g0", "g1", "g2")}
    want = fold(all_rows, by.__getitem__, rule).sort_values("sphere_id")
    assert list(got["sphere_id"]) == list(want["sphere_id"])
    assert np.allclose(got[["sphere_x", "sphere_y", "sphere_r"]], want[["sphere_x", "sphere_y", "sphere_r"]], atol=1e-6)


def test_merge_of_a_chain_goes_on_until_no_group_grows(spark):
    import pandas as pd

    at = [0.0, 1.9] + [4.0 + 2.1 * i for i in range(6)]
    rows = [(i, "a", f"g{i:02d}", x, 0.0, 0.0, 0.0, 1.0) for i, x in enumerate(at)]
    pts = [(i, "a", f"g{i:02d}", x + (0.95 if i else -1.0), 0.0, 0.0, 0, None) for i, x in enumerate(at)]
    s = spark.createDataFrame(rows, "sphere_id long, sample_id string, gene string, sphere_x double, sphere_y double, sphere_z double, layer_z double, sphere_r double")
    rule = MergeRule(threshold=1.0, s=1.27)
    got = merged_spheres(s, spark.createDataFrame(pts, PTS), rule).toPandas().sort_values("sphere_id")
    all_rows = pd.DataFrame(rows, columns=s.columns).assign(marker_rank=lambda d: d["gene"])
    by = {p[2]: np.array([p[3:6]]) for p in pts}
    want = fold(all_rows, by.__getitem__, rule).sort_values("sphere_id")
    assert list(want["sphere_id"]) == [0]
    assert list(got["sphere_id"]) == [0]
    assert np.allclose(got[["sphere_x", "sphere_y", "sphere_r"]], want[["sphere_x", "sphere_y", "sphere_r"]], atol=1e-6)


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    root = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == root


def test_crowded_tiles_are_cut_and_nothing_is_lost(spark):
    rng = random.Random(2)
    rows = [(i, "a", rng.choice("AB"), rng.uniform(0, 64), rng.uniform(0, 64)) for i in range(300)] + [(1000 + i, "a", "A", 3 + rng.random(), 3 + rng.random()) for i in range(200)] + [(5000 + i, "a", "B", 9.0, 9.0) for i in range(500)]
    df = spark.createDataFrame([(*r, 0.0, 1) for r in rows], "id long, s string, g string, x double, y double, z double, copies long")
    t, collapsed = tiled(df, ["s"], block="g", row_id="id", width=64.0, rim=1.0, most=60)
    t, widths = t.collect(), tile_widths(64.0, 1.0)
    own = [r for r in t if all(0 <= r[c] - r[k] * widths[r["level"]] < widths[r["level"]] for c, k in (("x", "tx"), ("y", "ty")))]
    # copies at one position came down to the one of least id, which carries their number
    assert sorted(r["id"] for r in own) == sorted(r[0] for r in rows if r[0] <= 5000)
    assert {r["id"]: r["copies"] for r in own}[5000] == 500 and sum(r["copies"] for r in own) == len(rows)
    assert max(r["level"] for r in t) >= 2 and collapsed.count() == 501
    assert tiled(df, ["s"], block="g", row_id="id", width=64.0, rim=1.0, most=5000)[1] is None


def test_completion_from_any_start_gives_the_same_clusters():
    rng = np.random.default_rng(5)
    xyz = rng.integers(0, 14 * 8, (700, 3)) / 8 * np.array([1, 1, 0.2])
    block, smallest = rng.integers(0, 2, 700), rng.permutation(700)
    weight, least = rng.integers(1, 3, 700), np.full(700, 4)
    grid = Columns(block, xyz, 1.5)
    a, b = np.array([(i, j) for i in range(700) for j in range(i) if block[i] == block[j] and ((xyz[i] - xyz[j]) ** 2).sum() <= 2.25]).T
    bare = completed(grid, weight, smallest, least)
    for share in (0.3, 0.9, 1.0):
        some = rng.random(len(a)) <= share
        c = completed(grid, weight, smallest, least, a[some], b[some])
        assert (c.label == bare.label).all() and (c.central == bare.central).all()
        assert set(zip(*map(tuple, c.border))) == set(zip(*map(tuple, bare.border)))
    assert c.proven[c.central].all() and c.proven[c.border[0]].all()
    count = weight + np.bincount(a, weight[b], 700) + np.bincount(b, weight[a], 700)
    assert (bare.central == (count >= 4)).all() and not bare.proven[bare.border[0]].any()
