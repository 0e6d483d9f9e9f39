import random

import numpy as np
import pytest

from punctum.llm import clusters
from punctum.llm.clusters import ClusterParams, Columns, graph_clusters, modularity_communities, neighbour_descent, similarity_clusters, typical_members

P = "tx_id long, sample_id string, gene string, x double, y double, z double, label long, level string"
NAN = float("nan")


def brute(rows, eps=1.5, least=3):
    ok = [r for r in set(rows) if None not in r[:6] and all(abs(v) < 1e300 for v in r[3:6])]
    near = {p[0]: [q[0] for q in ok if p[1:3] == q[1:3] and sum((p[k] - q[k]) ** 2 for k in (3, 4, 5)) <= eps * eps] for p in ok}
    core = {i for i, n in near.items() if len(n) >= least}
    root = {i: i for i in core}
    changed = True
    while changed:
        changed = False
        for i in core:
            low = min(root[j] for j in near[i] if j in core)
            if low < root[i]:
                root[i], changed = low, True
    out = [(root[i], i) for i in core]
    out += [(min(root[j] for j in near[i] if j in core), i) for i in near if i not in core and any(j in core for j in near[i])]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 5, "q") for r in rows], P)
    return similarity_clusters(df, row_id="tx_id", keys=["sample_id"], block="gene", xyz=["x", "y", "z"], params=ClusterParams(**kw))


def field(seed, n=260, side=24):
    rng = random.Random(seed)
    q = lambda lo, hi: rng.randint(int(lo * 128), int(hi * 128)) / 128
    return [(i, rng.choice("ab"), rng.choice("AB"), q(-side / 2, side / 2), q(-side / 2, side / 2), 1.5 * rng.randint(0, 1)) for i in rng.sample(range(10_000), n)]


@pytest.mark.parametrize("width,most", [(256.0, 400_000), (8.0, 400_000), (64.0, 20)], ids=["one tile", "many tiles", "crowded tiles"])
@pytest.mark.parametrize("seed", range(2))
def test_clusters_against_all_pairs(spark, seed, width, most):
    rows = field(seed)
    rows += [(20_000 + i, "a", "A", 0.25 * i, 0.0, 0.0) for i in range(-40, 40)]  # a chain across tiles
    rows += [(30_000 + i, "a", "B", 8.0, 8.0, 0.0) for i in range(50)]  # one position, on a corner of tiles
    rows += rows[:30]  # delivered again
    got = run(spark, rows, width=width, most=most)
    assert sorted((r["cluster_id"], r["tx_id"]) for r in got.collect()) == brute(rows)


def test_broken_rows_and_ties(spark):
    rows = [(i, "a", "A", 0.0, 0.0, 0.0) for i in (5, 3)] + [(9, "a", "A", 1.5, 0.0, 0.0), (11, "a", "A", 3.0, 0.0, 0.0), (12, "a", "A", 3.0078125, 0.0, 0.0)]
    rows += [(20, "a", "A", NAN, 0.0, 0.0), (21, "a", None, 0.0, 0.0, 0.0), (22, None, "A", 0.0, 0.0, 0.0), (23, "a", "A", float("inf"), 0.0, 0.0), (None, "a", "A", 0.0, 0.0, 0.0)]
    got = run(spark, rows).collect()
    assert sorted((r["cluster_id"], r["tx_id"], r["central"]) for r in got) == [(3, 3, True), (3, 5, True), (3, 9, True), (3, 11, True), (3, 12, False)]
    assert sorted((r["cluster_id"], r["tx_id"]) for r in got) == brute(rows)


def test_crowded_copies_come_back_with_their_cluster(spark):
    rows = [(i, "a", "A", 1.0, 1.0, 0.0) for i in range(40)] + [(100 + i, "a", "A", 2.0 + i, 1.0, 0.0) for i in range(4)] + [(200 + i, "a", "B", 1.0, 1.0, 0.0) for i in range(30)] + [(300, "a", "B", 40.0, 1.0, 0.0)]
    got = run(spark, rows + rows[:9], most=10).collect()
    assert sorted((r["cluster_id"], r["tx_id"]) for r in got) == brute(rows)


def test_a_tile_of_lone_positions(spark):
    rows = [(i, "a", "A", 1.0, 1.0, 0.0) for i in range(4)] + [(10 + i, "a", "B", 1.0, 1.0, 0.0) for i in range(2)] + [(20 + i, "a", "A", 900.0, 1.0, 0.0) for i in range(3)]
    assert sorted((r["cluster_id"], r["tx_id"]) for r in run(spark, rows).collect()) == brute(rows)


def test_the_graph_decides_and_the_check_completes(monkeypatch):
    rng = np.random.default_rng(2)
    middle = rng.uniform(0, 90, (150, 3)) * np.array([1, 1, 0.1])
    xyz = np.round(np.concatenate([(middle[:, None] + rng.normal(0, 0.6, (150, 12, 3))).reshape(-1, 3), rng.uniform(0, 90, (2000, 3)) * np.array([1, 1, 0.1])]) * 128) / 128
    n = len(xyz)
    args = np.zeros(n, np.int64), xyz, np.ones(n, np.int64), np.arange(n), np.full(n, 3)
    c = graph_clusters(ClusterParams())(*args)
    assert c.proven[c.central].mean() > 0.97 and c.proven[c.border[0]].mean() > 0.9 and (c.degree[c.central] > 0).mean() > 0.97
    monkeypatch.setattr(clusters, "neighbour_descent", lambda grid, k, rounds: (np.full((len(grid.key), k), -1), np.full((len(grid.key), k), np.inf)))
    bare = graph_clusters(ClusterParams())(*args)
    assert not bare.proven.any() and not bare.degree.any()
    assert (bare.label == c.label).all() and set(zip(*map(tuple, bare.border))) == set(zip(*map(tuple, c.border)))


def test_no_points(spark):
    got = run(spark, [])
    assert got.count() == 0 and typical_members(got, row_id="tx_id").count() == 0


def test_typical_members_are_in_the_middle(spark):
    rows = [(i, "a", "A", 0.5 * i, 0.0, 0.0) for i in range(9)] + [(100, "a", "A", 50.0, 0.0, 0.0)]
    t = typical_members(run(spark, rows), row_id="tx_id").collect()
    assert len(t) == 1 and t[0]["size"] == 9 and t[0]["cluster_id"] == 0
    assert set(t[0]["typical"]) <= set(range(1, 8))


def test_descent_finds_the_nearest():
    rng = np.random.default_rng(1)
    xyz = rng.uniform(0, 20, (1500, 3))
    block = rng.integers(0, 2, 1500)
    index, _ = neighbour_descent(Columns(block, xyz, 1.5), 6, 8)
    hits = 0
    for i in range(0, 1500, 10):
        d = ((xyz - xyz[i]) ** 2).sum(axis=1)
        d[(block != block[i]) | (np.arange(1500) == i)] = np.inf
        hits += len(set(index[i]) & set(np.argsort(d)[:6]))
    assert hits / (150 * 6) > 0.9


def test_communities_of_two_cliques():
    a, b = np.array([(i, j) for s in (0, 6) for i in range(s, s + 6) for j in range(i + 1, s + 6)] + [(5, 6)]).T
    c = modularity_communities(12, a, b, np.ones(len(a)))
    assert len(set(c[:6])) == 1 and len(set(c[6:])) == 1 and c[0] != c[6]
