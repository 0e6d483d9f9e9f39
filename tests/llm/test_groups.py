import random

import pytest

from punctum.llm.groups import connected_groups, group_matches, matched_spheres

S = "sphere_id long, sample_id string, gene_entry string, sphere_x double, sphere_y double, node long, x string"


def smallest(edges):
    root = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(3, 3)],
        [(i, i + 1) for i in range(70)],
        [(70 - i, 71 - i) for i in range(50)] + [(200, 201)],
        [(0, i) for i in range(1, 200)] + [(300 + i, 0) for i in range(200)],
        [(random.Random(9).randint(0, 80), random.Random(i).randint(0, 80)) for i in range(60)] * 3,
        [(random.Random(2 * i).randint(0, 300), random.Random(2 * i + 1).randint(0, 300)) for i in range(250)],
    ],
    ids=["none", "loop", "chain", "chain back", "hub", "repeated", "random"],
)
def test_groups_against_union(spark, edges):
    df = spark.createDataFrame([*edges], "a long, b long").union(spark.createDataFrame([(None, 1), (2, None)], "a long, b long"))
    assert {r["node"]: r["root"] for r in connected_groups(df).collect()} == smallest(edges)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], S)
    return sorted(map(tuple, group_matches(*matched_spheres(df, distance=1.25)).collect()))


def brute(rows):
    ok = [r for r in set(rows) if None not in r[:5] and all(abs(v) < 1e300 for v in r[3:5])]
    edges = [(a[0], b[0]) for a in ok for b in ok if a[1] == b[1] and a[2] != b[2] and (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 <= 1.5625]
    return sorted((g, s) for s, g in smallest(edges).items())


def test_copies_limits_and_nulls(spark):
    rows = [(i, "a", "A", 0.0, 0.0) for i in range(1, 40)]  # one gene at one place: no match among themselves
    rows += [(50, "a", "B", 1.25, 0.0), (51, "a", "B", 1.2578125, 1.0), (52, "b", "B", 0.0, 0.0), (52, "b", "B", 0.0, 0.0), (53, "b", "C", 0.75, 1.0), (54, "b", "C", 0.75, 2.5)]
    rows += [(60, "a", None, 0.0, 0.0), (61, "a", "B", float("nan"), 0.0), (62, "a", "B", None, 0.0), (63, None, "B", 0.0, 0.0), (64, "c", "A", 0.0, 0.0), (65, "c", "A", 0.5, 0.0)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert (1, 50) in got and (52, 53) in got and not any(s in (60, 61, 62, 63, 64, 65) for _, s in got)


@pytest.mark.parametrize("seed", range(3))
def test_dense_field(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("ab"), rng.choice("ABCDE"), rng.randint(-10 * 128, 10 * 128) / 128, rng.randint(-1280, 1280) / 128) for i in range(300)]
    rows += [(1000 + i, "a", "A", 40.0 + rng.randint(0, 3), 40.0) for i in range(30)]
    assert found(spark, rows) == brute(rows)


def test_no_spheres(spark):
    assert found(spark, []) == []
