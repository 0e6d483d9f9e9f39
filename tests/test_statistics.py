import math
import random

import pytest
from pyspark.sql import functions as F

from punctum.functions import columns as C
from punctum.operators import evaluate as V
from punctum.operators import simulate as M
from punctum.operators import stats as S


@pytest.mark.parametrize("t,df,p", [(0.0, 5, 1.0), (2.0, 10, 0.0733880), (2.5705818, 5, 0.05), (1.959964, 1e7, 0.05), (-12.706205, 1, 0.05)])
def test_t_tail(t, df, p):
    assert S.t_tail(t, df) == pytest.approx(p, abs=2e-6)


def test_broken_t():
    assert math.isnan(S.t_tail(float("nan"), 3)) and S.t_tail(float("inf"), 3) == 0.0


def test_stars_and_corrections_without_p(spark):
    d = spark.createDataFrame([(1, 0.2), (2, 0.03), (3, 0.005), (4, 0.0001), (5, None), (6, float("nan"))], "i int, p double")
    assert [r[0] for r in d.orderBy("i").select(C.stars(F.col("p"))).collect()] == ["ns", "*", "**", "***", "", ""]
    a = {r["i"]: (r["bh"], r["bonferroni"]) for r in S.adjusted(d, "p").collect()}
    assert a[5] == a[6] == (None, None)
    assert a[4] == pytest.approx((0.0004, 0.0004)) and a[1] == pytest.approx((0.2, 0.8)) and a[2] == pytest.approx((0.04, 0.12))


def test_linear_model_with_and_without_solution(spark):
    rng = random.Random(0)
    rows = [("ok", x, 2.0 + 3.0 * x + rng.gauss(0, 0.01)) for x in [rng.random() for _ in range(200)]] + [("flat", 1.0, float(i)) for i in range(9)] + [("few", 0.0, 1.0)]
    m = {(r["g"], r["term"]): r for r in S.linear_model(spark.createDataFrame(rows, "g string, x double, y double"), F.col("y"), {"x": F.col("x")}, ["g"]).collect()}
    assert m["ok", "x"]["beta"] == pytest.approx(3.0, abs=0.02) and m["ok", "x"]["p"] < 1e-6
    assert m["flat", "x"]["beta"] is None and m["few", "intercept"]["beta"] is None


def test_bootstrap_holds_the_mean_and_repeats(spark):
    d = spark.range(400).select("id", F.lit("g").alias("g"), (F.col("id") % 10).cast("double").alias("v"))
    a, b = (S.bootstrap_mean(d.repartition(n), "v", "id", ["g"], resamples=100).first() for n in (2, 7))
    assert a == b and a["low"] < 4.5 < a["high"] and a["high"] - a["low"] < 1.2


def test_top_until_never_reached(spark):
    d = spark.createDataFrame([([("a", 0.2), ("b", 0.2)],), ([("a", 0.2), ("b", 0.6)],)], "v array<struct<name: string, value: double>>")
    assert [r[0] for r in d.select(C.top_until(F.col("v"), 0.5)).collect()] == [["a"], ["b"]]


def test_matching_beats_greedy():
    assert V.best_assignment([(1, 10, 0.9), (1, 11, 0.8), (2, 10, 0.8)]) == [(1, 11), (2, 10)]
    rng = random.Random(3)
    from itertools import permutations

    for _ in range(40):
        w = {(a, b): rng.randint(1, 9) / 10 for a in range(4) for b in range(10, 14) if rng.random() < 0.6}
        best = max((sum(w.get((a, b), 0.0) for a, b in enumerate(p)) for p in permutations(range(10, 14))), default=0.0)
        got = V.best_assignment([(a, b, v) for (a, b), v in w.items()])
        assert sum(w[x] for x in got) == pytest.approx(best)


def test_simulation_repeats_and_has_the_density(spark):
    r = M.Region(100.0, 100.0)
    a, b = (M.simulation(spark, r, densities={"A": 0.05, "B": 0.02}, outside=40, inside=10, mean_points=20.0, seed=3) for _ in range(2))
    assert a.exceptAll(b.repartition(3)).isEmpty()
    n = {x["type"]: x["n"] for x in a.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n["CSR"] == 700 and 1300 < n["Extranuclear"] < 1900
    assert M.simulation(spark, r, densities={"A": 0.0}, outside=0, inside=0, mean_points=1.0, seed=1).count() == 0
    assert a.where("global_z < 0 OR global_z > 10.5").isEmpty()


def test_no_detections_and_no_truth(spark):
    e = spark.createDataFrame([], "sphere_id long, tx_id long")
    pts = spark.createDataFrame([(1, "t"), (2, None)], "tx_id long, truth string")
    pairs = V.overlaps(e, pts, truth="truth")
    one, none = (spark.createDataFrame([(n,)], "n long") for n in (1, 0))
    m = V.object_metrics(pairs, one, none, truth="truth").first()
    assert (m["tp"], m["fp"], m["fn"], m["f1"]) == (0, 0, 1, 0.0)


def test_registered_sweeps_take_the_whole_grids(spark, monkeypatch):
    import os

    import pytest

    from punctum.catalog import simulation, statistics, subtypes
    from tests.oracle import DATA

    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    assert subtypes.n08_tuning(spark, DATA).select("enrichment", "least").distinct().count() == 9 * 7
    assert simulation.v14_filter_sweep(spark, DATA).select("in_soma_thr", "nc_thr").distinct().count() == 12 * 11
    asked, settings = {}, []
    monkeypatch.setattr(statistics.S, "bootstrap_mean", lambda *a, **kw: asked.update(kw))
    statistics.f16_bootstrap(spark, DATA)
    assert asked.get("resamples", 500) == 500
    none = spark.createDataFrame([], "gene string, sphere_r double")
    monkeypatch.setattr(simulation, "detected_spheres", lambda points, p, **kw: settings.append((p.eps, p.minspl)) or none)
    simulation.v13_parameter_sweep(spark, DATA)
    assert len(set(settings)) == 8


def test_overlapping_spheres_on_one_group_match_once(spark):
    pairs = spark.createDataFrame([(0, 1, 10, 10, 33), (0, 2, 10, 10, 30)], "truth long, sphere_id long, both long, n_truth long, n_sphere long")
    one, two = (spark.createDataFrame([(n,)], "n long") for n in (1, 2))
    m = V.object_metrics(pairs, one, two, truth="truth", complete=0.6, pure=0.3).first()
    assert (m["tp"], m["fp"], m["fn"], m["recall"]) == (1, 1, 0, 1.0)


def test_object_metrics_against_all_matchings(spark):
    from itertools import permutations

    rng = random.Random(8)
    rows, want = [], {}
    for run in range(12):
        truths = [rng.randint(3, 9) for _ in range(4)]
        mine = []
        for s in range(4):
            held = [rng.choice([0, 0, n // 2, n, n]) for n in truths]
            total = sum(held) + rng.randint(0, 3)
            mine += [(str(run), t, s, b, truths[t], total) for t, b in enumerate(held) if b]
        rows += mine
        ok = {(r[1], r[2]): 2 * r[3] / (r[4] + r[5]) for r in mine if r[3] >= 0.6 * r[4] and r[3] >= 0.3 * r[5]}
        best = max(permutations(range(4)), key=lambda p: sum(ok.get((t, s), 0.0) for t, s in enumerate(p)))
        want[str(run)] = sum((t, s) in ok for t, s in enumerate(best))
    pairs = spark.createDataFrame(rows, "run string, truth long, sphere_id long, both long, n_truth long, n_sphere long")
    four = pairs.select("run").distinct().withColumn("n", F.lit(4))
    m = V.object_metrics(pairs, four, four, truth="truth", keys=["run"], complete=0.6, pure=0.3).collect()
    assert {r["run"]: r["tp"] for r in m} == want and all(r["fn"] >= 0 for r in m)


def test_poisson_numbers_of_any_mean(spark):
    d = spark.range(4000).select("id", M.uniform(3, F.col("id")).alias("u"))
    for mean in (0.0, 1.0, 40.0, 900.0):
        r = d.select(M.poisson_count(F.col("u"), mean).alias("n")).agg(F.avg("n").alias("m"), F.var_samp("n").alias("v"), F.max("n").alias("top")).first()
        assert r["m"] == pytest.approx(mean, abs=4 * math.sqrt(mean / 4000) + 1e-9) and r["v"] == pytest.approx(mean, rel=0.15, abs=1e-9)
    assert r["top"] > 950
    ends = spark.createDataFrame([(1e-17,), (1 - 2**-53,)], "u double").select(M.poisson_count(F.col("u"), 1.0).alias("n")).collect()
    assert [e["n"] for e in ends] == [0, 18]


def test_bootstrap_of_broken_values_and_no_rows(spark):
    d = spark.createDataFrame([(1, "a", 2.0), (2, "a", None), (3, "a", float("nan")), (4, "b", 5.0), (5, None, 1.0)], "id long, g string, v double")
    got = {r["g"]: (r["low"], r["high"]) for r in S.bootstrap_mean(d, "v", "id", ["g"], resamples=40).collect()}
    assert got["a"] == (2.0, 2.0) and got["b"] == (5.0, 5.0) and got[None] == (1.0, 1.0)
    assert S.bootstrap_mean(d.where("id > 9"), "v", "id", ["g"]).count() == 0
    assert len(S._COPIES) == 24 and 1 - S._COPIES[-1] < 1e-15


def test_agreement_of_runs_equals_that_of_two(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 3), rng.randint(0, 2), i % 4) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, a int, b int, c int")
    got = {(r["first"], r["second"]): r["ari"] for r in S.pairwise_rand(d, ["a", "b", "c"]).collect()}
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        assert got[a, b] == pytest.approx(S.adjusted_rand(d, a, b).first()[0])
    same = d.withColumn("d", 3 - F.col("a"))
    assert S.pairwise_rand(same, ["a", "d"]).first()["ari"] == pytest.approx(1.0)


def test_number_of_clusters_mixtures_and_topics(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(20 * (i % 3), 0.3), rng.gauss(-15 * (i % 3), 0.3)) for i in range(90)]
    d = spark.createDataFrame(rows, "id long, x double, y double")
    sweep = {r["k"]: r for r in S.cluster_number_sweep(d, ["x", "y"], [2, 3], "id", seeds=(1, 2)).collect()}
    assert sweep[3]["silhouette"] > 0.95 and sweep[3]["inertia"] < 100 < sweep[2]["inertia"]
    label = {r["id"]: r["cluster"] for r in S.mixture_labels(d, ["x", "y"], 3, 1, "id").collect()}
    assert len(label) == 90 and all(0 <= c < 3 for c in label.values())
    e = spark.createDataFrame([(i, g, 9) for i in range(20) for g in ("AB" if i % 2 else "CD")], "id long, target string, n long")
    shares = S.topic_shares(e, ["A", "B", "C", "D"], 2, 1, "id").collect()
    assert len(shares) == 20 and all(abs(sum(r["shares"]) - 1) < 1e-6 for r in shares)


def test_welch_against_the_rest_by_hand(spark):
    labels = spark.createDataFrame([(i, "p" if i < 3 else "q") for i in range(7)], "id long, kind string")
    expr = spark.createDataFrame([(0, "A", 4.0), (1, "A", 5.0), (2, "A", 7.0), (3, "A", 1.0)], "id long, target string, value double")
    r = S.t_test_against_rest(expr, labels, "id", "kind").where("kind = 'p'").first()
    import statistics

    x, y = [4.0, 5.0, 7.0], [1.0, 0.0, 0.0, 0.0]
    e1, e2 = statistics.variance(x) / 3, statistics.variance(y) / 4
    assert r["t"] == pytest.approx((statistics.mean(x) - statistics.mean(y)) / math.sqrt(e1 + e2))
    assert r["df"] == pytest.approx((e1 + e2) ** 2 / (e1**2 / 2 + e2**2 / 3)) and 0 < r["p"] < 0.05
