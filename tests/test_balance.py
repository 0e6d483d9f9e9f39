import random

import pytest
from pyspark.sql import functions as F

from punctum.operators.balance import middle_rows, salted_aggregate

SCHEMA = "k string, x double, id long, __salt int"


def middle(rows):
    by = {}
    for k, x, i in rows:
        if k is not None and x is not None and x == x and abs(x) != float("inf"):
            by.setdefault(k, []).append((x, i))
    return sorted((k, sorted(v)[(len(v) + 1) // 2 - 1][1]) for k, v in by.items())


@pytest.mark.parametrize("ordered_rows,heavy", [(1 << 16, 100_000), (3, 50), (0, 0)])
def test_middle_of_hot_and_tied_keys(spark, ordered_rows, heavy):
    rng = random.Random(1)
    rows = [("hot", 5.0, i * 70_000) for i in range(300)]  # one key, all tied, ids far apart
    rows += [("near", 100 + rng.random() / 1e6, 1000 + i) for i in range(200)]
    rows += [(rng.choice("abc"), rng.choice([-3.5, -0.0, 0.0, 17.25, 1e9, rng.random() * 50]), 10_000_000 + i) for i in range(300)]
    rows += [("a", float("nan"), 1), ("a", float("inf"), 2), ("a", None, 3), (None, 1.0, 4), ("one", 2.0, 5)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got = middle_rows(df, ["k"], order="x", row_id="id", heavy_rows=heavy, salts=4, ordered_rows=ordered_rows)
    assert sorted(map(tuple, got.collect())) == middle(rows)


def test_middle_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert middle_rows(df, ["k"], order="x", row_id="id").count() == 0


@pytest.mark.parametrize("heavy", [1, 10, 10**6])
def test_salted_sums_equal_plain_sums(spark, heavy):
    rows = [("hot" if i % 3 else f"k{i % 7}", float(i), i, 0) for i in range(500)] + [(None, 1.0, 9999, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = salted_aggregate(df, ["k"], F.col("id"), {"n": F.count(F.lit(1)), "s": F.sum("x")}, {"n": F.sum("n"), "s": F.sum("s")}, heavy_rows=heavy, salts=5)
    want = df.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
