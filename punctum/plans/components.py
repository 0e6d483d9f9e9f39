"""Connected components for the core operators, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctum.plans.shared import cut, forget


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or its not larger) neighbours to its least neighbour."""
    ways = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    back = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    around = ways.unionByName(back) if large else ways.unionByName(back).where("v <= u")
    least = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(joined.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge that isn't a loop; ``root`` is the least node of its component."""
    e = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    while True:
        n = cut(_star(_star(e, True), False))
        same = n.count() == e.count() and n.join(e, ["a", "b"], "left_anti").isEmpty()
        forget(e)
        e = n
        if same:
            break
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
