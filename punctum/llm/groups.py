"""Pairwise matches consolidated into groups: the connected components of the graph of matches.

Minimum labels go across edges: every node points to the smallest node next to it. Two pointer jumps take it four nodes
up its chain of pointers, and the graph is contracted to the nodes reached, until no edge is left, that is, until no
label changes. A chain that is longer stays connected, as the edges along it are contracted too; the smallest node of a
group points to itself throughout and is its last one. Each round at least halves the nodes that still have edges. Every
step ends in a table in the shared folder, so a lost executor costs at most one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctum.functions.names import finite
from punctum.plans.shared import cut, forget


def connected_groups(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge: ``root`` is the smallest node that it is linked to, directly or through others.

    Edges are undirected; repeated edges are fine, loops name a group of one, rows with a NULL end are left out. No edges
    give no rows. Nothing is collected but one count per round. A node with very many edges is no hot spot in the
    minimum, which is combined before the shuffle; its edges, when relabelled, fall under adaptive skew handling.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not steps or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
        jumped = cut(_jumped(_jumped(parent)))
        forget(parent)
        at = lambda name: jumped.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
        apart = edges.join(at("a"), "a").join(at("b"), "b").where("root_a <> root_b")
        contracted = cut(apart.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
        forget(edges)
        edges = contracted
        steps.append(jumped)
    labels = steps[0]
    for step in steps[1:]:
        up = step.select(F.col("node").alias("root"), F.col("root").alias("above"))
        labels = labels.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    out = cut(labels)
    forget(edges, *steps)
    return out


def _jumped(parent: DataFrame) -> DataFrame:
    """Every node with the root of its root."""
    up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
    return parent.join(up, "root").select("node", F.col("above").alias("root"))


def matched_spheres(spheres: DataFrame, *, distance: float) -> tuple[DataFrame, DataFrame]:
    """(members, links) of spheres of one sample that denote different genes and lie at most ``distance`` apart in the plane.

    ``spheres`` has sphere_id, sample_id, gene_entry, sphere_x, sphere_y. Members (node, sphere_id) put spheres of equal
    links under one node; links (a, b) join nodes and name every node that has a match.

    Copies aren't expanded into pairs. Spheres at one position have the same matches elsewhere, so the position is one
    node: with two genes or more its spheres are linked already, with one gene they are linked by any match at all.
    All spheres in a cell whose diagonal is ``distance`` are near each other, so a cell with two genes is one
    node too. Between cells, distinct positions are compared, and links are distinct before they are shuffled.
    """
    side = distance / 2**0.5 * (1 - 1e-9)
    s = spheres.select("sphere_id", "sample_id", "gene_entry", F.col("sphere_x").alias("x"), F.col("sphere_y").alias("y"))
    s = s.where(finite(F.col("x")) & finite(F.col("y"))).where("sphere_id IS NOT NULL AND sample_id IS NOT NULL AND gene_entry IS NOT NULL")
    s = s.withColumns({"x": F.col("x") + F.lit(0.0), "y": F.col("y") + F.lit(0.0)})  # -0.0 is 0.0
    place = s.groupBy("sample_id", "x", "y").agg(F.min("sphere_id").alias("node"), F.min("gene_entry").alias("g0"), F.max("gene_entry").alias("g1"))
    place = place.withColumns({"ix": F.floor(F.col("x") / side), "iy": F.floor(F.col("y") / side)})
    cells = place.groupBy("sample_id", "ix", "iy").agg(F.min("node").alias("cell_node"), F.min("g0").alias("c0"), F.max("g1").alias("c1"))
    place = cut(place.join(cells, ["sample_id", "ix", "iy"]).withColumn("node", F.when(F.col("c0") != F.col("c1"), F.col("cell_node")).otherwise(F.col("node"))))
    members = s.join(place.select("sample_id", "x", "y", "node"), ["sample_id", "x", "y"]).select("node", "sphere_id").distinct()
    # the half of the 5 x 5 cells around a cell that comes after it: each pair of cells meets once
    after = [(i, j) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)]
    offsets = F.array(*(F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in after))
    right = place.select("sample_id", "ix", "iy", *(F.col(c).alias(f"{c}_2") for c in ("x", "y", "node", "g0", "g1")))
    left = place.select("sample_id", "x", "y", "node", "g0", "g1", "ix", "iy", F.explode(offsets).alias("o"))
    left = left.withColumns({"ix": F.col("ix") + F.col("o.di"), "iy": F.col("iy") + F.col("o.dj")}).drop("o")
    dx, dy = F.col("x") - F.col("x_2"), F.col("y") - F.col("y_2")
    one_gene = (F.col("g0") == F.col("g1")) & (F.col("g0_2") == F.col("g1_2")) & (F.col("g0") == F.col("g0_2"))
    near = left.join(right, ["sample_id", "ix", "iy"]).where((dx * dx + dy * dy <= distance * distance) & ~one_gene & (F.col("node") != F.col("node_2")))
    inside = place.where("c0 <> c1").select(F.col("node").alias("a"), F.col("node").alias("b"))
    links = near.select(F.col("node").alias("a"), F.col("node_2").alias("b")).unionByName(inside).distinct()
    return members, links


def group_matches(members: DataFrame, links: DataFrame) -> DataFrame:
    """(group_id, sphere_id) for every member of a node that is in a link; group_id is the group's smallest sphere_id."""
    groups = connected_groups(links)
    return members.join(groups, "node").select(F.col("root").alias("group_id"), "sphere_id").distinct()
