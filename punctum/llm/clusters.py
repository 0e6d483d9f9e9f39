"""Similarity clusters of points: neighbour graph by neighbour descent, communities by modularity, exact completion.

The plane is cut into tiles with a rim of neighbouring points (``punctum.plans.tiling``); every tile is one Arrow batch
worked on with numpy:

1. points of one block (here: gene) at one position become one node, with the number of its points as weight;
2. neighbour descent builds an approximate graph of each node's nearest nodes;
3. the graph's edges within ``eps`` tell which nodes are central and link them to clusters;
4. modularity-based community detection runs on these edges; the weight a node has inside its community tells how typical it is;
5. the exact check completes what the graph leaves open, and only that: nodes that it doesn't prove central, and nodes
   with several groups around them (``punctum.operators.tileclusters.completed``). ``proven`` tells which rows needed none.

Clusters that cross tiles are joined through the points that both tiles saw, by ``connected_groups``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctum.functions.names import finite
from punctum.llm.groups import connected_groups
from punctum.operators.tileclusters import PAIRS, Columns, Kernel, TileClusters, among_candidates, clusters_by_tiles, completed, joined


@dataclass(frozen=True)
class ClusterParams:
    """eps: largest distance of near points; min_points: near points, itself included, that make one central;
    neighbours: nearest nodes kept in the descent; rounds: most rounds of the descent; width: of a tile; most: rows of a
    tile above which copies are collapsed and it is cut."""

    eps: float = 1.5
    min_points: int = 3
    neighbours: int = 6
    rounds: int = 6
    width: float = 160.0
    most: int = 400_000


def across_order(grid: Columns) -> np.ndarray:
    """Nodes by block, then by strips of y, then by x."""
    return np.lexsort((grid.xyz[:, 0], np.floor(grid.xyz[:, 1] / grid.eps), grid.block))


def neighbour_descent(grid: Columns, k: int, rounds: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of about the ``k`` nearest nodes of the same block, by neighbour descent.

    Starts from the nodes next in two grid orders, along y and along x, and from random ones. Each round compares every node with the neighbours of
    its neighbours and with nodes that have it as a neighbour, if any of these changed, keeps the best ``k``, and ends when
    under one node in 200 changes. Free places have index -1.
    """
    n = len(grid.key)
    rng = np.random.default_rng(seed)
    steps = [s for h in range(1, k // 2 + 2) for s in (-h, h)]
    first = [rng.integers(0, n, n)]
    for order in (grid.order, across_order(grid)):
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        first += [order[np.clip(place + s, 0, n - 1)] for s in steps]
    best = np.full((n, k), -1)
    dist = np.full((n, k), np.inf)
    cand = np.stack(first, axis=1)
    me = active = np.arange(n)
    xyz, block = grid.xyz.astype(np.float64), grid.block
    for turn in range(rounds + 1):
        moved = np.zeros(n, bool)
        for part in np.array_split(np.arange(len(active)), max(1, len(active) * cand.shape[1] // PAIRS + 1)):
            at = active[part]
            c = np.sort(np.concatenate([best[at], cand[part]], axis=1), axis=1)
            d = xyz[c] - xyz[at][:, None, :]
            d2 = np.einsum("ijk,ijk->ij", d, d)
            d2[:, 1:][c[:, 1:] == c[:, :-1]] = np.inf  # the same node found twice stays once
            d2[(c < 0) | (c == at[:, None]) | (block[c] != block[at][:, None])] = np.inf
            o = np.argpartition(d2, k - 1, axis=1)[:, :k]
            c, d2 = np.take_along_axis(c, o, 1), np.take_along_axis(d2, o, 1)
            moved[at] = d2.max(axis=1) < dist[at].max(axis=1)
            moved[at] |= (np.isinf(d2).sum(axis=1) < np.isinf(dist[at]).sum(axis=1))
            c[np.isinf(d2)] = -1
            best[at], dist[at] = c, d2
        if turn and moved.sum() <= n // 200 or turn == rounds or not moved.any():  # none moves in turn 0 if no node has another of its block
            break
        back = np.full((n, k), -1)  # up to k of the nodes that have it as a neighbour
        src, dst = np.repeat(me, k), best.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        back[dst, rng.integers(0, k, len(dst))] = src
        # who neither changed nor has a neighbour that did would be compared with the same nodes again
        active = np.flatnonzero(moved | (moved[best] & (best >= 0)).any(axis=1) | (moved[back] & (back >= 0)).any(axis=1))
        mine = best[active]
        hop = np.where(mine[:, :, None] >= 0, best[mine], -1).reshape(len(active), -1)
        cand = np.concatenate([hop, back[active]], axis=1)
    return best, dist


def modularity_communities(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, passes: int = 8, levels: int = 3) -> np.ndarray:
    """A community number for each of ``n`` nodes of the undirected graph (a, b, w) without loops.

    Nodes move to the neighbouring community that gains most modularity, half of the nodes at a time so that
    neighbours don't swap; communities then become the nodes of the next level. Every community is connected: what falls
    apart is split at the end.
    """
    member = np.arange(n)
    src, dst, ww = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    nodes, total = n, float(ww.sum())
    for _ in range(levels if total else 0):
        degree = np.bincount(src, ww, nodes)
        comm = np.arange(nodes)
        out = src != dst
        s, t, v = src[out], dst[out], ww[out]
        for turn in range(passes):
            size = np.bincount(comm, degree, nodes)
            key = s * nodes + comm[t]
            o = np.argsort(key, kind="stable")
            first = np.concatenate([[True], key[o][1:] != key[o][:-1]]) if len(o) else np.zeros(0, bool)
            at = np.flatnonzero(first)
            pair = key[o][at]
            node, into = pair // nodes, pair % nodes
            links = np.add.reduceat(v[o], at) if len(at) else np.zeros(0)
            gain = links - degree[node] * (size[into] - np.where(into == comm[node], degree[node], 0)) / total
            stay = np.full(nodes, 0.0)
            own = into == comm[node]
            stay[node[own]] = gain[own]
            alone = np.setdiff1d(np.arange(nodes), node[own], assume_unique=False)
            stay[alone] = -degree[alone] * (size[comm[alone]] - degree[alone]) / total
            o = np.lexsort((into, -gain, node))
            top = o[np.concatenate([[True], node[o][1:] != node[o][:-1]])] if len(o) else o
            move = (gain[top] > stay[node[top]] + 1e-12) & (((node[top] * 2654435761 + turn * 40503) >> 7) % 2 == 0)
            if not move.any() and turn % 2:
                break
            comm[node[top][move]] = into[top][move]
        used, comm = np.unique(comm, return_inverse=True)
        member = comm[member]
        if len(used) == nodes:
            break
        key, inv = np.unique(comm[src] * len(used) + comm[dst], return_inverse=True)
        ww = np.bincount(inv, ww)
        src, dst, nodes = key // len(used), key % len(used), len(used)
    same = member[a] == member[b]
    return joined(n, a[same], b[same])


def graph_edges(grid: Columns, p: ClusterParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, squared distance) of the near pairs that the descent found, each once."""
    m = len(grid.key)
    index, d2 = neighbour_descent(grid, p.neighbours, p.rounds)
    near = d2 <= grid.eps2
    src, dst, dd = np.repeat(np.arange(m), near.sum(axis=1)), index[near], d2[near]
    a, b = np.minimum(src, dst), np.maximum(src, dst)
    _, one = np.unique(a * m + b, return_index=True)
    return a[one], b[one], dd[one]


def graph_clusters(p: ClusterParams) -> Kernel:
    """A kernel (block, xyz, weight, smallest, least) that starts from the graph of the descent and ranks by its communities."""

    def cluster(grid: Columns, weight: np.ndarray, smallest: np.ndarray, least: np.ndarray) -> TileClusters:
        n = len(weight)
        a, b, d2 = graph_edges(grid, p)
        tie = weight[a] * weight[b] / (1.0 + np.sqrt(d2) / p.eps)
        community = modularity_communities(n, a, b, tie)
        same = community[a] == community[b]
        out = completed(grid, weight, smallest, least, a, b)
        # each point's weight to the points of its community, those at its own position included
        out.degree = np.bincount(a[same], tie[same], n) / weight + np.bincount(b[same], tie[same], n) / weight + (weight - 1)
        return out

    def run(block: np.ndarray, xyz: np.ndarray, weight: np.ndarray, smallest: np.ndarray, least: np.ndarray) -> TileClusters:
        return among_candidates(block, xyz, weight, smallest, least, p.eps, cluster)

    return run


def similarity_clusters(points: DataFrame, *, row_id: str, keys: Sequence[str], block: str, xyz: Sequence[str], params: ClusterParams = ClusterParams()) -> DataFrame:
    """(cluster_id, row_id, central, degree, proven): the points of every cluster, each once.

    Points are near if ``keys`` and ``block`` are equal and they are at most ``eps`` apart. A point with ``min_points``
    near ones, itself included, is central; near central points share a cluster, named by its smallest central row_id; any
    other point near a central one belongs to the cluster of smallest id. ``degree`` is the weight of a point's
    ties within its community, by which ``typical_members`` describes a cluster; ``proven`` is true where the graph alone
    put the point into a cluster, and false where that took the exact check.

    Rows with a NULL key, block or id, or a position that isn't finite, are in no cluster. Rows of one id count once
    and must be equal. No points give no rows.
    """
    x, y, z = xyz
    p = points.select(F.col(row_id).cast("long").alias("row_id"), *(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)), F.col(block).cast("string").alias("block"), *((F.col(c).cast("double") + F.lit(0.0)).alias(n) for c, n in zip((x, y, z), "xyz")))
    names = [f"key_{i}" for i in range(len(keys))]
    p = p.where(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z")))
    p = p.where(" AND ".join(f"{c} IS NOT NULL" for c in ("row_id", "block", *names))).withColumn("least", F.lit(params.min_points).cast("long"))
    rows = clusters_by_tiles(p, names, graph_clusters(params), connected_groups, eps=params.eps, width=params.width, most=params.most)
    return rows.select("cluster_id", F.col("row_id").alias(row_id), "central", "degree", "proven")


def typical_members(clusters: DataFrame, *, row_id: str, most: int = 3) -> DataFrame:
    """(cluster_id, size, n_central, n_proven, typical): each cluster's size and its ``most`` points of highest degree inside their community.

    Ties go to the smaller id. The ranking is cut to ``most`` rows before the shuffle, so no cluster is gathered in a task.
    """
    from pyspark.sql import Window

    size = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.count_if("central").alias("n_central"), F.count_if("proven").alias("n_proven"))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("degree"), F.asc(row_id)))
    top = clusters.withColumn("place", place).where(F.col("place") <= most)
    top = top.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", row_id))), lambda s: s[row_id]).alias("typical"))
    return size.join(top, "cluster_id")
