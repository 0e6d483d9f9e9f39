"""Density clusters tile by tile: a sorted grid of nodes, exact completion of what is known, and the tiles put together.

A cluster is a set of central nodes, each linked to the next by being at most eps apart, and of the nodes near them. A node
stands for all points of one block at one position and weighs as many. ``completed`` makes clusters exact from any
start, none or an approximate graph: it compares only what the start leaves open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctum.plans.shared import forget, written_once
from punctum.plans.tiling import tile_widths, tiled

#: Pairs compared at once, which bounds the memory of a tile.
PAIRS = 1 << 21


class Columns:
    """Nodes sorted by block and by columns of the x-y grid, so that all within ``eps`` of a node lie in three runs."""

    def __init__(self, block: np.ndarray, xyz: np.ndarray, eps: float):
        self.eps, self.eps2 = eps, eps * eps
        ix, iy = (np.floor(xyz[:, k] / eps).astype(np.int64) for k in (0, 1))
        ix -= ix.min(initial=0) - 1
        iy -= iy.min(initial=0) - 1
        self.rows = int(iy.max(initial=0)) + 3
        self.across = int(ix.max(initial=0)) + 3
        self.key = (block.astype(np.int64) * self.across + ix) * self.rows + iy
        self.order = np.argsort(self.key, kind="stable")
        self.sorted = self.key[self.order]
        self.block, self.xyz = block, xyz

    def runs(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place, in sorted order, of each node's three runs."""
        at = self.key[nodes][:, None] + np.array([-self.rows, 0, self.rows])
        return np.searchsorted(self.sorted, at - 1, "left"), np.searchsorted(self.sorted, at + 1, "right")

    def candidates(self, weight: np.ndarray) -> np.ndarray:
        """Weight of the nodes in each node's runs: no fewer points than are near it."""
        total = np.concatenate([[0], np.cumsum(weight[self.order])])
        lo, hi = self.runs(np.arange(len(self.key)))
        return (total[hi] - total[lo]).sum(axis=1)

    def near(self, nodes: np.ndarray, asked: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (node, other) within eps, the node itself included, in bounded batches; of these only the ``asked`` ones."""
        lo, hi = self.runs(nodes)
        lo, size, who = lo.ravel(), (hi - lo).ravel(), np.repeat(nodes, 3)
        upto = np.concatenate([[0], np.cumsum(size)])
        for start in range(0, int(upto[-1]), PAIRS):
            part = np.arange(start, min(start + PAIRS, int(upto[-1])))
            run = np.searchsorted(upto, part, "right") - 1
            node, other = who[run], self.order[lo[run] + part - upto[run]]
            if asked is not None:
                keep = asked(node, other)
                node, other = node[keep], other[keep]
            d = self.xyz[node] - self.xyz[other]
            hit = (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]) <= self.eps2
            yield node[hit], other[hit]

    def meets_others(self, nodes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(any, others): whether a node's runs hold a node with a group (none is -1), and one of another group than its own."""
        has = group[self.order] >= 0
        upto = np.concatenate([[0], np.cumsum(has)])
        g = group[self.order][has]
        change = np.concatenate([[0], np.cumsum(g[1:] != g[:-1])]) if len(g) else np.zeros(0, np.int64)
        lo, hi = (upto[x] for x in self.runs(nodes))
        some = hi > lo
        if not len(g):
            return some.any(axis=1), np.zeros(len(nodes), bool)
        first, last = np.minimum(lo, len(g) - 1), np.maximum(hi - 1, 0)
        mixed = some & ((change[last] != change[first]) | (g[first] != group[nodes][:, None]))
        return some.any(axis=1), mixed.any(axis=1)

    def same_cell(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of ``nodes`` that follow each other in a cube of diagonal eps, so that all nodes in a cube are linked."""
        if not len(nodes):
            return nodes, nodes
        cell = np.floor(self.xyz[nodes] / (self.eps / 3**0.5 * (1 - 1e-9))).astype(np.int64)
        o = np.lexsort((cell[:, 2], cell[:, 1], cell[:, 0], self.block[nodes]))
        same = (cell[o][1:] == cell[o][:-1]).all(axis=1) & (self.block[nodes][o][1:] == self.block[nodes][o][:-1])
        return nodes[o][:-1][same], nodes[o][1:][same]


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest linked node of each of ``n`` nodes, by minimum labels and pointer jumping."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


@dataclass
class TileClusters:
    """What the nodes of a tile came to.

    central; degree, a weight to rank members by; label, the cluster's smallest id of a central point, or -1; border,
    (node, label) for every node that isn't central and every cluster near it; proven, True where the start alone told
    that a node is central, or near the cluster it borders on.
    """

    central: np.ndarray
    degree: np.ndarray
    label: np.ndarray
    border: tuple[np.ndarray, np.ndarray]
    proven: np.ndarray


_NONE = np.zeros(0, np.int64)


def completed(grid: Columns, weight: np.ndarray, smallest: np.ndarray, least: np.ndarray, a: np.ndarray = _NONE, b: np.ndarray = _NONE) -> TileClusters:
    """The exact clusters of the nodes of ``grid``, from near pairs (a, b) that are already known, each once.

    Weight near a node is counted over the known pairs; only nodes that these don't prove central, and that have enough
    weight in reach at all, are compared with all around them. Central nodes are joined by the known pairs and within
    cubes of diagonal eps; only nodes with more than one such group around them are compared further. Nodes that aren't
    central are compared unless a known pair leads to the one group around them.
    """
    n = len(weight)
    count = weight + np.bincount(a, weight[b], n).astype(np.int64) + np.bincount(b, weight[a], n).astype(np.int64)
    proven = count >= least
    open_ = np.flatnonzero(~proven & (grid.candidates(weight) >= least))
    count[open_] = 0
    for node, other in grid.near(open_):
        count += np.bincount(node, weight[other], n).astype(np.int64)
    central = count >= least
    known = central[a] & central[b]
    ca, cb = grid.same_cell(np.flatnonzero(central))
    piece = joined(n, np.concatenate([a[known], ca]), np.concatenate([b[known], cb]))
    piece[~central] = -1
    at = np.flatnonzero(central)
    at = at[grid.meets_others(at, piece)[1]]
    ja, jb = [_NONE], [_NONE]
    for node, other in grid.near(at, lambda x, y: (piece[y] >= 0) & (piece[y] < piece[x])):
        pair = np.unique(piece[node] * n + piece[other])
        ja.append(pair // n)
        jb.append(pair % n)
    cluster = np.where(central, joined(n, np.concatenate(ja), np.concatenate(jb))[piece], -1)
    # nodes that aren't central
    ba, bb = np.concatenate([a, b]), np.concatenate([b, a])
    edge = ~central[ba] & central[bb]
    told = np.full(n, -1)
    told[ba[edge]] = cluster[bb[edge]]
    proven = np.where(central, proven, told >= 0)
    rest = np.flatnonzero(~central)
    some, others = grid.meets_others(rest, np.where(central, cluster, told))
    # around a node without a known pair its own group is -1, so whatever is there is another one
    look = rest[some & others]
    sure = np.setdiff1d(np.flatnonzero(told >= 0), look, assume_unique=True)
    nodes, clusters = [sure], [told[sure]]
    for node, other in grid.near(look, lambda x, y: central[y]):
        pair = np.unique(node * n + cluster[other])
        nodes.append(pair // n)
        clusters.append(pair % n)
    least_id = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least_id, cluster[central], smallest[central])
    label = np.where(central, least_id[np.maximum(cluster, 0)], -1)
    node, by = np.concatenate(nodes), np.concatenate(clusters)
    pair = np.unique(node * n + by)
    return TileClusters(central, np.zeros(n), label, (pair // n, least_id[pair % n]), proven)


Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], TileClusters]


def exact_clusters(eps: float) -> Kernel:
    """A kernel (block, xyz, weight, smallest, least) that starts from nothing."""

    def run(block: np.ndarray, xyz: np.ndarray, weight: np.ndarray, smallest: np.ndarray, least: np.ndarray) -> TileClusters:
        return among_candidates(block, xyz, weight, smallest, least, eps, lambda grid, w, s, m: completed(grid, w, s, m))

    return run


def among_candidates(block: np.ndarray, xyz: np.ndarray, weight: np.ndarray, smallest: np.ndarray, least: np.ndarray, eps: float, cluster: Callable[[Columns, np.ndarray, np.ndarray, np.ndarray], TileClusters]) -> TileClusters:
    """``cluster`` run without the nodes that have nothing near them and so can't be in a cluster."""
    n = len(block)
    out = TileClusters(np.zeros(n, bool), np.zeros(n), np.full(n, -1), (_NONE, _NONE), np.zeros(n, bool))
    if not n:
        return out
    keep = np.flatnonzero(Columns(block, xyz, eps).candidates(weight) >= min(2, int(least.min())))
    if not len(keep):
        return out
    c = cluster(Columns(block[keep], xyz[keep], eps), weight[keep], smallest[keep], least[keep])
    out.central[keep], out.degree[keep], out.label[keep], out.proven[keep] = c.central, c.degree, c.label, c.proven
    out.border = (keep[c.border[0]], c.border[1])
    return out


_SCHEMA = "row_id long, label long, central boolean, shared boolean, owned boolean, degree double, proven boolean, copies long"


def _tile_kernel(cluster: Kernel, eps: float, width: float, named: Sequence[str] = ()):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        level, tx, ty = (key[i].as_py() for i in range(-3, 0))
        w = tile_widths(width, 2 * eps)[level]
        ident = t["row_id"].to_numpy()
        _, one = np.unique(ident, return_index=True)  # a point delivered again counts once
        t, ident = t.take(one), ident[one]
        block = t["block"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        xyz = np.stack([t[c].to_numpy() for c in ("x", "y", "z")], axis=1) + 0.0
        copies, least = t["copies"].to_numpy(), t["least"].to_numpy()
        _, first, inv = np.unique(np.column_stack([block, xyz]), axis=0, return_index=True, return_inverse=True) if len(ident) else (None, _NONE, _NONE)
        inv = inv.ravel()
        weight = np.bincount(inv, copies, len(first)).astype(np.int64)
        smallest = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(smallest, inv, ident)
        c = cluster(block[first], xyz[first], weight, smallest, least[first])
        off = xyz[:, :2] - np.array([tx, ty]) * w
        owned = ((off >= 0) & (off < w)).all(axis=1)
        deep = ((off > eps) & (off < w - eps)).all(axis=1)  # no other tile tells its label
        reach = ((off >= -eps) & (off <= w + eps)).all(axis=1)  # where central is certain
        rows = np.flatnonzero(c.central[inv] & reach)
        label, central = c.label[inv[rows]], np.ones(len(rows), bool)
        # points that aren't central, with each cluster they touch
        node, touch = c.border
        o = np.argsort(inv, kind="stable")
        lo, hi = np.searchsorted(inv[o], node, "left"), np.searchsorted(inv[o], node, "right")
        size = hi - lo
        which = np.repeat(np.arange(len(node)), size)
        more = o[np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        mine = owned[more]
        rows, label = np.concatenate([rows, more[mine]]), np.concatenate([label, touch[which][mine]])
        central = np.concatenate([central, np.zeros(mine.sum(), bool)])
        names = {c: t[c].take(rows) for c in named}
        return pa.table({**names, "row_id": ident[rows], "label": label, "central": central, "shared": central & ~deep[rows], "owned": owned[rows], "degree": c.degree[inv[rows]], "proven": c.proven[inv[rows]], "copies": copies[rows]})

    return run


def clusters_by_tiles(points: DataFrame, keys: Sequence[str], cluster: Kernel, groups: Callable[[DataFrame], DataFrame], *, eps: float, width: float, most: int, named: bool = False) -> DataFrame:
    """(row_id, cluster_id, central, degree, proven) of all points in clusters, each once; ``named`` adds keys and block.

    ``points`` has keys, row_id, block, x, y, z (finite) and least, the weight that makes a node of its block central.
    ``cluster`` works on one tile with a rim of 2 eps; ``groups`` turns links (a, b) between labels of neighbouring tiles
    into (node, root). Where a tile holds more than ``most`` rows, copies at one position become one row with their number
    before anything is gathered, crowded tiles are taken block by block and cut up, and copies get their rows back at the end.
    """
    k = list(keys)
    cut_up, collapsed = tiled(points.withColumn("copies", F.lit(1).cast("long")), k, block="block", row_id="row_id", width=width, rim=2 * eps, most=most)
    names = [*k, "block"] if named else []
    schema = ", ".join([*(f"{c} {points.schema[c].dataType.simpleString()}" for c in names), _SCHEMA])
    found = cut_up.groupBy(*k, "part", "level", "tx", "ty").applyInArrow(_tile_kernel(cluster, eps, width, names), schema)
    found = written_once(found, "clusters")
    seen = found.where("shared").select("row_id", "label")
    least = seen.groupBy("row_id").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("row_id", "low")
    links = seen.join(least, "row_id").where("label <> low").select(F.col("low").alias("a"), F.col("label").alias("b")).distinct()
    roots = groups(links).select(F.col("node").alias("label"), "root")
    rows = found.where("owned").join(roots, "label", "left").withColumn("label", F.coalesce("root", "label"))
    rows = rows.groupBy(*names, "row_id").agg(F.min("label").alias("cluster_id"), F.max("central").alias("central"), F.max("degree").alias("degree"), F.max("proven").alias("proven"), F.max("copies").alias("copies"))
    if collapsed is None:
        return rows.drop("copies")
    place = [*k, "block", "x", "y", "z"]
    several = collapsed.where("copies > 1").select("row_id", *place).join(rows.where("copies > 1").drop("copies", *names), "row_id").drop("row_id")
    back = points.select("row_id", *place).distinct().join(several, place).drop(*(c for c in place if c not in names))
    return rows.where("copies = 1").drop("copies").unionByName(back)
