"""Near-duplicate vectors by a forest of random-projection trees with spill."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, sent
from .components import connected_components

TREES = 6
#: Vectors the trees are grown on, at most: those with the smallest hash of the id. All vectors are indexed.
SAMPLE_ROWS = 20_000
#: Vectors expected in a leaf, and the share of a node's vectors nearest to its threshold that goes to both sides.
LEAF, SPILL = 400, 0.10
#: Rows of the sample that a split is learned from, at least, and splits beyond those, at most.
FEW, DEEPEST = 32, 24
#: A leaf with more vectors is compared in pairs of blocks of this many, each pair a task's work of its own.
BLOCK = 1024


@dataclass
class Tree:
    """Inner nodes in order; a child >= 0 is a node, one below 0 the leaf -child - 1. A vector goes to the low
    side if its projection is under high, and to the high side if it is over low: to both in between.

    Where the sample is too small to tell more, a leaf is split on by ``levels`` planes through its
    sample's mean, with directions that all leaves of the tree share; ``band`` is as wide on either side.
    """

    normals: np.ndarray
    low: np.ndarray
    high: np.ndarray
    children: np.ndarray
    centres: np.ndarray
    levels: np.ndarray
    band: np.ndarray
    directions: np.ndarray

    @staticmethod
    def grow(x: np.ndarray, leaf: float, spill: float, rng: np.random.Generator, share: float = 1.0) -> Tree:
        """Splits x, a share of all vectors, at the median along random directions until a node stands for at most
        ``leaf`` vectors or has FEW rows. Nodes whose rows all project to one value can't be split: they
        stay leaves, however large."""
        normals, low, high, children = [], [], [], []
        centres, levels, band = [], [], []
        k = x.shape[1]
        width = NormalDist().inv_cdf(0.5 + spill / 2)

        def end(rows: np.ndarray, flat: bool) -> int:
            of = x[rows]
            stands = len(rows) / share
            centres.append(of.mean(0) if len(rows) else np.zeros(k))
            levels.append(0 if flat or stands <= leaf else min(DEEPEST, math.ceil(math.log2(stands / leaf))))
            band.append(width * math.sqrt(of.var(0).sum() / k) if len(rows) else 0.0)
            return -len(levels)

        def add(rows: np.ndarray) -> int:
            d = rng.standard_normal(k)
            d /= np.linalg.norm(d)
            p = x[rows] @ d
            mid = np.median(p) if len(rows) else 0.0
            flat = len(rows) > 0 and not (p.min() < mid or p.max() > mid)
            if len(rows) / share <= leaf or len(rows) <= FEW or flat:
                return end(rows, flat)
            lo, hi = np.quantile(p, [0.5 - spill / 2, 0.5 + spill / 2])
            left, right = rows[p <= hi], rows[p >= lo]
            if len(left) == len(rows) or len(right) == len(rows):
                return end(rows, True)
            me = len(normals)
            normals.append(d), low.append(lo), high.append(hi), children.append([0, 0])
            children[me] = [add(left), add(right)]
            return me

        add(np.arange(len(x)))
        directions = rng.standard_normal((DEEPEST, k))
        directions /= np.linalg.norm(directions, axis=1, keepdims=True)
        return Tree(
            np.array(normals).reshape(-1, k), np.array(low), np.array(high), np.array(children, dtype=int).reshape(-1, 2),
            np.array(centres).reshape(-1, k), np.array(levels), np.array(band), directions,
        )

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that each row of x reaches."""
        rows_out, leaf_out = [], []
        stack = [(0 if len(self.normals) else -1, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                r, path = self._deeper(x, rows, -node - 1)
                rows_out.append(r), leaf_out.append((-node - 1 << DEEPEST) + path)
                continue
            p = x[rows] @ self.normals[node]
            stack.append((self.children[node, 0], rows[p <= self.high[node]]))
            stack.append((self.children[node, 1], rows[p >= self.low[node]]))
        return np.concatenate(rows_out or [np.zeros(0, int)]), np.concatenate(leaf_out or [np.zeros(0, int)])

    def _deeper(self, x: np.ndarray, rows: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        path = np.zeros(len(rows), int)
        n = self.levels[leaf]
        if n:
            side = (x[rows] - self.centres[leaf]) @ self.directions[:n].T
            at = np.arange(len(rows))
            for j in range(n):
                p = side[at, j]
                up, down = p >= -self.band[leaf], p <= self.band[leaf]
                at, path = np.concatenate([at[down], at[up]]), np.concatenate([path[down], path[up] | 1 << j])
            rows = rows[at]
        return rows, path


def grow_forest(x: np.ndarray, share: float, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = 42) -> list[Tree]:
    """Trees over a sample that is ``share`` of all vectors."""
    return [Tree.grow(x, leaf, spill, np.random.default_rng([seed, t]), share) for t in range(trees)]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _numpy(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def near(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, trees: int = TREES) -> DataFrame:
    """(id, n_links, component) for each row of vectors: how many others it links with, and the smallest id that
    links lead to. Vectors link when their cosine, in double precision, is at least threshold.

    Equal vectors are one node. Each tree sends a node to one leaf, or to several where it lies near a
    split's threshold. Nodes of a leaf are compared as a matrix product. A pair that meets again in
    a later leaf is known by the leaves both have come to before, and counted the first time only;
    so no pair leaves the comparison, just each node's number of links and a spanning forest.
    Leaves too large for one task are compared block by block.

    Vectors that are null, empty, zero or hold null or non-finite parts link with nothing; so do
    vectors of different lengths. Repeated rows are vectors of their own and link with each other,
    unless their vector links with nothing; ids that repeat do so with each row. An empty table
    gives an empty one.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = F.coalesce(finite & F.exists("v", lambda c: c != 0), F.lit(False))
    v = v.withColumn("usable", usable)
    zero = F.transform("v", lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c))  # -0.0 is 0.0
    classes = Table(
        v.where("usable").groupBy(zero.alias("v")).agg(F.min("id").alias("node"), F.count("*").alias("copies")).withColumn("uid", F.monotonically_increasing_id()),
        "forest-nodes",
    ).df
    dims = [r.dim for r in classes.select(F.size("v").alias("dim")).distinct().collect()]
    found = None
    for dim in sorted(dims):
        one = _one_length(classes.where(F.size("v") == dim), dim, threshold, trees)
        found = one if found is None else tuple(a.unionByName(b) for a, b in zip(found, one))
    alone = v.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), "usable")
    if found is None:
        return alone.drop("usable")
    links, edges = found
    comp = connected_components(edges)
    nodes = (
        classes.join(links.groupBy("uid").agg(F.sum("links").alias("links")), "uid", "left")
        .join(comp.withColumnRenamed("node", "uid"), "uid", "left")
        .select("v", "node", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "uid").alias("root"))
    )
    nodes = Table(nodes, "forest-roots").df
    smallest = nodes.groupBy("root").agg(F.min("node").alias("component"))
    nodes = nodes.join(smallest, "root").select(F.col("v").alias("nv"), "copies", "links", "component")
    linked = v.where("usable").select("id", zero.alias("v")).join(nodes, F.col("v") == F.col("nv"))
    linked = linked.select("id", (F.col("copies") - 1 + F.col("links")).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
    return linked.unionByName(alone.where(~F.col("usable")).drop("usable"))


def _one_length(classes: DataFrame, dim: int, threshold: float, trees: int) -> tuple[DataFrame, DataFrame]:
    """(uid, links) and (src, dst) among nodes of one vector length."""
    spark = classes.sparkSession
    n = classes.count()
    sample = classes.select("v", F.xxhash64("node").alias("h")).orderBy("h").limit(SAMPLE_ROWS).select("v").toArrow()
    x = unit(_numpy(sample.column("v").combine_chunks(), dim))
    forest = sent(spark, grow_forest(x, len(x) / max(n, 1), trees))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = forest()
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(_numpy(b.column("v"), dim))
            rows, keys = [], []
            for t, tree in enumerate(grown):
                r, leaf = tree.leaves(x)
                rows.append(r), keys.append(leaf.astype(np.int64) * len(grown) + t)
            rows, keys = np.concatenate(rows), np.concatenate(keys)
            order = np.lexsort((keys, rows))
            offsets = np.searchsorted(rows[order], np.arange(b.num_rows + 1))
            met = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[order]))
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("copies"), b.column("v"), met], ["uid", "copies", "v", "met"])

    routed = classes.select("uid", "copies", "v").mapInArrow(route, "uid long, copies long, v array<double>, met array<long>")
    routed = Table(routed, "forest-routed").df
    at = routed.select("*", F.explode("met").alias("leaf"))
    sizes = at.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    at = at.join(sizes.where("blocks > 1"), "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    at = at.withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = at.select("uid", "copies", "v", "met", "leaf", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def compare(group: pa.Table) -> pa.Table:
        return _compare(group, dim, threshold)

    got = at.groupBy("leaf", "a", "b").applyInArrow(compare, "uid long, links long, to array<long>")
    got = Table(got, "forest-links").df
    return got.select("uid", "links"), got.select(F.col("uid").alias("src"), F.explode("to").alias("dst"))


def _compare(group: pa.Table, dim: int, threshold: float) -> pa.Table:
    """Links among the rows of a leaf, or between its two blocks: for each row the copies it links with that it
    didn't meet before, and its edges of a spanning forest of all links."""
    col = lambda c: group.column(c).combine_chunks()
    leaf, a, b = (group.column(c)[0].as_py() for c in ("leaf", "a", "b"))
    uid, copies, own = col("uid").to_numpy(), col("copies").to_numpy(), col("own").to_numpy()
    raw = _numpy(col("v"), dim)
    norms = np.linalg.norm(raw, axis=1)
    met = col("met")
    flat, offsets = met.flatten().to_numpy(), met.offsets.to_numpy()
    left = np.flatnonzero(own == a)
    right = left if a == b else np.flatnonzero(own == b)
    links, parent = np.zeros(len(uid), dtype=np.int64), np.arange(len(uid))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    to: list[list[int]] = [[] for _ in range(len(uid))]
    # leaves before this one, as (row, leaf) bits: rows that share one have been counted there
    row_of = np.repeat(np.arange(len(uid)), np.diff(offsets))
    earlier = flat < leaf
    seen, column = np.unique(flat[earlier], return_inverse=True)
    before = np.zeros((len(uid), len(seen)), dtype=np.float32)
    before[row_of[earlier], column] = 1
    for at in range(0, len(left), 512):
        part = left[at : at + 512]
        dots = raw[part] @ raw[right].T
        near = dots / norms[part][:, None] / norms[right][None, :] >= threshold
        if a == b:
            near &= part[:, None] < right[None, :]
        i, j = np.nonzero(near)
        i, j = part[i], right[j]
        if not len(i):
            continue
        fresh = np.zeros(len(i), dtype=bool)
        for k in range(0, len(i), 1 << 16):
            s = slice(k, k + (1 << 16))
            fresh[s] = np.einsum("ij,ij->i", before[i[s]], before[j[s]]) == 0
        np.add.at(links, i[fresh], copies[j[fresh]])
        np.add.at(links, j[fresh], copies[i[fresh]])
        while len(i):  # unite, a batch of independent roots at a time
            ri, rj = np.array([root(x) for x in i]) if len(i) < 64 else _roots(parent, i), np.array([root(x) for x in j]) if len(j) < 64 else _roots(parent, j)
            apart = ri != rj
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            if not len(i):
                break
            hi, lo = np.maximum(ri, rj), np.minimum(ri, rj)
            _, first = np.unique(hi, return_index=True)
            parent[hi[first]] = lo[first]
            for x, y in zip(i[first], j[first]):
                to[x].append(int(uid[y]))
    some = np.flatnonzero((links > 0) | np.array([bool(t) for t in to]))
    return pa.table({"uid": uid[some], "links": links[some], "to": pa.array([to[k] for k in some], pa.list_(pa.int64()))})


def _roots(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    r = parent[i]
    while True:
        up = parent[r]
        if (up == r).all():
            return r
        r = up
