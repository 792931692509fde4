"""Operator 13: centroid clustering filtered by ball trees.

A task cuts its vectors into blocks and builds a metric tree of each: a node is a ball with its radius about its own mean, the count of
its rows and their integer sum. The trees are written once. In a round a node keeps the centroids that may be nearest to any row of
its ball: by the triangle inequality all others are farther from each row than the one nearest to the ball's middle. If one is
left the whole ball is its, and its stored count and sum are added without a look at the rows; else its children are tried,
and at a leaf the rows are compared with the centroids left, in exact integers, ties to the smaller number. Radii are rounded up and a
centroid goes only if it is strictly farther, so the result is that of full comparison.

A round reads the trees and gives a row per cluster and task, added up on executors; the driver holds centroids only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, settle, worker_memory
from .lattice import added, exact, joined_sha256, partials, sound, squared, to_integers

#: Distances are compared with this much to spare, far more than floats are off.
_SPARE = 1e-9


@dataclass
class Tree:
    """A block's rows in the order of the tree, and its nodes, children behind their parents: rows begin to end, the left child (the
    right one follows it; 0: a leaf), radius, integer sum."""

    points: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    lefts: np.ndarray
    radii: np.ndarray
    sums: np.ndarray

    def middles(self, nodes: np.ndarray) -> np.ndarray:
        return self.sums[nodes] // np.maximum(self.ends[nodes] - self.begins[nodes], 1)[:, None]


def build(points: np.ndarray, leaf: int = 32) -> tuple[Tree, np.ndarray]:
    """The tree of a block, and the order in which it holds the block's rows. Nodes are halved at the median of their widest component."""
    order = np.arange(len(points))
    begins, ends, lefts, radii, sums = [0], [len(points)], [], [], []
    k = 0
    while k < len(begins):
        a, b = begins[k], ends[k]
        own = points[order[a:b]]
        total = own.sum(0)
        x, middle = exact(own, (total // (b - a))[None, :])
        sums.append(total)
        radii.append(float(np.sqrt(((x - middle) ** 2).sum(1).max().astype(float))) * (1 + _SPARE))
        spread = own.max(0) - own.min(0)
        if b - a > leaf and spread.max() > 0:
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, spread.argmax()], half)]
            lefts.append(len(begins))
            begins += [a, a + half]
            ends += [a + half, b]
        else:
            lefts.append(0)
        k += 1
    tree = Tree(points[order], *(np.array(v, np.int64) for v in (begins, ends, lefts)), np.array(radii), np.array(sums, np.int64))
    return tree, order


def filtered(tree: Tree, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(whole balls: node and centroid; rows compared; their centroids)."""
    balls, rows, near_rows = [], [], []
    nodes, alive = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    while len(nodes):
        d = np.where(alive, np.sqrt(np.maximum(squared(*exact(tree.middles(nodes), centroids)), 0).astype(float)), np.inf)
        near = d.argmin(1)
        best, r = d[np.arange(len(nodes)), near][:, None], tree.radii[nodes][:, None]
        alive &= d - r <= best + r + _SPARE * (d + best + r + 1)
        one, end = alive.sum(1) == 1, tree.lefts[nodes] == 0
        balls += zip(nodes[one].tolist(), near[one].tolist(), strict=True)
        if (leaves := np.flatnonzero(~one & end)).size:
            sizes = tree.ends[nodes[leaves]] - tree.begins[nodes[leaves]]
            at = np.repeat(tree.begins[nodes[leaves]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            x, c = exact(tree.points[at], centroids)
            far = squared(x, c)
            rows.append(at)
            near_rows.append(np.where(np.repeat(alive[leaves], sizes, axis=0), far, far.max() + 1).argmin(1))
        down = np.flatnonzero(~one & ~end)
        nodes = np.concatenate([tree.lefts[nodes[down]], tree.lefts[nodes[down]] + 1])
        alive = np.concatenate([alive[down], alive[down]])
    none = np.zeros(0, np.int64)
    return balls, np.concatenate(rows) if rows else none, np.concatenate(near_rows) if near_rows else none


def assigned(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each row, in the tree's order."""
    balls, rows, near = filtered(tree, centroids)
    out = np.zeros(len(tree.points), np.int64)
    for node, c in balls:
        out[tree.begins[node] : tree.ends[node]] = c
    out[rows] = near
    x, c = exact(tree.points, centroids)
    return out, ((x - c[out]) ** 2).sum(1).astype(np.int64)


def summed(tree: Tree, centroids: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
    """cluster: (count, sum) of a block."""
    balls, rows, near = filtered(tree, centroids)
    out = partials(near, tree.points[rows])
    for node, c in balls:
        n, x = out.get(c, (0, 0))
        out[c] = (n + int(tree.ends[node] - tree.begins[node]), x + tree.sums[node])
    return out


_TREES = "ids array<bigint>, points binary, begins array<int>, ends array<int>, lefts array<int>, radii array<double>, sums binary"


def trees(rows: DataFrame, width: int, scale: int, block: int = 4096, leaf: int = 32) -> DataFrame:
    """A row per block of (vec_id, v): its ids in the order of its tree, and the tree."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def made(ids: list, points: np.ndarray) -> pa.RecordBatch:
            tree, order = build(points, leaf)
            values = {"ids": [[ids[i] for i in order]], "points": [tree.points.astype("<i4").tobytes()], "begins": [tree.begins.tolist()], "ends": [tree.ends.tolist()], "lefts": [tree.lefts.tolist()], "radii": [tree.radii.tolist()], "sums": [tree.sums.astype("<i8").tobytes()]}
            numbers = pa.list_(pa.int32())
            types = (pa.list_(pa.int64()), pa.binary(), numbers, numbers, numbers, pa.list_(pa.float64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values.values(), types, strict=True)], names=list(values))

        with worker_memory("ball_tree"):
            ids, points, n = [], [], 0
            for batch in batches:
                for at in range(0, batch.num_rows, block):
                    some = batch.slice(at, block)
                    ids += some.column(0).to_pylist()
                    points.append(to_integers(some.column(1), scale, width))
                    n += some.num_rows
                    if n >= block:
                        whole = np.concatenate(points)
                        yield made(ids[:block], whole[:block])
                        ids, points, n = ids[block:], [whole[block:]], n - block
            if n:
                yield made(ids, np.concatenate(points))

    return rows.mapInArrow(run, _TREES)


def _trees_of(batch, width: int) -> Iterator[tuple[list, Tree]]:
    for r in batch.to_pylist():
        points, sums = np.frombuffer(r["points"], "<i4").astype(np.int64).reshape(-1, width), np.frombuffer(r["sums"], "<i8").reshape(-1, width)
        yield r.get("ids"), Tree(points, *(np.array(r[n], np.int64) for n in ("begins", "ends", "lefts")), np.array(r["radii"]), sums)


def cluster(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", width: int = 64, scale: int = 256, clusters: int = 40, rounds: int = 5, salt: str = "2:", block: int = 4096, leaf: int = 32
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of each vector that counts.

    Vectors with exactly ``width`` components, none null or non-finite, count; other rows, null vectors among them, are left out. Centroids start as the
    ``clusters`` rows of least SHA-256 of ``salt`` and vec_id (a null one as empty text; rows of one vec_id in order of their vectors), all
    rows if there are fewer; repeated rows count each. No rows: no clusters. Components whose squared distances don't fit 64
    bits are an error. Other columns don't matter, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("v")).where(sound(F.col("v")) & (F.size("v") == width))
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.withColumn("key", key).orderBy("key", "v").limit(clusters).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([[int(np.floor(float(x) * scale)) for x in r.v] for r in first], np.int64)
    work = Scratch(spark)
    forest = work.settle(trees(rows, width, scale, block, leaf))
    for _ in range(rounds):
        shared = work.broadcast(centroids)

        def sums(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            total: dict[int, tuple[int, np.ndarray]] = {}
            with worker_memory("ball_tree"):
                for batch in batches:
                    for at in range(0, batch.num_rows, 8):
                        for _, tree in _trees_of(batch.slice(at, 8), width):
                            for c, (n, x) in summed(tree, shared.value).items():
                                m, before = total.get(c, (0, 0))
                                total[c] = (m + n, before + x)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([x.tolist() for _, x in total.values()], pa.list_(pa.int64()))], names=["slot", "n", "sums"])

        found = added(forest.drop("ids").mapInArrow(sums, "slot int, n long, sums array<bigint>"))
        moved = centroids.copy()
        for c, (n, total) in found.items():
            moved[c] = [x // n for x in total]
        still = (moved == centroids).all()
        centroids = moved
        if still:  # every further round would find the same
            break
    shared = work.broadcast(centroids)

    def last(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with worker_memory("ball_tree"):
            for batch in batches:
                for at in range(0, batch.num_rows, 8):
                    for ids, tree in _trees_of(batch.slice(at, 8), width):
                        c, d = assigned(tree, shared.value)
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    final = settle(forest.mapInArrow(last, "vec_id long, cluster int, distance long"))
    inertia = {r["cluster"]: r["inertia"] for r in final.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # a row per centroid
    facts = [(c, inertia.get(c, 0), joined_sha256(x)) for c, x in enumerate(centroids)]
    each = spark.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string")
    work.drop()
    return final.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia"), "centroid_sha256")
