"""Centroid clustering: Lloyd's rounds over two trees (Curtin, "A dual-tree algorithm for fast k-means", 2017).

Each block of vectors is kept as a cover tree, built once; the centroids get one in each round. A pair of nodes is dropped
where even its nearest members lie farther apart than the vectors of the one node lie from some centroid at most; where
one centroid is left, a whole node is assigned without a look at its vectors, and what is left at the leaves is compared
exactly, in whole numbers. So no bound can change a result, nor can the way in which vectors fall into blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import discard, stored
from tidemark.llm.points import floors, joined, matrix, squares, with_points

#: Vectors of a block at most, and vectors that a leaf may hold.
BLOCK, LEAF = 1024, 24
NODE = np.dtype([("centre", "<i4"), ("radius", "<f8"), ("begin", "<i4"), ("loose", "<i4"), ("end", "<i4"), ("child", "<i4"), ("children", "<i4")])


@dataclass
class Tree:
    """Points in the order of the tree, and its nodes, the root first.

    A node has the points from begin to end, all within radius of its centre. Those up to loose belong to no child; its
    children are `children` nodes from `child` on, with the other points in order.
    """

    points: np.ndarray
    nodes: np.ndarray

    @property
    def values(self) -> np.ndarray:
        return self.points[self.nodes["centre"]]


def cover_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, Tree]:
    """The order of the points, and their cover tree.

    The children of a node whose points lie within 2**i of its centre lie within 2**(i-1) of theirs, and more than that
    from each other's centres; levels without a branch are left out, and a child of one point stays a loose point. All
    distances of the points, a block at most, are held at once.
    """
    order, nodes = np.arange(len(points)), []
    apart = np.sqrt(squares(points, points).astype(np.float64))
    todo: list[tuple[int, int, int, np.ndarray]] = []

    def node(centre: int, begin: int, end: int, far: np.ndarray) -> None:
        nodes.append([centre, float(far.max(initial=0.0)), begin, end, end, 0, 0])
        todo.append((len(nodes) - 1, begin, end, far))

    if len(points):
        node(0, 0, len(points), apart[0])
    while todo:
        at, begin, end, far = todo.pop(0)
        if end - begin <= leaf or not nodes[at][1]:
            continue
        reach = 2.0 ** (np.ceil(np.log2(nodes[at][1])) - 1)
        left, groups, loose, centre = order[begin:end].copy(), [], [], nodes[at][0]
        while len(left):
            near = far <= reach
            if near.sum() > 1:
                groups.append((centre, left[near], far[near]))
            else:
                loose.append(left[near])
            left = left[~near]
            if len(left):
                centre = left[0]
                far = apart[centre, left]
        order[begin:end] = np.concatenate([*loose, *(g[1] for g in groups)])
        nodes[at][3], nodes[at][5], nodes[at][6] = begin + sum(map(len, loose)), len(nodes), len(groups)
        begin = nodes[at][3]
        for centre, members, near in groups:
            node(centre, begin, begin + len(members), near)
            begin += len(members)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    made = np.array([(place[n[0]], *n[1:]) for n in nodes], NODE)
    return order, Tree(points[order], made)


class Centroids:
    """Numbered centroids with the tree of a round."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        numbers, self.tree = cover_tree(values, leaf=1)
        n = self.tree.nodes
        self.centres, self.radius = self.tree.values.astype(np.float64), n["radius"]
        self.members = [np.sort(numbers[b:e]) for b, e in zip(n["begin"], n["end"], strict=True)]
        # below a node: its children, and its loose centroids
        self.below = [(np.arange(x["child"], x["child"] + x["children"]), numbers[x["begin"] : x["loose"]]) for x in n]
        self.real = values.astype(np.float64)

    def nearest(self, tree: Tree) -> tuple[np.ndarray, int]:
        """The centroid of each point of a tree (ties: the smaller number), and how many distances were computed."""
        out, spent = np.empty(len(tree.points), np.int32), 0
        if not len(tree.points):
            return out, 0
        nodes, centres = tree.nodes, tree.values.astype(np.float64)
        none = np.zeros(0, np.int64)
        todo = [(0, np.zeros(1, np.int64), none)]  # a node of vectors, nodes of centroids, single centroids
        while todo:
            q, inner, single = todo.pop()
            x = nodes[q]
            r = float(x["radius"])
            while True:
                far = np.sqrt(((np.concatenate([self.centres[inner], self.real[single]]) - centres[q]) ** 2).sum(1))
                spent += len(far)
                most = (far.min() + r) * (1 + 1e-9) + 1e-6
                a, b = far[: len(inner)], far[len(inner) :]
                inner, single = inner[a - self.radius[inner] - r <= most], single[b - r <= most]
                if not len(inner) or self.radius[inner].max() <= r and x["children"]:
                    break  # the node of vectors is the larger one
                opened = [self.below[i] for i in inner]
                inner, single = np.concatenate([none, *(o[0] for o in opened)]), np.concatenate([single, *(o[1] for o in opened)])
            begin, loose, end = int(x["begin"]), int(x["loose"]), int(x["end"])
            if not len(inner) and len(single) == 1:
                out[begin:end] = single[0]
                continue
            if loose > begin:
                left = np.sort(np.concatenate([single, *(self.members[i] for i in inner)]))
                d = squares(tree.points[begin:loose], self.values[left])
                spent += d.size
                out[begin:loose] = left[d.argmin(1)]
            todo += [(c, inner, single) for c in range(x["child"], x["child"] + x["children"])]
        return out, spent


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of vectors as trees: keys (array), points and nodes (binary). No shuffle."""
    key = vectors.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("keys", T.ArrayType(key)), T.StructField("points", T.BinaryType()), T.StructField("nodes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[pa.Array] = []
        points: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            order, tree = cover_tree(np.concatenate(points), LEAF)
            names = pa.concat_arrays(keys).take(pa.array(order))
            rows = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
            return pa.RecordBatch.from_arrays([rows, pa.array([tree.points.astype("<i4").tobytes()]), pa.array([tree.nodes.tobytes()])], names=["keys", "points", "nodes"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if sum(map(len, points)) + part.num_rows > BLOCK:
                    yield block()
                    keys.clear()
                    points.clear()
                keys.append(part.column(0))
                points.append(matrix(part.column(1), size))
        if points and sum(map(len, points)):
            yield block()

    return vectors.select("vec_id", "point").mapInArrow(run, schema)


def _trees(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, Tree]]:
    names = batch.schema.names
    keys = batch.column(names.index("keys")) if "keys" in names else None
    for i in range(batch.num_rows):
        points = np.frombuffer(batch.column(names.index("points"))[i].as_py(), "<i4").reshape(-1, size).astype(np.int64)
        yield keys[i].values if keys is not None else None, Tree(points, np.frombuffer(batch.column(names.index("nodes"))[i].as_py(), NODE))


def _sums(blocks: DataFrame, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums and counts of the vectors of each centroid, and the distances computed; a task gives a row for each centroid."""
    k, size = values.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, total, spent = Centroids(values), np.zeros((k, size + 1), np.int64), 0
        for batch in batches:
            for _, tree in _trees(batch, size):
                found, n = centroids.nearest(tree)
                spent += n
                order = np.argsort(found, kind="stable")
                edges = np.flatnonzero(np.diff(found[order], prepend=-1))
                at = found[order][edges]
                total[at, 1:] += np.add.reduceat(tree.points[order], edges, axis=0)
                total[:, 0] += np.bincount(found, minlength=k)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array([*range(k), -1], pa.int32()), "sums": pa.array([*total.tolist(), [spent]], pa.list_(pa.int64()))})

    rows = blocks.select("points", "nodes").mapInArrow(run, "cluster int, sums array<long>")
    total, spent = np.zeros((k, size + 1), np.int64), 0
    for r in rows.select("cluster", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("s").alias("s")).collect():  # k * (size + 1) numbers
        if r["cluster"] < 0:
            spent = r["s"]
        else:
            total[r["cluster"], r["at"]] = r["s"]
    return total[:, 1:], total[:, 0], spent


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, salt: str = "2:", key: str = "vec_id", vector: str = "embedding", costs: list[int] | None = None
) -> DataFrame:
    """One row per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors without exactly `size` components, and those with a null or a component that is null or not finite, are left
    out. A component x counts as floor(scale * x), held within 2**26 of 0. The first centroids are the k vectors with the
    smallest sha256 of salt and key, a null key last, equal keys by their components; fewer vectors give fewer centroids,
    none an empty result. A vector goes to the nearest centroid, the smaller number if several are as near; a centroid
    without vectors stays. Repeated rows count each; other columns are not looked at. The driver holds the centroids and
    their sums. `costs`, if given, takes the distances computed in each round.
    """
    at = F.col(f"`{key}`")
    made = with_points(vectors, vector, scale, size, [at.alias("vec_id")])
    first = made.select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("h"), "point").orderBy(F.asc_nulls_last("h"), "point").limit(k)
    values = np.array([r["point"] for r in first.collect()], np.int64).reshape(-1, size)
    schema = f"vec_id {made.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    final = [("cluster", "int"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")]
    spark = vectors.sparkSession
    if not len(values):
        return made.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), *(F.lit(None).cast(t).alias(n) for n, t in final[1:])).limit(0)
    blocks = stored(_blocks(made, size), "cluster-blocks")
    for _ in range(rounds):
        sums, counts, spent = _sums(blocks, values)
        values = floors(sums, counts, values)
        if costs is not None:
            costs.append(spent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(values)
        for batch in batches:
            for keys, tree in _trees(batch, size):
                found, _ = centroids.nearest(tree)
                d = tree.points - values[found]
                yield pa.RecordBatch.from_arrays([keys, pa.array(found, pa.int32()), pa.array((d * d).sum(1), pa.int64())], names=["vec_id", "cluster", "distance"])

    assigned = stored(blocks.mapInArrow(run, schema), "cluster-assigned")
    discard(blocks)
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    about = [(i, s, sum(inertia.values()), hashlib.sha256(joined(values[i]).encode()).hexdigest()) for i, s in sorted(inertia.items())]
    return assigned.join(F.broadcast(spark.createDataFrame(about, ", ".join(f"{n} {t}" for n, t in final))), "cluster").select("vec_id", "cluster", "distance", *(n for n, _ in final[1:]))


