import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, point int"


def grid(v, scale):
    return [math.floor(scale * x) for x in v]


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def plain(rows, k, rounds, size, scale):
    kept = [(i, grid(v, scale)) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]
    for n in range(rounds + 1):
        at = [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in kept]
        if n == rounds:
            break
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    d = [far(v, c[a]) for (_, v), a in zip(kept, at, strict=True)]
    return sorted(
        ((i, a, e, sum(y for x, y in zip(at, d, strict=True) if x == a), sum(d), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), a, e in zip(kept, at, d, strict=True)),
        key=repr,
    )


def vectors(n, size, seed, blobs=6):
    r = random.Random(seed)
    middles = [[r.uniform(-2, 2) for _ in range(size)] for _ in range(blobs)]
    return [(i, [float(np.float32(m + r.gauss(0, 0.2))) for m in middles[i % blobs]]) for i in range(n)]


@pytest.mark.parametrize(("size", "n", "k"), [(3, 700, 40), (8, 500, 7), (64, 160, 40), (2, 12, 40)])
def test_rows_equal_plain_rounds(spark, monkeypatch, size, n, k):
    monkeypatch.setattr(clusters, "BLOCK", 64)
    monkeypatch.setattr(clusters, "LEAF", 5)
    rows = vectors(n, size, n)
    rows += [(n, None), (n + 1, [float("nan")] * size), (n + 2, [None] * size), (n + 3, [float("inf")] + [0.0] * (size - 1)), (n + 4, [0.5] * (size + 1)), (None, [0.25] * size), (3, rows[3][1]), (3, rows[3][1]), (n + 5, [])]
    rows += [(n + 9 + i, [0.1] * size) for i in range(40)]  # copies: ties among first centroids
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(3)
    got = clusters.cluster(df, k=k, rounds=4, size=size)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, k, 4, size, 256)


def test_no_vectors(spark):
    for rows in ([], [(1, None, 2, "x", 3)]):
        got = clusters.cluster(spark.createDataFrame(rows, SCHEMA))
        assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_tree_covers_and_separates():
    points = np.array(grid(sum((v for _, v in vectors(900, 4, 1)), []), 256), np.int64).reshape(-1, 4)
    points[50:80] = points[50]
    order, tree = clusters.cover_tree(points, leaf=8)
    assert sorted(order.tolist()) == list(range(900)) and (tree.points == points[order]).all()
    for x in tree.nodes:
        own = tree.points[x["begin"] : x["end"]]
        assert np.sqrt(((own - tree.points[x["centre"]]) ** 2).sum(1)).max() <= x["radius"] + 1e-9
        kids = tree.nodes[x["child"] : x["child"] + x["children"]]
        if len(kids):
            assert kids["begin"].tolist() == [x["loose"], *kids["end"][:-1].tolist()] and kids["end"][-1] == x["end"]
            reach = 2.0 ** (math.ceil(math.log2(x["radius"])) - 1)
            c = tree.points[kids["centre"]]
            gaps = np.sqrt(((c[:, None] - c) ** 2).sum(2)) + np.eye(len(c)) * 1e9
            assert gaps.min() > reach and kids["radius"].max() <= reach


def test_bounds_spare_distances_of_groups_that_lie_apart():
    points = np.array([grid(v, 256) for _, v in vectors(2000, 8, 2, blobs=10)], np.int64)
    _, tree = clusters.cover_tree(points, leaf=24)
    values = np.array([grid(v, 256) for _, v in vectors(10, 8, 2, blobs=10)], np.int64)
    found, spent = clusters.Centroids(values).nearest(tree)
    assert (found == clusters.squares(tree.points, values).argmin(1)).all()
    assert spent < 2000 * 10 / 4
