import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, delta int"


def plain(rows, rounds, scale, size):
    kept = [(i, [math.floor(scale * x) for x in v] + [0] * (-size % 4), n) for i, v, n in rows if v and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    w = (size + 3) // 4
    part = lambda v, p: v[p * w : (p + 1) * w]
    first = [v for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]]
    books = [[part(v, p) for v in first] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        at = [[min(range(len(books[p])), key=lambda j: (far(part(v, p), books[p][j]), j)) for p in range(4)] for _, v, _ in kept]
        if n == rounds:
            break
        for p in range(4):
            for j in set(a[p] for a in at):
                mine = [part(v, p) for (_, v, _), a in zip(kept, at, strict=True) if a[p] == j]
                books[p][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    error = [sum(far(part(v, p), books[p][a[p]]) for p in range(4)) for (_, v, _), a in zip(kept, at, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, bytes(a).hex(), e, sum(y for (_, _, m), y in zip(kept, error, strict=True) if m == n), digest) for (i, _, n), a, e in zip(kept, at, error, strict=True)), key=repr)


@pytest.mark.parametrize(("size", "n"), [(8, 400), (64, 300), (6, 90), (4, 600)])
def test_rows_equal_plain_rounds(spark, size, n):
    r = random.Random(n)
    rows = [(i * 3, [float(np.float32(r.choice((-1, 0, 1)) + r.gauss(0, 0.1))) for _ in range(size)], r.choice((1, 2, None))) for i in range(n)]
    rows += [(7, None, 1), (8, [float("nan")] * size, 1), (10, [None] * size, 2), (11, [float("-inf")] + [0.0] * (size - 1), 2), (13, [0.5] * (size + 1), 1), (None, [0.25] * size, 3), (14, [], None)]
    rows += [(1, [0.125] * size, None)] * 3 + [(2, [0.125] * size, 5)]  # equal entries at first: ties
    costs = []
    df = spark.createDataFrame([(i, v, m, "x", 2) for i, v, m in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, codes.compress(df, costs=costs).collect()), key=repr) == plain(rows, 4, 1024, size)
    assert len(costs) == 4 and costs[-1] <= costs[0]


def test_no_vectors(spark):
    for rows in ([], [(1, None, 2, "x", 3)]):
        got = codes.compress(spark.createDataFrame(rows, SCHEMA))
        assert got.collect() == [] and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_changes_keep_the_sums():
    r = np.random.default_rng(1)
    points = r.integers(-50, 50, (500, 8))
    total, old = np.zeros((4 * 16, 3), np.int64), None
    for _ in range(4):
        new = r.integers(0, 16, (500, 4)).astype(np.uint8)
        moved = codes.changes(points, new, old, 4, 16, total)
        assert moved == (2000 if old is None else int((new != old).sum()))
        for p in range(4):
            for j in range(16):
                own = points[new[:, p] == j, p * 2 : p * 2 + 2]
                assert total[p * 16 + j].tolist() == [len(own), *own.sum(0)]
        old = new


def test_large_components_stay_exact(spark):
    rows = [(i, [float(x)] * 4, 1) for i, x in enumerate((1e5, -1e5, 3e38, -3e38, 1e5))]
    got = codes.compress(spark.createDataFrame([(i, v, m, "", 0) for i, v, m in rows], SCHEMA)).collect()
    assert len(got) == 5 and all(x.error == 0 for x in got)
