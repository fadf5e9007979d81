import random

from tidemark import storage
from tidemark.operators import graph, growing


def found(spark, path):
    return {r.id: r.cluster for r in growing.labels(spark, path).collect()}


def test_days_one_after_another_equal_one_run(spark):
    r = random.Random(3)
    nodes = list(range(120))
    r.shuffle(nodes)  # smaller ids may come later
    edges = [(a, b) for a, b in (r.sample(range(120), 2) for _ in range(70))] + [(5, 5), (5, 999), (None, 3)]
    path, day = storage.scratch(spark, "components"), 30
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    moved = []
    for n in range(0, 120, day):
        here, before = set(nodes[: n + day]), set(nodes[:n])
        fresh = [e for e in edges if set(e) <= here and not set(e) <= before]
        report = {}
        growing.grow(frame([(i,) for i in nodes[n : n + day]], "id long"), frame(fresh or [(0, 0)], "a long, b long"), path, report)
        assert report["added"] == day
        moved.append(report["moved"])
    growing.grow(frame([(None,)], "id long"), frame([e for e in edges if None in e or 999 in e or e == (5, 5)], "a long, b long"), path)
    whole = graph.components(frame([(i,) for i in range(120)], "id long"), frame([e for e in edges if None not in e], "a long, b long"))
    assert found(spark, path) == {x.id: x.cluster for x in whole.collect()}
    report = {}
    growing.grow(frame([(i,) for i in range(120)], "id long"), frame(edges, "a long, b long"), path, report)  # all once more
    assert report == {"added": 0, "moved": 0} and sum(moved) < 120


def test_what_is_not_met_is_not_written_again(spark):
    path = storage.scratch(spark, "components")
    growing.grow(spark.range(50), spark.createDataFrame([(i, i + 1) for i in range(0, 50, 2)], "a long, b long"), path)
    report = {}
    growing.grow(spark.range(50, 53), spark.createDataFrame([(50, 4), (51, 52)], "a long, b long"), path, report)
    assert report == {"added": 3, "moved": 2} and found(spark, path)[50] == 4 and found(spark, path)[52] == 51
