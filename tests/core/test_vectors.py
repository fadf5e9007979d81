import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import tables, vectorindex, vectors


def unit_rows(n, size, seed, blobs=0, spread=0.15):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, size))
    if blobs:
        middles = r.normal(size=(blobs, size))
        x = middles[r.integers(0, blobs, n)] + spread * x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, x, blocks=None, first=0):
    return spark.createDataFrame([(i + first, v.tolist(), None if blocks is None else blocks[i]) for i, v in enumerate(x)], "id long, u array<double>, ticker string")


def plain_pairs(x, threshold, blocks=None):
    sims = np.round(x @ x.T, 5)
    return {(i, j) for i, j in zip(*np.nonzero(sims >= threshold), strict=True) if i < j and (blocks is None or blocks[i] == blocks[j])}


@pytest.mark.parametrize(("blobs", "threshold"), [(0, 0.3), (12, 0.8), (12, 0.95), (3, -0.5)])
def test_pairs_of_large_blocks_equal_all_pairs(spark, blobs, threshold):
    x = unit_rows(420, 6, 1, blobs)
    x[100:140] = x[100]  # one cell that must be cut
    blocks = ["hot" if i % 5 else "small" for i in range(420)]
    got = vectors.similar_pairs(table(spark, x, blocks), threshold, "ticker", part=30).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    assert {(r.a, r.b) for r in got} == plain_pairs(x, threshold, blocks)


def test_bounds_spare_comparisons(spark):
    x = unit_rows(1500, 8, 2, blobs=25)
    rows = table(spark, x)
    every = 1500 * 1499 // 2
    assert vectors.compared(rows, 0.85, part=40) < every / 4
    assert vectors.compared(rows, 0.85, part=2000) == every
    assert {(r.a, r.b) for r in vectors.similar_pairs(rows, 0.85, part=40).collect()} == plain_pairs(x, 0.85)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.0, 0.0], "a"), (4, None, "a"), (5, [1.0, 0.0], None), (6, [1.0, 0.0, 0.0], "a"), (7, [1.0, 0.0], "b")], "id long, u array<double>, ticker string")
    assert [(r.a, r.b) for r in vectors.similar_pairs(rows, 0.5, "ticker").collect()] == [(1, 2)]
    assert vectors.similar_pairs(rows.limit(0), 0.5).count() == 0
    anchors = vectors.as_queries(rows.where("id IN (1, 7)"), "ticker")
    got = {r.id: (r.anchor_id, r.sim) for r in vectors.assign(rows, anchors, 0.5, "ticker").collect()}
    assert got == {1: (1, 1.0), 2: (1, 1.0), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None), 7: (7, 1.0)}


def test_nearest_in_parts(spark, monkeypatch):
    x = unit_rows(300, 5, 3)
    x[7] = x[9]
    monkeypatch.setattr(vectors.in_blocks, "__defaults__", (37,))
    rows = table(spark, x)
    got = {(r.query_id, r["rank"]): r.id for r in vectors.nearest(rows, vectors.as_queries(rows.where("id % 10 = 7")), 4).collect()}
    sims = np.round(x @ x.T, 5)
    for q in range(7, 300, 10):
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-sims[q, i], i))[:4]
        assert [got[q, k] for k in range(1, 5)] == order
    wide = vectors.nearest(rows, vectors.as_queries(rows.where("id = 7")), 4, itself=True, slack=0.1).collect()
    least = sorted(sims[7])[-4] - 0.1
    assert {r.id for r in wide} == {i for i in range(300) if sims[7, i] >= least}


def test_index_finds_nine_of_ten_and_all_when_exact(spark, tmp_path):
    x = unit_rows(3000, 16, 4, blobs=40, spread=0.5)
    rows = table(spark, x)
    built = vectorindex.build(rows, str(tmp_path / "index"), cells=50)
    index = vectorindex.opened(spark, str(tmp_path / "index"))
    assert np.allclose(index.centroids, built.centroids) and spark.read.parquet(f"{index.path}/rows").count() == 3000
    asked = vectors.as_queries(rows.where("id % 50 = 0"))
    want = vectors.nearest(rows, asked, 10)
    found = vectorindex.search(spark, index, asked, 10, probes=10)
    assert vectorindex.recall(found, want) >= 0.9
    read = spark.read.parquet(f"{index.path}/rows").join(vectorindex.cells_of(index, asked.where("query_id = 0"), 10).select("cell"), "cell", "left_semi").count()
    assert read < 3000 / 2.5  # of a search, the probed cells alone
    exact = vectorindex.search(spark, index, asked, 10, probes=1, exact=True)
    assert sorted(map(tuple, exact.select("query_id", "id", "sim", "rank").collect())) == sorted(map(tuple, want.select("query_id", "id", "sim", "rank").collect()))


def test_index_of_few_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "id long, u array<double>")
    index = vectorindex.build(rows.where("id < 3"), str(tmp_path / "index"))
    got = vectorindex.search(spark, index, spark.createDataFrame([(1, [1.0, 0.0]), (9, [0.0, 1.0]), (8, [1.0])], "query_id long, q array<double>"), 3, probes=5)
    assert [(r.query_id, r.id) for r in got.collect()] == [(9, 1)]


@pytest.mark.parametrize(("blobs", "threshold", "part"), [(0, 0.6, 40), (0, 0.97, 3), (30, 0.95, 4), (3, -0.5, 40)])
def test_linked_rows_equal_components_of_all_pairs(spark, monkeypatch, blobs, threshold, part):
    x = unit_rows(420, 5, 3, blobs)
    blocks = ["hot" if i % 5 else "small" for i in range(420)]
    group = list(range(420))
    for _ in range(420):
        before = list(group)
        for a, b in plain_pairs(x, threshold, blocks):
            group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    rows = table(spark, x, blocks)
    assert {r.id: r.cluster for r in vectors.linked(rows, threshold, "ticker", part=part).collect()} == dict(enumerate(group))
    monkeypatch.setattr(vectors, "similar_pairs", None)  # no pair is written for clusters
    found = vectors.clusters(rows.selectExpr("*", "false AS anchor"), 0.9, threshold, "ticker")
    assert {r.id: r.cluster for r in found.collect()} == dict(enumerate(group))


def test_retrieval_of_one_group_in_parts(spark, monkeypatch):
    """All queries of one ticker met all its rows in one task, a row for each pair; odd vectors keep their places."""
    rng = np.random.default_rng(8)
    day = datetime.datetime(2024, 1, 1)
    odd = {3: None, 4: [1.0, None], 5: [1.0, 0.0, 0.0], 6: [0.0, 0.0], 50: [float("nan"), 1.0]}
    data = [(i, "A" if i % 9 else "B", day + datetime.timedelta(hours=int(rng.integers(0, 24 * 6))) if i % 11 else None, odd.get(i, rng.normal(size=2).tolist())) for i in range(1, 160)]
    df = vectors.with_unit(spark.createDataFrame(data, "id long, ticker string, published_at timestamp_ntz, v array<double>"))
    asked = vectors.as_queries(df.where("id % 10 = 0"), "ticker")
    monkeypatch.setattr(vectors._best_of_group, "__defaults__", (None, None, 16))
    pairs = df.join(asked, (F.col("ticker") == F.col("query_ticker")) & (F.col("id") != F.col("query_id"))).withColumn("sim", F.round(vectors.dot(F.col("u"), F.col("q")), 5)).withColumn("day", F.to_date("published_at"))
    best = [F.col("sim").desc(), F.col("id")]
    said = lambda d: sorted((r.query_id, r.id, str(r.sim), r["rank"]) for r in d.collect())
    for k, per_day in ((4, 1), (9, 2), (200, 3)):
        got = vectors.retrieve(df, asked, k, per_day)
        assert "zip_with(u" not in got._jdf.queryExecution().toString()
        assert said(got) == said(tables.top_per(tables.capped(pairs, ["query_id", "ticker", "day"], "sim", per_day), ["query_id"], best, k, rank="rank"))
    for least in (0.9, 0.999, 2.0):
        above = tables.top_per(pairs.where(F.col("sim") > least), ["query_id"], best, 1)
        assert {(r.query_id, r.id, str(r.sim)) for r in vectors.best_above(df, asked, least).collect()} == {(r.query_id, r.id, str(r.sim)) for r in above.collect()}
    newest = tables.top_per(pairs.withColumn("ok", F.col("id") % 3 > 0), ["query_id"], [F.col("published_at").desc(), F.col("id")], 15).where("ok")
    want = tables.top_per(tables.capped(newest, ["query_id", "day"], "sim", 2), ["query_id"], best, 5, rank="rank")
    assert said(vectors.retrieve_recent(df, asked, 5, 2, F.col("id") % 3 > 0)) == said(want)


def test_cells_of_rows_that_no_bounds_part(spark, monkeypatch):
    monkeypatch.setattr(vectors, "DISTANCES", 1 << 10)  # so many angles are held at once, whatever the block's rows
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v.tolist(), "b", 400) for i, v in enumerate(x)], "id long, u array<double>, block string, n long")
    placed = vectors._cells(rows, 1.2, 16).collect()
    assert sorted(r.id for r in placed if r.home) == list(range(400))
    assert len({(r.id, r.cell) for r in placed}) == len(placed) > 800 and all(list(x[r.id]) == r.u for r in placed)
    got = {(r.a, r.b) for r in vectors.similar_pairs(rows.select("id", "u"), 0.35, part=16).collect()}
    sims = np.round(x @ x.T, 5)
    assert got == {(a, b) for a in range(400) for b in range(a + 1, 400) if sims[a, b] >= 0.35}
