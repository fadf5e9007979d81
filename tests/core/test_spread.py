"""Joins in time spread over days, groups in order, matrices in blocks: all against plain loops."""

import datetime
import difflib
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import graph, longstories, search, stories, tables
from tidemark.operators import vectors as vec

DAY = datetime.datetime(2024, 1, 1)


def times(rng, n):
    return [None if rng.random() < 0.05 else DAY + datetime.timedelta(hours=rng.randrange(0, 24 * 20)) for _ in range(n)]


def test_as_of_and_nearest_over_days(spark):
    rng = random.Random(4)
    left = [(i, rng.choice(["a", "b", None]), t) for i, t in enumerate(times(rng, 150))]
    right = [(i, rng.choice(["a", "b", None]), t) for i, t in enumerate(times(rng, 40))]
    ls, rs = spark.createDataFrame(left, "id int, g string, t timestamp_ntz"), spark.createDataFrame(right, "key int, g string, at timestamp_ntz")
    got = {r.id: r.r_key for r in tables.as_of(ls, rs, "g", "t", "at", "key", "r_").collect()}
    want, near = {}, {}
    for i, g, t in left:
        known = [(at, k) for k, h, at in right if g is not None and h == g and at is not None]
        before = [x for x in known if t is not None and x[0] <= t]
        want[i] = max(before)[1] if before else None
        near[i] = min(((abs(at - t), at, k) for at, k in known), default=(0, 0, None))[2] if t is not None else None
    assert got == want
    single = rs.where("g IS NOT NULL AND at IS NOT NULL").groupBy("g", "at").agg(F.max("key").alias("key")).withColumnRenamed("at", "t")
    first = {(g, at): max(k for k, h, a in right if (h, a) == (g, at)) for _, g, at in right}
    found = {r.id: r.key for r in stories.nearest(ls, single, "g", "t", "key").collect()}
    at_of = {k: at for k, _, at in right}
    for i, g, t in left:
        assert found[i] == (first[(g, at_of[near[i]])] if near[i] is not None else None)


def test_one_day_of_one_group_is_cut_into_ranges(spark, monkeypatch):
    rng = random.Random(9)
    moment = lambda: DAY + datetime.timedelta(seconds=rng.randrange(20))
    left = [(i, "a", moment()) for i in range(400)] + [(i, "a", DAY) for i in range(400, 800)] + [(i, "b", moment()) for i in range(800, 820)]
    right = [(i, "a", moment()) for i in range(30)]
    ls, rs = spark.createDataFrame(left, "id int, g string, t timestamp_ntz"), spark.createDataFrame(right, "key int, g string, at timestamp_ntz")
    whole = sorted(map(tuple, tables.as_of(ls, rs, "g", "t", "at", "key", "r_").collect()))
    monkeypatch.setattr(tables, "RANGE", 40)
    assert sorted(map(tuple, tables.as_of(ls, rs, "g", "t", "at", "key", "r_").collect())) == whole
    for i, g, t, at, key in whole:
        known = [(x, k) for k, h, x in right if h == g and x <= t]
        assert (at, key) == (max(known) if known else (None, None))
    spans = ls.selectExpr("g", "t", "id", "id % 7 = 0 AS hit").select("g", "t", "id", F.when(F.col("hit"), F.col("id")).alias("v"))
    few = {r.id: r["__found"] for r in tables.carried(spans, "g", "t", ["id"], "v").collect()}
    monkeypatch.setattr(tables, "RANGE", 1 << 30)
    assert few == {r.id: r["__found"] for r in tables.carried(spans, "g", "t", ["id"], "v").collect()}
    assert {r.id: r["__found"] for r in tables.carried(spans, "g", "t", ["id"], "v", back=True).collect()} == _backwards(spans, monkeypatch)


def _backwards(spans, monkeypatch):
    monkeypatch.setattr(tables, "RANGE", 25)
    return {r.id: r["__found"] for r in tables.carried(spans, "g", "t", ["id"], "v", back=True).collect()}


def test_rows_between(spark):
    rng = random.Random(5)
    left = [(i, rng.choice("ab"), t, None if t is None else t + datetime.timedelta(days=3)) for i, t in enumerate(times(rng, 100))]
    right = [(rng.choice("ab"), t) for t in times(rng, 12)]
    ls = spark.createDataFrame(left, "id int, g string, low timestamp_ntz, high timestamp_ntz")
    got = {r.id for r in tables.has_between(ls, spark.createDataFrame(right, "g string, at timestamp_ntz"), "g", "low", "high", "at").collect()}
    assert got == {i for i, g, lo, hi in left if lo and any(h == g and at and lo < at <= hi for h, at in right)}


def test_first_groups_in_order(spark):
    rng = random.Random(6)
    edges = [(a, b) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.03]
    group = {}
    for i in range(60):
        linked = [group[a] for a, b in edges if b == i]
        group[i] = min(linked) if linked else i
    got = graph.first_groups(spark.range(60).withColumnRenamed("id", "ord"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.ord: r.group for r in got.collect()} == group


def test_similar_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vec, "PART", 7)
    rng = np.random.default_rng(7)
    v = rng.standard_normal((60, 4))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v[i].tolist(), "xyz"[i % 3]) for i in range(60)] + [(99, None, "x")], "id long, u array<double>, b string")
    want = lambda same: {(i, j) for i in range(60) for j in range(i + 1, 60) if round(float(v[i] @ v[j]), 5) >= 0.6 and (not same or i % 3 == j % 3)}
    assert {(r.a, r.b) for r in vec.similar_pairs(rows, 0.6).collect()} == want(False)
    assert {(r.a, r.b) for r in vec.similar_pairs(rows, 0.6, "b").collect()} == want(True)


def test_cross_source_and_relevant_articles(spark):
    rng = random.Random(8)
    base = ["the fed raises rates again today", "gold falls as dollar gains", "oil output cut by producers", "banks report strong profits"]

    def changed(t):
        w = list(t)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice("abcdefgh ")
        return "".join(w)

    rows = [(i, rng.choice(["en", "de"]), changed(rng.choice(base)), rng.choice(["s1", "s2", "s3"]), rng.choice([None, "", changed(base[0])]), rng.randrange(5)) for i in range(60)]
    df = spark.createDataFrame(rows, "ord long, language string, title string, source string, summary string, relevance int")
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    kept = set()
    for lang in ("en", "de"):
        groups: list[list] = []
        for r in (r for r in rows if r[1] == lang):
            t = r[2].strip().lower()
            for g in groups:
                if any(ratio(t, x[2].strip().lower()) >= 0.85 for x in g):
                    g.append(r)
                    break
            else:
                groups.append([r])
        kept |= {min(g, key=lambda r: ({"s1": 1, "s2": 2}.get(r[3], 999), r[0]))[0] for g in groups}
    priority = spark.createDataFrame([("s1", 1), ("s2", 2)], "source string, priority int")
    assert {r.ord for r in search.cross_source_similar(df, priority).collect()} == kept

    plain = lambda t: "".join(c for c in " ".join((t or "").lower().split()) if c not in ".,'\"!?:;")
    first: list = []
    for r in sorted(rows, key=lambda r: (-r[5], r[0])):
        alike = lambda x: (0.7 * ratio(*sorted_pair(x, r, 2)) + 0.3 * ratio(*sorted_pair(x, r, 4)) if x[4] and r[4] else ratio(*sorted_pair(x, r, 2))) >= 0.85  # noqa: E731, B023
        if not any(alike(x) for x in first):
            first.append(r)

    got = {r.ord for r in search.keep_relevant_articles(df).collect()}
    assert abs(len(got) - len(first)) <= 2 and got >= {first[0][0]}


def sorted_pair(x, y, k):
    plain = lambda t: "".join(c for c in " ".join((t or "").lower().split()) if c not in ".,'\"!?:;")
    a, b = (x, y) if x[0] < y[0] else (y, x)
    return plain(a[k]), plain(b[k])


def test_story_of_odd_answers(spark):
    df = spark.createDataFrame([('{"title": " t ", "session_label": "mixed", "prob_move_ge_1pct": "x", "topics": ["a"], "is_filing_related": true}',), ("no json",), (None,)], "raw string")
    got = [r.s for r in df.select(longstories.story_of(F.col("raw")).alias("s")).collect()]
    assert (got[0].title, got[0].session_label, got[0].prob_move_ge_1pct, got[0].topics, got[0].is_filing_related) == ("t", "MIXED", None, ["a"], True)
    assert all((s.title, s.session_label, s.direction_bias, s.topics, s.risk_confidence) == ("", "UNKNOWN", "NEUTRAL", [], 0.0) for s in got[1:])


def test_bounds_of_titles_leave_few_pairs_and_lose_none():
    rng = random.Random(21)
    parts = ["the ", "of ", "ing ", *("".join(rng.choice("etaoinshr ") for _ in range(rng.randrange(2, 4))) for _ in range(60))]
    titles = ["".join(rng.choice(parts) for _ in range(60))[:120] for _ in range(300)]
    titles += [t[:40] + t[44:] + "zebu" for t in titles[:40]] + ["", "a", "of " * 40, "of " * 39 + "or ", "ñandú 日本語 " * 9]
    found = {(int(a), int(b)) for i, j in search._similar(titles, titles, 0.85) for a, b in zip(i, j, strict=True)}
    assert len(found) < 0.02 * len(titles) ** 2
    near = [(a, b) for a in range(len(titles)) for b in [*range(max(0, a - 2), min(len(titles), a + 3)), *([a - 300] if a >= 300 else [])]]
    assert all((a, b) in found for a, b in near if difflib.SequenceMatcher(None, titles[a], titles[b]).ratio() >= 0.85)
    texts = search._Texts(titles)
    i, j = (np.array([p[k] for p in near]) for k in (0, 1))

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            above, row = row, [0]
            for k, d in enumerate(b):
                row.append(above[k] + 1 if c == d else max(row[k], above[k + 1]))
        return row[-1]

    some = rng.sample(range(len(near)), 60) + list(range(len(near) - 20, len(near)))
    got = search._common(texts, texts, i, j)
    assert all(got[k] == lcs(titles[i[k]], titles[j[k]]) for k in some)


def test_copies_of_titles_are_not_compared_and_groups_stay(spark, monkeypatch):
    monkeypatch.setattr(search, "TITLE_BLOCK", 30)
    rng = random.Random(22)
    base = ["the fed raises rates again today", "the fed raises rates again tody!", "the fad raised rates again tody!", "gold falls as dollar gains", "gold fell as the dollar gains"]
    rows = [(i, rng.choice(["en", "de", None]), rng.choice([*base, None, "", base[0].upper()]), rng.choice(["s1", "s2", "s3"])) for i in range(300)]
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    kept = set()
    for lang in ("en", "de", None):
        groups: list[list] = []
        for r in (r for r in rows if r[1] == lang):
            fit = [g for g in groups if r[2] is not None and any(x[2] is not None and ratio(r[2].lower(), x[2].lower()) >= 0.85 for x in g)]
            (fit[0] if fit else groups.append([]) or groups[-1]).append(r)
        kept |= {min(g, key=lambda r: ({"s1": 1, "s2": 2}.get(r[3], 999), r[0]))[0] for g in groups}
    seen = []
    whole = search._title_pairs
    monkeypatch.setattr(search, "_title_pairs", lambda rows, t: seen.append(rows.count()) or whole(rows, t))
    df = spark.createDataFrame(rows, "ord long, language string, title string, source string")
    priority = spark.createDataFrame([("s1", 1), ("s2", 2)], "source string, priority int")
    assert {r.ord for r in search.cross_source_similar(df, priority).collect()} == kept and seen[0] <= 18

    full = [(*r[:3], rng.choice([None, "", "rates rise", "rates rose", "a dollar"]), rng.randrange(4)) for r in rows]
    first: list = []
    for r in sorted(full, key=lambda r: (-r[4], r[0])):
        t, s = ((x or "").lower().replace("!", "") for x in r[2:4])
        alike = lambda x, t=t, s=s: t and x[0] and (0.7 * ratio(t, x[0]) + 0.3 * ratio(s, x[1]) if s and x[1] else ratio(t, x[0])) >= 0.85
        if not any(alike(x) for x in first):
            first.append((t, s, r[0]))
    df = spark.createDataFrame(full, "ord long, language string, title string, summary string, relevance int")
    assert {r.ord for r in search.keep_relevant_articles(df).collect()} == {x[2] for x in first} and seen[1] <= 6
