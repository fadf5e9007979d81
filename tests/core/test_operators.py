import difflib
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chunks, graph, market, search, tables
from tidemark.operators import vectors as vec
from tidemark.streaming import events, limits


@pytest.mark.parametrize("n,edges,want", [(0, [], 0), (1, [], 1), (3, [(0, 1), (1, 2)], 1), (3, [(0, 1)], 2), (2, [(0, 5), (-1, 0)], 2), (6, [(0, 1), (1, 2), (3, 4)], 3), (60, [(i, i + 1) for i in range(59)], 1)])
def test_components(spark, n, edges, want):
    got = graph.components(spark.range(n), spark.createDataFrame(edges, "a long, b long"))
    assert got.count() == n and got.select("cluster").distinct().count() == want


def test_first_wins_equals_the_sequential_rule(spark):
    rng = random.Random(4)
    edges = {(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.1}
    kept = []
    for b in range(40):
        if not any((a, b) in edges for a in kept):
            kept.append(b)
    got = graph.first_wins(spark.range(40).withColumnRenamed("id", "ord"), spark.createDataFrame(list(edges), "a long, b long"))
    assert sorted(r.ord for r in got.collect()) == kept


def test_pointer_chains(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (7, 7)], "id long, kept long")
    assert {(r.id, r.kept) for r in graph.resolved(df).collect()} == {(1, 4), (2, 4), (3, 4), (9, 8)}


def test_ends_of_chains_are_not_looked_up_together(spark, monkeypatch):
    """Once they were at their end, all pointers met in one more lookup of it, in one task."""
    plain, met = graph._looked_up, []

    def looked_up(rows, ahead, how):
        met.append(rows.groupBy("kept").count().agg({"count": "max"}).first()[0] or 0)
        return plain(rows, ahead, how)

    monkeypatch.setattr(graph, "_looked_up", looked_up)
    halves = spark.range(1, 4096).selectExpr("id", "id div 2 AS kept")
    assert {tuple(r) for r in graph.resolved(halves).collect()} == {(i, 0) for i in range(1, 4096)} and max(met) <= 256
    monkeypatch.setattr(graph, "HOT", 3)  # what many point to is sent to them
    rng = random.Random(6)
    to = {i: rng.choice([0, 1, 2, i // 3, 500 + i]) for i in range(3, 300)} | {1: 0, 2: 700}
    want = {}
    for i in to:
        at = to[i]
        while at in to:
            at = to[at]
        want[i] = at
    assert {r.id: r.kept for r in graph.resolved(spark.createDataFrame(list(to.items()), "id long, kept long")).collect()} == want


def test_as_of_and_between_with_nulls(spark):
    d = lambda n: date(2024, 1, n)
    left = spark.createDataFrame([(1, "A", d(5)), (2, "A", d(1)), (3, "B", d(5)), (4, None, d(5)), (5, "A", None)], "k long, by string, at date")
    right = spark.createDataFrame([(10, "A", d(2)), (11, "A", d(5)), (12, "A", d(6)), (13, None, d(1)), (14, "A", d(5))], "r long, by string, day date")
    got = {r.k: r.f_r for r in tables.as_of(left, right, "by", "at", "day", "r", "f_").collect()}
    assert got == {1: 14, 2: None, 3: None, 4: None, 5: None}
    spans = left.withColumn("until", F.date_add("at", 1))
    assert sorted(r.k for r in tables.has_between(spans, right, "by", "at", "until", "day").collect()) == [1, 2]


def test_write_rules(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k long, v string")
    assert sorted(map(tuple, tables.insert_ignore(old, new, ["k"], "v").collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, tables.upsert(old, new, ["k"], "v").collect())) == [(1, "a"), (2, "c"), (3, "e")]


def test_months_without_a_month_are_not_held_back(spark):
    df = spark.createDataFrame([(i, "2024-01" if i < 6 else None, float(i)) for i in range(12)], "id long, m string, s double")
    assert sorted(r.id for r in tables.span_months(df, F.col("m"), F.col("s"), 4, 20, "id").collect()) == [2, 3, 4, 5, 6, 7, 8, 9, 10, 11]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], True), (2, [6.0, 8.0], False), (3, [0.0, 0.0], False), (4, [-4.0, 3.0], False), (5, [-4.0, 3.1], False)], "id long, v array<double>, anchor boolean")
    rows = vec.with_unit(df)
    got = {r.id: (r.cluster, r.cluster_type) for r in vec.clusters(rows).collect()}
    assert got == {1: (1, "seeded"), 2: (1, "seeded"), 3: (3, "discovered"), 4: (4, "discovered"), 5: (4, "discovered")}
    sims = df.select(vec.cosine(F.col("v"), F.array(F.lit(3.0), F.lit(4.0))), vec.cosine(F.col("v"), F.array(F.lit(1.0)))).collect()
    assert [round(r[0], 6) for r in sims][:3] == [1.0, 1.0, 0.0] and all(r[1] == 0 for r in sims)
    assert sorted(r.id for r in vec.keep_first_similar(rows, 0.9).collect()) == [1, 3, 4]


def test_similar_titles_match_difflib(spark):
    rng = random.Random(2)
    titles = ["".join(rng.choice("ab ") for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(titles)], "ord long, title string, block string")
    got = {(r.a, r.b) for r in search.similar_titles(rows, 0.8).collect()}
    norm = [t.strip().lower() for t in titles]
    assert got == {(a, b) for b in range(60) for a in range(b) if difflib.SequenceMatcher(None, norm[b], norm[a]).ratio() >= 0.8}


def test_first_titles_are_kept_across_beginnings_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "TITLE_BLOCK", 40)
    rng = random.Random(3)
    words = ["rate", "fed", "the", "markets", "gold", "rises", "after", "vote", "on", "banks", "energy", "report"]
    titles = ["The Fed holds its rate after the vote", "Fed holds its rate after the vote", "  the fed holds its rate after the vote", "", "", None, None]
    for _ in range(40):
        base = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 20)))
        titles += [base, "The " + base, base[:3] + "x" + base[4:], base[: len(base) // 2].upper()]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "ord long, title string")
    kept = []
    for i, t in enumerate(titles):
        if t is None or not any(titles[k] is not None and difflib.SequenceMatcher(None, t.strip().lower(), titles[k].strip().lower()).ratio() >= 0.85 for k in kept):
            kept.append(i)
    assert sorted(r.ord for r in search.keep_first_titles(rows, 0.85).collect()) == kept and 1 not in kept and 2 not in kept


def by_hand(text, size, overlap):
    """Chunks by the rule, character by character."""
    at = 0
    while at < len(text):
        if at + size >= len(text):
            yield at, len(text)
            return
        gap = [i for i in range(at, at + size) if i >= at + size - overlap - 200 and text[i : i + 2] == "\n\n"]
        space = [i for i in range(at, at + size + 1) if text[i] == " "]
        end = gap[-1] + 2 if gap and gap[-1] > at else space[-1] + 1 if space and space[-1] > at else at + size
        yield at, end
        at = end - overlap if end - overlap > at else end


def test_chunks_follow_the_rule():
    r = random.Random(2)
    text = " ".join(f"word{i}" for i in range(3000))
    spans = list(chunks.chunk_spans(text))
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= 2402 and c < b for (a, b), (c, _) in zip(spans, spans[1:]))
    for _ in range(150):
        text = "".join(r.choice("abcdefg  \n\n😀") for _ in range(r.randrange(0, 1500)))
        size, overlap = r.choice([(300, 40), (250, 30), (700, 600), (20, 5)])
        assert list(chunks.chunk_spans(text, size, overlap)) == list(by_hand(text, size, overlap))


def test_sections_by_headings(spark):
    texts = ["before\nItem 1. Business\nwe\nItem 7A: Risk\nmany", "\nitem 1a. Risk\nx\n  ITEM 7 MD&A\n\ny\nItem 9.\n \nItem 10.\nz", "\nItem 2. " + "t" * 61 + "\nb", "no heading", " \n ", None, "a\nItem 3 \n\nTitle on the next line\nbody \n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in chunks.sections(rows).orderBy("id", "block").collect():
        got.setdefault(r.id, []).append((r.section, r.text))
    assert got == {
        0: [(None, "before"), ("Item 1. Business", "we\nItem 7A: Risk\nmany")], 1: [("Item 1A. Risk", "x"), ("Item 7. MD&A", "y"), ("Item 9. Item 10.", "z")],
        2: [("Item 2. " + "t" * 57 + "...", "b")], 3: [(None, "no heading")], 6: [(None, "a"), ("Item 3. Title on the next line", "body")],
    }
    assert [(r.chunk_index, r.section, r.chunk) for r in chunks.chunked(rows.where("id = 1"), by_section=True).orderBy("chunk_index").collect()] == [(0, "Item 1A. Risk", "x"), (1, "Item 7. MD&A", "y"), (2, "Item 9. Item 10.", "z")]


def test_web_page_to_text():
    page = "<html><head><title>T</title><style>x</style></head><body><p>One &amp; two</p><table><tr><td>a</td><td>b c</td></tr><tr><td>1</td><td>2</td></tr></table><script>no()</script></body></html>"
    assert chunks.page_text(page) == "T\nOne & two\n\n| a | b c |\n| 1 | 2 |"


@pytest.mark.parametrize("raw,want", [('```json\n{"a": 1}\n```', '{"a": 1}'), ('{"a": [1, 2', '{"a": [1, 2]}'), ('x {"a": "b"} trailing', '{"a": "b"}'), ("none", None), (None, None)])
def test_json_repair(raw, want):
    assert chunks.repaired_json(raw) == want


def test_page_ranges(spark):
    c = spark.createDataFrame([(1, 0, 10), (1, 10, 25)], "doc long, start int, end int")
    p = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 10, 20), (1, 3, 20, 30)], "doc long, page int, start int, end int")
    assert sorted((r.start, r.page_start, r.page_end) for r in chunks.page_ranges(c, p).collect()) == [(0, 1, 1), (10, 2, 3)]


def test_limits_match_a_plain_loop(spark):
    rng = random.Random(1)
    asks = [(rng.randrange(3), datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(200_000)), i) for i in range(400)]
    want, recent, days = {}, {}, {}
    for ip, t, k in sorted(asks, key=lambda x: (x[1], x[2])):
        mine = [x for x in recent.get(ip, []) if x > t - timedelta(seconds=600)]
        day = days.get((ip, t.date()), 0)
        want[k] = "window" if len(mine) >= 2 else "daily" if day >= 20 else "ok"
        if want[k] == "ok":
            mine.append(t)
            days[ip, t.date()] = day + 1
        recent[ip] = mine
    df = spark.createDataFrame(asks, "ip long, ts timestamp_ntz, event_id long")
    assert {r.event_id: r.verdict for r in limits.limited(df, 600, 2, 20).collect()} == want


def test_streams(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, m), "A", float(m), m) for m in range(0, 40, 2)]
    df = spark.createDataFrame(rows, "ts timestamp, ticker string, price double, event_id long").withColumn("ip", F.col("ticker")).coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def result(out, name):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    bars = result(events.streamed_bars(stream), "bars")
    batch = {(r.ticker, r.start): r for r in market.bars(df).collect()}
    assert bars and all(tuple(batch[r.ticker, r.start]) == tuple(r) for r in bars)
    assert len(result(events.first_delivery(stream.unionByName(stream), "event_id", "ts"), "once")) == len(rows)


def test_late_and_replayed_asks_are_judged_as_in_the_batch_across_a_restart(spark, tmp_path):
    r = random.Random(8)
    begin = datetime(2024, 1, 1, 22)
    asks = [(f"ip{r.randrange(4)}", begin + timedelta(seconds=r.randrange(4 * 3600), microseconds=r.randrange(10**6)), i) for i in range(300)]
    files = [[] for _ in range(8)]
    for a in asks:  # up to half an hour late, and some of them twice
        n = min(6, int((a[1] - begin).total_seconds() // 1800) + r.randrange(2))
        files[n].append(a)
        if r.random() < 0.2:
            files[n].append(a)
    files[7] = [("last", begin + timedelta(days=3), 9000), ("ip0", begin, 9001)]  # moves the watermark on; what comes days late is not judged
    schema = "ip string, ts timestamp, event_id long"
    source, at = tmp_path / "in", str(tmp_path / "checkpoint")

    def run(numbers):
        for n in numbers:
            spark.createDataFrame(files[n][::-1], schema).coalesce(1).write.mode("append").parquet(str(source))
            stream = spark.readStream.schema(schema).parquet(str(source))
            out = limits.limited_stream(stream, 600, 2, 9, late="90 minutes")
            out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", at).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(120)

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        run([0, 1, 2])
        run([3, 4, 5, 6, 7])  # each is a new query on the same checkpoint
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = [(r.event_id, r.verdict) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    df = spark.createDataFrame(asks, schema)
    want = {r.event_id: r.verdict for r in limits.limited(df, 600, 2, 9).collect()}
    assert len(got) == len(dict(got)) and dict(got) == want and set(want.values()) == {"ok", "window", "daily"}
