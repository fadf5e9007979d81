import json
from datetime import date

from pyspark.sql import functions as F

from tidemark.sources import feeds

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>c</title>
<item><title>One &lt;b&gt;up&lt;/b&gt;</title><link>http://a/1</link><pubDate>Mon, 16 Jun 2025 10:00:00 GMT</pubDate><description>&lt;p&gt;Sum  one&lt;/p&gt;</description></item>
<item><title>No date</title><guid>g2</guid></item><item><title>Old</title><link>http://a/3</link><pubDate>Mon, 02 Jun 2025 10:00:00 +0000</pubDate></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>股票</title><link href="http://b/1"/><updated>2025-06-17T01:02:03Z</updated><author><name>Ann</name></author></entry></feed>"""
JSON = json.dumps({"version": "https://jsonfeed.org/version/1.1", "items": [{"content_text": "x" * 150, "url": "http://c/1", "date_published": "2025-06-17T00:00:00Z", "authors": [{"name": "A"}, {"name": "B"}]}]})


def test_feeds_of_three_kinds(spark, tmp_path):
    for i, body in enumerate((RSS, ATOM, JSON, "not a feed", "")):
        (tmp_path / f"{i}.txt").write_text(body)
    rows = feeds.payloads(spark, str(tmp_path)).select("body", F.lit("s").alias("source"), F.lit("A").alias("ticker"))
    got = {r.title: r for r in feeds.feed_news(rows, F.lit("2025-06-18 00:00:00").cast("timestamp")).collect()}
    assert set(got) == {"One up", "No date", "股票", "x" * 100 + "..."}
    assert str(got["One up"].published_at) == "2025-06-16 10:00:00" and got["One up"].summary == "Sum one"
    assert str(got["No date"].published_at) == "2025-06-18 00:00:00"
    assert got["股票"].language == "zh" and got["股票"].author == "Ann" and got["x" * 100 + "..."].author == "A, B"


def test_filing_index(spark):
    line = f"{'10-K':<12}{'ACME CORP':<62}{'1234567':<12}{'2024-02-03':<12}edgar/data/x.txt"
    rows = spark.createDataFrame([(line,), ("Form Type   Company Name",), ("-" * 140,), ("",)], "value string")
    assert [tuple(r) for r in feeds.filing_index(rows, ["10-K"]).collect()] == [("10-K", "ACME CORP", 1234567, date(2024, 2, 3), "edgar/data/x.txt")]
    assert feeds.filing_index(rows, ["8-K"]).count() == 0
    assert spark.range(1).select(feeds.padded_cik(F.lit(77))).first()[0] == "0000000077"


def test_provider_answers(spark):
    body = json.dumps({"filings": {"recent": {"form": ["8-K", "4", "S-1"], "filingDate": ["2024-01-05", "2024-01-09", "bad"], "accessionNumber": ["a", "b", "c"], "primaryDocument": ["x", "y", "z"]}}})
    day = lambda d: F.lit(d).cast("date")
    got = feeds.company_filings(spark.createDataFrame([("A", body), ("B", "{")], "ticker string, body string"), day("2024-01-01"), day("2024-01-31")).collect()
    assert [(r.form_type, r.accession, r.impact) for r in got] == [("8-K", "a", "high"), ("4", "b", "medium")]
    body = json.dumps({"feed": [{"title": "t", "url": "u", "time_published": "20240105T101112", "summary": "s", "source": "x", "ticker_sentiment": [{"ticker": "zz"}, {"ticker": "msft"}, {"ticker": "AAPL"}]}, {"title": "other", "time_published": "20240105T101112", "ticker_sentiment": []}]})
    at = lambda d: F.lit(d).cast("timestamp")
    got = feeds.ticker_news(spark.createDataFrame([(body,)], "body string"), ["AAPL", "MSFT"], at("2024-01-01"), at("2024-02-01")).collect()
    assert [(r.ticker, str(r.published_at)) for r in got] == [("MSFT", "2024-01-05 10:11:12")]
    body = json.dumps({"Global Quote": {"05. price": "12.50", "10. change percent": "-1.25%"}})
    q = spark.createDataFrame([(body,), ('{"Global Quote": {"05. price": "0"}}',)], "b string").select(feeds.quote(F.col("b")).alias("q")).collect()
    assert tuple(q[0].q) == (12.5, -1.25) and tuple(q[1].q) == (None, None)


def test_small_sources(spark):
    text = "*Title*: First\n*Summary*: Some\n*Source*: S\n*Date*: 2024-01-02\n\n**Title:** Second\n"
    got = spark.createDataFrame([(text,)], "b string").select(feeds.markdown_articles(F.col("b")).alias("a")).first().a
    assert [(a.title, a.summary, a.date) for a in got] == [("First", "Some", "2024-01-02"), ("Second", None, None)]
    hot = feeds.hot_list(spark.createDataFrame([("p", '{"items": [{"title": "a", "url": "u"}, {"title": 5}]}')], "platform string, body string"), F.lit("2024-01-01").cast("timestamp")).orderBy("rank").collect()
    assert [(r.rank, r.title, r.ticker) for r in hot] == [(1, "a", "MACRO"), (2, "5", "MACRO")]
    series = spark.createDataFrame([("g", date(2024, 1, d), float(d)) for d in (1, 2, 3)] + [("h", date(2024, 1, 1), 5.0)], "indicator string, day date, value double")
    assert {(r.indicator, r.value, r.previous) for r in feeds.latest_with_previous(series).collect()} == {("g", 3.0, 2.0), ("h", 5.0, None)}
    r = spark.range(1).select(feeds.months(F.lit("2024-01-15").cast("date"), F.lit("2024-03-01").cast("date")).alias("m"), feeds.buckets(F.lit("2024-01-01").cast("date"), F.lit("2024-01-20").cast("date")).alias("b")).first()
    assert len(r.m) == 3 and [(str(b.start), str(b.end)) for b in r.b] == [("2024-01-01", "2024-01-15"), ("2024-01-16", "2024-01-20")]
    reg = spark.createDataFrame([("a", True, 2, "news"), ("b", True, 1, "multi"), ("c", False, 0, "news"), ("d", True, 0, "macro")], "source_id string, enabled boolean, priority int, source_type string")
    assert [r.source_id for r in feeds.registered(reg).collect()] == ["b", "a"]
