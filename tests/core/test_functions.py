from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, finance, ids, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"]) if all(v is not None for v in values.values()) else spark.range(1).select(*(F.lit(v).cast("string").alias(k) for k, v in values.items()))
    return row.select(column).first()[0]


def test_ids(spark):
    import hashlib

    want = int.from_bytes(hashlib.md5(b"T1_7").digest()[:7], "big")
    assert one(spark, ids.bigint_id(ids.joined_key(F.col("a"), F.col("b"))), a="T1", b=7) == want


@pytest.mark.parametrize("raw,want", [("2025-06-15T10:30:00Z", "2025-06-15 10:30:00"), ("2025-06-15T10:30:00", "2025-06-15 10:30:00"), ("2025-06-15T10:30:00+05:00", "2025-06-15 05:30:00"), ("not-a-date", None), ("", None), (None, None)])
def test_parse_time(spark, raw, want):
    assert one(spark, dates.parse_time(F.col("a")).cast("string"), a=raw) == want


def test_latest_evidence(spark):
    df = spark.createDataFrame([(["published_at=2025-06-15T10:30:00Z", "junk", None, "published_at=2025-06-15T18:00:00Z"],), (["bad"],), ([],)], "e array<string>")
    assert [r[0] for r in df.select(dates.latest_evidence(F.col("e")).cast("string")).collect()] == ["2025-06-15 18:00:00", None, None]


def test_calendar(spark):
    days = spark.createDataFrame([(date(2025, 7, 3),), (date(2025, 7, 4),), (date(2025, 7, 5),), (date(2026, 7, 3),)], "d date")
    assert [r[0] for r in days.select(dates.is_business_day(F.col("d"))).collect()] == [True, False, False, False]
    at = spark.createDataFrame([(datetime(2025, 7, 5, 12),), (datetime(2025, 7, 3, 19, 59),), (datetime(2025, 7, 3, 20),), (datetime(2025, 12, 1, 14),)], "t timestamp_ntz")
    rows = at.select(dates.overnight_start(F.col("t")).cast("string"), dates.is_intraday(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["2025-07-03 20:00:00", "2025-07-02 20:00:00", "2025-07-03 20:00:00", "2025-11-28 21:00:00"]
    assert [r[1] for r in rows] == [False, True, False, True]


@pytest.mark.parametrize("form,year,period,want", [("10-Q", 2024, "Q3", "10-Q · Q3 2024"), ("10-K", None, None, "10-K · 2024"), (None, None, None, "Filing")])
def test_filing_title(spark, form, year, period, want):
    filed = F.lit("2024-12-31").cast("date") if form else F.lit(None).cast("date")
    got = spark.range(1).select(finance.filing_title(F.lit(form).cast("string"), filed, F.lit(year).cast("int"), F.lit(period).cast("string"))).first()[0]
    assert got == want


@pytest.mark.parametrize("score,want", [(None, "medium"), (0.8, "high"), (0.7, "high"), (0.5, "medium"), (0.3, "medium"), (0.1, "low")])
def test_impact_of_score(spark, score, want):
    assert spark.range(1).select(finance.impact_of_score(F.lit(score).cast("double"))).first()[0] == want


@pytest.mark.parametrize("value,want", [("a|b|c\nd|e|f\ng|h|i", True), ("plain prose\nof two lines", False), ("a|b", False), ("", False), ("a\tb\nc\td\nlast", True)])
def test_tables(spark, value, want):
    assert one(spark, text.looks_like_table(F.col("a")), a=value) is want


def test_keywords_and_topics(spark):
    low = F.lower("a")
    assert one(spark, finance.impact_of_news(low), a="Merger of two banks") == "high"
    assert one(spark, finance.impact_of_news(low), a="Dividend raised") == "medium"
    assert one(spark, finance.category(low), a="bullish price and volume breakout") == "technical_data"
    topic, score = finance.route(low)
    assert one(spark, F.struct(topic.alias("t"), score.alias("s")), a="nothing here")[:] == ("FX", 25)
    assert one(spark, F.struct(topic.alias("t"), score.alias("s")), a="tariff by executive order, trump")[:] == ("Trump", 80)
    assert one(spark, text.language_tag(F.col("a")), a="股票 up") == "zh"
    assert one(spark, text.matched(low, ["FDA", "gdp", "jobs"], 2), a="jobs and fda and gdp") == ["FDA", "gdp"]
    assert one(spark, text.tickers_in(F.col("a"), ["AAPL", "MSFT", "F"]), a="(aapl) and Msft, not fact") == ["AAPL", "MSFT"]
    assert one(spark, text.strip_links(F.col("a")), a="see [this  page](http://x.y) … now") == "see this page now"


def test_topics_are_scored_once_before_a_filter(spark):
    """A filter on the score was pushed into the reading, with the lower-casing of the text for each word."""
    rows = spark.createDataFrame([(1, "nothing here"), (2, "Tariff by executive order, TRUMP"), (3, None), (4, "gold, oil and the dollar")], "id int, a string")
    low = F.lower("a")
    named = finance.with_topic(rows, low)
    topic, score = finance.route(low)
    assert {(r.id, r.topic, r.relevance_score) for r in named.collect()} == {tuple(r) for r in rows.select("id", topic, score).collect()}
    kept = named.where("relevance_score >= 50")
    assert {r.id for r in kept.collect()} == {2, 4} and named.columns == ["id", "a", "relevance_score", "topic"]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count("debt ceiling") == 1


def test_direction(spark):
    name, score = finance.direction({"technical": F.lit(0.5), "news_sentiment": F.lit(0.0), "macro": F.lit(-0.3)})
    got = spark.range(1).select(name, score).first()
    assert got[0] == "buy" and abs(got[1] - (0.15 - 0.03) / 0.4) < 1e-12
    assert spark.range(1).select(finance.direction({"technical": F.lit(None).cast("double")})[0]).first()[0] == "hold"


def test_long_pages_and_feeds_go_to_python_few_at_a_time(spark):
    """Pages and feeds of 10,000 rows were held at once."""
    from tidemark.operators.chunks import html_text
    from tidemark.sources.feeds import xml_entries

    feed = "<rss><channel><item><title>t</title><link>u</link></item></channel></rss>"
    df = spark.createDataFrame([("<p>a</p><p>b</p>", feed), (None, None), ("", "<no")], "page string, body string")
    out = df.select(html_text(F.col("page")).alias("t"), xml_entries(F.col("body")).alias("e"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" in plan
    assert [(r.t, r.e and [(x.title, x.url, x.author) for x in r.e]) for r in out.collect()] == [("a\n\nb", [("t", "u", None)]), (None, None), ("", None)]
