"""Queries of sources: recorded payloads are made from the supplied tables, then read by the adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import FINANCE_WORDS
from tidemark.functions import dates
from tidemark.inputs import ARTICLES, DAILY, MACRO, TICKS, articles, filings, macro_articles, table, ticks
from tidemark.operators import market, stories, tables
from tidemark.plans.base import query
from tidemark.sources import feeds, news


def _at(text: str):
    return F.lit(text).cast("timestamp")


_NOW = "2024-02-01 00:00:00"
_RANGE = "TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"


def _recorded(spark, sf, source, path, *fields):
    """One payload per ticker and day, with the articles as items."""
    rows = articles(spark, sf).withColumn("iso", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).withColumn("day", F.date_format("published_at", "yyyy-MM-dd"))
    item = F.struct(*(F.expr(e).alias(c) for c, e in fields))
    bodies = rows.groupBy("ticker", "day").agg(F.to_json(F.struct(F.collect_list(item).alias(path))).alias("body"))
    return bodies.select(F.lit(source).alias("source"), F.col("ticker").alias("symbol"), F.to_date("day").alias("day"), "body")


def _collected(payloads, source, **how):
    out = news.collect(payloads, _at("2024-01-05 00:00:00"), _at("2024-01-20 00:00:00"), _at(_NOW), [source], **how)
    return out.select("id", "ticker", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "url", "source")


@query(f"SELECT 'massive_' || substr(md5('a' || id || 'http://x/' || id), 1, 12) AS id, ticker, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, 'http://x/' || id AS url, source FROM articles WHERE trim(title) <> '' AND published_at BETWEEN {_RANGE}", ARTICLES)
def q128_source_massive(spark, sf):
    made = _recorded(spark, sf, "massive", "results", ("id", "concat('a', id)"), ("title", "title"), ("published_utc", "iso"), ("article_url", "concat('http://x/', id)"), ("publisher", "named_struct('name', source)"))
    return _collected(made, "massive")


@query(f"SELECT 'marketaux_' || substr(md5('m' || id), 1, 12) AS id, CASE WHEN id % 3 = 0 THEN 'E' || (id % 5) ELSE ticker END AS ticker, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, 'http://m/' || id AS url, source FROM articles WHERE trim(title) <> '' AND published_at BETWEEN {_RANGE}", ARTICLES)
def q129_source_marketaux(spark, sf):
    entities = "CASE WHEN id % 3 = 0 THEN array(named_struct('symbol', concat('e', id % 5), 'sentiment_score', 0.1D)) END"
    made = _recorded(spark, sf, "marketaux", "data", ("uuid", "concat('m', id)"), ("title", "title"), ("published_at", "iso"), ("url", "concat('http://m/', id)"), ("source", "source"), ("entities", entities))
    return _collected(made, "marketaux")


@query(f"SELECT DISTINCT 'fd_' || substr(md5('http://f/' || id || title || day), 1, 12) AS id, ticker, day || ' 12:00:00' AS published_at, 'http://f/' || id AS url, source FROM (SELECT *, strftime(published_at, '%Y-%m-%d') AS day FROM articles) WHERE trim(title) <> '' AND (day || ' 12:00:00')::TIMESTAMP BETWEEN {_RANGE}", ARTICLES)
def q130_source_financial_datasets(spark, sf):
    made = _recorded(spark, sf, "financial_datasets", "news", ("title", "title"), ("date", "day"), ("url", "concat('http://f/', id)"), ("source", "source"))
    return _collected(made.unionByName(made), "financial_datasets")


@query(f"SELECT 'openai_' || substr(md5(trim(title) || 'http://o/' || id || iso || ticker), 1, 12) AS id, ticker, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, 'http://o/' || id AS url, 'OpenAI Generated' AS source FROM (SELECT *, strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM articles) WHERE trim(title) <> '' AND ticker IN ('T1', 'T2') AND published_at BETWEEN {_RANGE}", ARTICLES)
def q131_source_openai(spark, sf):
    made = _recorded(spark, sf, "openai", "items", ("title", "title"), ("published_at", "iso"), ("url", "concat('http://o/', id)"))
    fenced = made.withColumn("body", F.concat(F.lit("Here:\n```json\n"), F.get_json_object("body", "$.items"), F.lit("\n```")))
    return _collected(fenced, "openai", symbols=["t1", "T2"])


@query("SELECT 'gemini_' || substr(md5(trim(title) || 'http://g/' || id || span || ticker), 1, 12) AS id, ticker, day || ' 12:00:00' AS published_at, 'http://g/' || id AS url, source FROM (SELECT *, strftime(published_at, '%Y-%m-%d') AS day, strftime(published_at, '%Y-%m-%d') || ' – 2024-03-01' AS span FROM articles) WHERE trim(title) <> '' AND day BETWEEN '2024-01-05' AND '2024-01-20'", ARTICLES)
def q132_source_gemini(spark, sf):
    made = _recorded(spark, sf, "gemini", "topics", ("topic", "trim(title)"), ("title", "'unused'"), ("published_at", "concat(day, ' – 2024-03-01')"), ("sources", "array(concat('http://g/', id), 'http://other')"), ("source", "source"))
    return _collected(made, "gemini")


@query("SELECT source || ':' || rank AS id, trim(title) AS title FROM (SELECT source, title, row_number() OVER (PARTITION BY source ORDER BY id) AS rank FROM articles) WHERE " + " OR ".join(f"contains(lower(title), '{w.lower()}')" for w in FINANCE_WORDS), ARTICLES)
def q133_source_newsnow(spark, sf):
    rows = articles(spark, sf).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("id", "title"))).alias("a"))
    items = F.transform("a", lambda x, i: F.struct(x["title"].alias("title"), F.concat(F.lit("http://n/"), i + 1).alias("url")))
    made = rows.select(F.lit("newsnow").alias("source"), F.col("source").alias("symbol"), F.to_json(F.struct(items.alias("items"))).alias("body"))
    out = news.collect(made, _at(_NOW), _at(_NOW), _at(_NOW), ["newsnow"])
    return out.select(F.concat_ws(":", "source", F.substring_index("url", "/", -1)).alias("id"), "title")


@query(f"SELECT ('0x' || substr(md5('massive_' || substr(md5('a' || id || 'http://x/' || id), 1, 12)), 1, 14))::BIGINT AS id, ticker, source FROM articles WHERE trim(title) <> '' AND published_at::DATE = DATE '2024-01-09'", ARTICLES)
def q134_source_of_day(spark, sf):
    made = _recorded(spark, sf, "massive", "results", ("id", "concat('a', id)"), ("title", "title"), ("published_utc", "iso"), ("article_url", "concat('http://x/', id)"), ("publisher", "named_struct('name', source)"))
    return news.to_rows(news.of_day(made, F.lit("2024-01-09").cast("date"), _at(_NOW), sources=["massive"])).select("id", "ticker", "source")


@query("SELECT 'u' || (user_id % 12) AS source_id, bool_and(event_type <> 'error') AS available, max(CASE WHEN event_type = 'error' THEN {'ts': ts, 'e': 'code ' || event_id} END).e AS last_error FROM events GROUP BY 1 UNION ALL SELECT 'idle', true, NULL")
def q135_source_state(spark, sf):
    calls = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id") % 12).alias("source"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", F.concat(F.lit("code "), F.col("event_id"))).alias("error"))
    known = spark.createDataFrame([(f"u{k}",) for k in range(12)] + [("idle",)], "source_id string")
    return news.metadata(known, calls)


@query("SELECT id, t.topic AS primary_topic FROM (SELECT id, list_reverse_sort(list_transform(list_filter(topics, lambda t: t.score IS NOT NULL), lambda t: {'score': t.score, 'o': CASE t.topic WHEN 'economy_macro' THEN 3 WHEN 'financial_markets' THEN 2 ELSE 1 END, 'topic': t.topic}))[1] AS t FROM macro WHERE id IN (SELECT min(id) FROM macro GROUP BY id % 700)) WHERE t.topic IN ('economy_macro', 'financial_markets') AND t.score > 0.9::DOUBLE", ARTICLES, MACRO)
def q136_macro_news_by_topic(spark, sf):
    rows = macro_articles(spark, sf).withColumn("url", F.concat(F.lit("u"), F.col("id") % 700))
    return news.macro_kept(rows, ["economy_macro", "financial_markets"]).select("id", "primary_topic")


@query("SELECT t.ticker, strftime(m.month, '%Y-%m') AS month FROM (SELECT DISTINCT ticker FROM ticks) t, generate_series(TIMESTAMP '2023-11-01', TIMESTAMP '2024-02-01', INTERVAL 1 MONTH) m(month)", TICKS)
def q137_months_to_load(spark, sf):
    months = feeds.months(F.lit("2023-11-20").cast("date"), F.lit("2024-02-03").cast("date"))
    return ticks(spark, sf).select("ticker").distinct().select("ticker", F.explode(months).alias("m")).select("ticker", F.date_format("m", "yyyy-MM").alias("month"))


@query("SELECT DISTINCT 'T' || (o_custkey % 10) AS ticker FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderdate::DATE BETWEEN DATE '1997-01-01' AND DATE '1997-01-31' AND o_custkey % 10 < 7")
def q138_recent_filers(spark, sf):
    f = filings(spark, sf).withColumn("cik", F.substring("ticker", 2, 2))
    pad = lambda c, n: F.rpad(c, n, " ")
    lines = f.select(F.concat(pad(F.col("form_type"), 12), pad(F.lit("A COMPANY"), 62), pad(F.col("cik"), 12), pad(F.col("filed_date").cast("string"), 12), F.lit("edgar/x.txt")).alias("value"))
    known = spark.createDataFrame([(k, f"T{k}") for k in range(7)], "cik long, ticker string")
    return feeds.recent_filers(lines, known, F.lit("1997-01-01").cast("date"), F.lit("1997-01-31").cast("date"), ["10-K"])


@query("SELECT symbol, round(price, 4) AS price, round(change_percent, 4) AS change_percent, round(extended_change, 4) AS extended_change FROM (SELECT d.ticker AS symbol, t.price, round((d.close - d.prev) / d.prev * 100, 2) AS change_percent, round(t.price - d.close, 2) AS extended_change FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY day) AS prev FROM daily QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY day DESC) = 2) d JOIN (SELECT ticker, arg_max(price, (ts, event_id)) AS price FROM ticks GROUP BY 1) t ON t.ticker = d.ticker)", TICKS, DAILY)
def q139_price_snapshots(spark, sf):
    days = market.bars(ticks(spark, sf), "1 day")
    last = ticks(spark, sf).groupBy("ticker").agg(F.max_by("price", F.struct("ts", "event_id")).alias("trade"))
    top = days.groupBy("ticker").agg(F.max("start").alias("latest"))
    before = days.join(top, "ticker").where("start < latest").drop("latest")  # the day before the last one, as at its close
    out = market.snapshots(before, last, F.lit(False))
    return out.select("symbol", F.round("price", 4).alias("price"), F.round("change_percent", 4).alias("change_percent"), F.round("extended_change", 4).alias("extended_change"))


@query("SELECT event_id, strftime((ts AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def q140_eastern_times(spark, sf):
    text = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("raw"))
    return text.select("event_id", F.date_format(dates.from_market_time(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("SELECT 'C' || c_custkey AS ticker FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def q141_stocks_without_filings(spark, sf):
    had = table(spark, sf, "orders").where("o_orderpriority LIKE '1%'").select(F.concat(F.lit("C"), "o_custkey").alias("ticker"))
    return tables.without(table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("ticker")), had, ["ticker"])


@query("SELECT page_id, length(t) > 0 AS has_text, contains(t, '<') AS has_tag FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS t FROM pages)")
def q142_clean_text(spark, sf):
    from tidemark.functions.text import strip_tags

    t = strip_tags(F.col("html"))
    return table(spark, sf, "pages").select("page_id", (F.length(t) > 0).alias("has_text"), t.contains("<").alias("has_tag"))


@query("SELECT as_of::VARCHAR AS day, id FROM (SELECT published_at::DATE AS as_of, id FROM articles) WHERE as_of BETWEEN DATE '2024-01-10' AND DATE '2024-01-15' AND as_of NOT IN (DATE '2024-01-12')", ARTICLES)
def q143_days_not_loaded(spark, sf):
    rows = articles(spark, sf).withColumn("day", F.to_date("published_at"))
    loaded = spark.createDataFrame([("2024-01-12",)], "day string").select(F.to_date("day").alias("day"))
    return stories.of_missing_days(rows, "day", F.lit("2024-01-10").cast("date"), F.lit("2024-01-15").cast("date"), loaded).select(F.col("day").cast("string").alias("day"), "id")
