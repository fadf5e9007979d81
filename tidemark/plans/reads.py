"""Queries of table reads: ranges, lookups, joins of stories with what they link to, views of bars and briefs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import dates
from tidemark.inputs import ARTICLES, BRIEFS, CHUNKS, DAILY, FILINGS, MACRO, STORIES, TICKS, article_links, articles, book_chunks, books, briefs, filings, macro_articles, story_rows, table, ticks
from tidemark.operators import market, stories, tables
from tidemark.plans.base import query

def _january():
    return F.expr("TIMESTAMP_NTZ'2024-01-05 00:00:00'"), F.expr("TIMESTAMP_NTZ'2024-01-20 00:00:00'")


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(related_tickers, lambda t: upper(trim(t))), lambda t: t <> ''))), ',') AS tickers, published_at::DATE::VARCHAR AS day FROM macro WHERE collector = 'feed' AND published_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND list_contains(list_transform(related_tickers, lambda t: upper(trim(t))), 'T3') ORDER BY published_at DESC, id LIMIT 40", ARTICLES, MACRO)
def q78_macro_articles_of_ticker(spark, sf):
    rows = macro_articles(spark, sf).withColumn("tickers", stories.clean_tickers(F.col("related_tickers")))
    where = (F.col("collector") == "feed") & F.col("published_at").between(*_january()) & F.array_contains("tickers", "T3")
    return tables.newest(rows, 40, where=where).select("id", F.array_join(F.array_sort("tickers"), ",").alias("tickers"), F.to_date("published_at").cast("string").alias("day"))


@query("SELECT id, source FROM articles WHERE published_at::DATE = DATE '2024-01-09' AND collector = 'feed'", ARTICLES)
def q79_macro_articles_of_day(spark, sf):
    return macro_articles(spark, sf).where((F.to_date("published_at") == F.lit("2024-01-09").cast("date")) & (F.col("collector") == "feed")).select("id", "source")


@query("SELECT * FROM (SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS start, close FROM (SELECT ticker, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, arg_max(price, (ts, event_id)) AS close FROM ticks WHERE ticker = 'T4' GROUP BY 1, 2) ORDER BY ts DESC LIMIT 60) ORDER BY start", TICKS)
def q80_newest_bars_in_order(spark, sf):
    bars = market.bars(ticks(spark, sf).where("ticker = 'T4'"))
    return tables.newest(bars, 60, "start", "ticker").orderBy("start").select("ticker", _stamp("start"), "close")


@query("""SELECT ticker, strftime(month, '%Y-%m') AS month, bool_and(has) AS complete FROM (SELECT t.ticker, m.month, d.n, EXISTS (SELECT 1 FROM ticks x WHERE x.ticker = t.ticker AND x.ts::DATE = (m.month + (d.n - 1) * INTERVAL 1 DAY)::DATE) AS has
  FROM (SELECT DISTINCT ticker FROM ticks) t, (VALUES (TIMESTAMP '2024-01-01'), (TIMESTAMP '2024-02-01')) m(month), (VALUES (1), (3), (7), (15), (22), (0), (-1)) k(k),
    LATERAL (SELECT CASE k WHEN 0 THEN (day(last_day(m.month)) // 2) WHEN -1 THEN day(last_day(m.month)) ELSE k END AS n) d) GROUP BY 1, 2""", TICKS)
def q81_month_complete(spark, sf):
    return tables.months_complete(ticks(spark, sf), "ticker", F.to_date("ts"), [F.lit("2024-01-01").cast("date"), F.lit("2024-02-01").cast("date")])


@query("SELECT n_nationkey::VARCHAR AS ticker, n_name AS name FROM nation WHERE n_nationkey IN (3, 7, 11, 99)")
def q82_stocks_in_list(spark, sf):
    known = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("ticker"), F.col("n_name").alias("name"))
    return tables.looked_up(known, "ticker", ["3", "7", "11", "99"])


_ORDER = ["FX", "RATE", "CREDIT", "COMMODITY", "EQUITY", "Fiscal Policy", "Monetary Policy", "Trump"]
_PLACE = "CASE topic " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(_ORDER)) + " END"


@query(f"SELECT topic, title, summary FROM brief WHERE as_of_date = DATE '2024-01-10' ORDER BY {_PLACE}", BRIEFS)
def q83_briefs_of_day(spark, sf):
    now = tables.latest_per(briefs(spark, sf).where("as_of_date = DATE'2024-01-10'"), ["as_of_date", "asset", "topic"], "revision")
    return stories.briefs({t: now.where(F.col("topic") == t).drop("topic") for t in _ORDER}, F.lit("2024-01-10").cast("date"), _ORDER).select("topic", "title", "summary")


@query("SELECT as_of_date::VARCHAR AS day, title FROM brief WHERE topic = 'Monetary Policy' AND as_of_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-11' ORDER BY as_of_date DESC", BRIEFS)
def q84_briefs_of_topic_in_range(spark, sf):
    return stories.briefs_between(briefs(spark, sf), "Monetary Policy", F.lit("2024-01-05").cast("date"), F.lit("2024-01-11").cast("date")).select(F.col("as_of_date").cast("string").alias("day"), "title")


@query("SELECT as_of_date::VARCHAR AS day, topic, title FROM brief WHERE as_of_date BETWEEN DATE '2024-01-19' AND DATE '2024-01-25'", BRIEFS)
def q85_briefs_of_week(spark, sf):
    until = F.lit("2024-01-25").cast("date")
    found = stories.briefs_between(briefs(spark, sf), None, F.date_sub(until, 6), until)
    return found.select(F.col("as_of_date").cast("string").alias("day"), "topic", "title")


@query("SELECT 'Summary of ' || as_of_date AS title, string_agg(title, '; ' ORDER BY topic) AS summary FROM brief WHERE as_of_date = DATE '2024-01-12' GROUP BY as_of_date", BRIEFS)
def q86_daily_summary(spark, sf):
    return stories.daily_summary(stories.latest_briefs(briefs(spark, sf)), F.lit("2024-01-12").cast("date")).select("title", "summary")


@query("SELECT book_id, title, author FROM (SELECT p_partkey AS book_id, p_name AS title, p_brand AS author FROM part) WHERE book_id = 17 OR 'file:' || book_id = 'file:23'")
def q87_books_by_id_and_uri(spark, sf):
    return books(spark, sf).where((F.col("book_id") == 17) | (F.col("source_uri") == "file:23")).select("book_id", "title", "author")


@query("SELECT book_id, chunk_index, text FROM book_chunk WHERE book_id = 17 ORDER BY chunk_index LIMIT 20", CHUNKS)
def q88_chunks_of_book(spark, sf):
    return book_chunks(spark, sf).where("book_id = 17").orderBy("chunk_index").limit(20).select("book_id", "chunk_index", "text")


@query("SELECT key, text FROM book_chunk WHERE NOT embedded ORDER BY key LIMIT 100", CHUNKS)
def q89_chunks_to_embed(spark, sf):
    rows = book_chunks(spark, sf).withColumn("embedding", F.when(F.col("embedded"), F.array(F.lit(0.0))))
    return stories.unembedded(rows, "embedding", "key", 100).select("key", "text")


@query("SELECT id, ticker, trim(title) AS title FROM articles WHERE published_at::DATE = DATE '2024-01-03' AND ticker IN ('T0', 'T5') AND collector = 'gemini'", ARTICLES)
def q90_anchor_seeds(spark, sf):
    return stories.anchor_seeds(articles(spark, sf), F.lit("2024-01-03").cast("date"), ["T0", "T5"]).select("id", "ticker", "title")


@query("SELECT id, ticker, title, source, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM articles WHERE ticker = 'T2' ORDER BY articles.published_at DESC, id LIMIT 30", ARTICLES)
def q91_news_view(spark, sf):
    return tables.newest(articles(spark, sf), 30, where=F.col("ticker") == "T2").select("id", "ticker", "title", "source", _stamp("published_at"))


@query("""SELECT id, kind FROM (SELECT id, 'stock' AS kind, published_at FROM articles WHERE ticker = 'T3' UNION ALL SELECT id, 'macro', published_at FROM macro WHERE list_contains(list_transform(related_tickers, lambda t: upper(trim(t))), 'T3'))
  WHERE published_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY published_at DESC, id, kind""", ARTICLES, MACRO)
def q92_stock_and_macro_news(spark, sf):
    own = articles(spark, sf).where("ticker = 'T3'").select("id", F.lit("stock").alias("kind"), "published_at")
    macro = macro_articles(spark, sf).where(F.array_contains(stories.clean_tickers(F.col("related_tickers")), "T3")).select("id", F.lit("macro").alias("kind"), "published_at")
    return own.unionByName(macro).where(F.col("published_at").between(*_january())).orderBy(F.col("published_at").desc(), "id", "kind").select("id", "kind")


@query("""SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, ticker, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close, count(*) AS volume FROM ticks
  WHERE ts >= TIMESTAMP '2024-01-12' AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1, 2""", TICKS)
def q93_bars_of_window(spark, sf):
    until = F.expr("TIMESTAMP_NTZ'2024-01-15 12:00:00'")  # a Monday: one day back is Friday
    return market.bars_between(ticks(spark, sf), "15 minutes", dates.window_start(until, 1), until).select(_stamp("start"), "ticker", "open", "high", "low", "close", "volume")


@query("SELECT l.story_id, a.id, l.role, strftime(a.published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM links l JOIN articles a ON a.id = l.article_id", ARTICLES, "links AS (SELECT doc_id % 97 AS story_id, doc_id AS article_id, CASE WHEN doc_id < 97 THEN 'PRIMARY' ELSE 'SUPPORTING' END AS role FROM documents)")
def q94_story_articles(spark, sf):
    return stories.with_articles(article_links(spark, sf), articles(spark, sf)).select("story_id", "id", "role", _stamp("published_at"))


@query("""SELECT l.story_id, f.id AS filing_id, c.chunk_index, f.form_type || ' · ' || CASE f.form_type WHEN '10-K' THEN '' ELSE 'Q' || quarter(f.filed_date) || ' ' END || year(f.filed_date) AS title FROM
  (SELECT id % 50 AS story_id, min(id) AS filing_id FROM filings GROUP BY 1) l JOIN filings f ON f.id = l.filing_id JOIN (SELECT l_orderkey AS filing_id, min(l_linenumber) AS chunk_index FROM lineitem GROUP BY 1) c ON c.filing_id = f.id""", FILINGS)
def q95_story_filing_chunk(spark, sf):
    filed = filings(spark, sf)
    links = filed.select((F.col("id") % 50).alias("story_id"), F.col("id").alias("filing_id"))
    chunk = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("filing_id"), F.col("l_linenumber").alias("chunk_index"))
    return stories.filing_chunk(links, filed, chunk).select("story_id", "filing_id", "chunk_index", "title")


@query("SELECT DISTINCT t.ticker, upper(trim(r)) AS related FROM (SELECT 'T' || (id % 10) AS ticker, unnest(related_tickers) AS r FROM macro) t WHERE trim(r) <> '' AND upper(trim(r)) <> ticker", ARTICLES, MACRO)
def q96_related_tickers(spark, sf):
    return stories.neighbours(macro_articles(spark, sf), "ticker", "related_tickers")


@query("SELECT s.c_custkey AS story_id, i.id AS insight_id, i.title FROM customer s LEFT JOIN (SELECT o_custkey AS k, max(o_orderkey) AS id, 'insight ' || max(o_orderkey) AS title FROM orders GROUP BY 1) i ON i.k = s.c_custkey")
def q97_last_insight(spark, sf):
    made = table(spark, sf, "orders").select(F.col("o_custkey").alias("story_id"), F.col("o_orderkey").alias("insight_id"), F.concat(F.lit("insight "), F.col("o_orderkey")).alias("title"))
    last = tables.latest_per(made, ["story_id"], "insight_id")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("story_id")).join(last, "story_id", "left").select("story_id", "insight_id", "title")


@query("SELECT id, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time FROM stories WHERE session_label IN ('OVERNIGHT', 'MIXED', 'UNKNOWN') AND event_time BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30' AND ticker = 'T1' ORDER BY stories.event_time DESC, id", STORIES)
def q98_overnight_stories_view(spark, sf):
    found = stories.overnight(story_rows(spark, sf), F.lit("1997-01-01").cast("timestamp"), F.lit("1997-06-30").cast("timestamp"), ["T1"])
    return found.select("id", _stamp("event_time"))


@query("SELECT id, ticker, round(CASE direction_bias WHEN 'UP' THEN 1 WHEN 'DOWN' THEN -1 ELSE 0 END * expected_abs_move_pct, 4) AS move FROM stories WHERE session_label = 'OVERNIGHT' AND expected_abs_move_pct >= 1.2::DOUBLE", STORIES)
def q99_large_moves(spark, sf):
    return stories.large_moves(story_rows(spark, sf), 1.2).select("id", "ticker", F.round("move", 4).alias("move"))


@query("SELECT id, ticker FROM stories WHERE session_label <> 'UNKNOWN' ORDER BY ticker, asof_date DESC, id LIMIT 200", STORIES)
def q100_stories_by_ticker(spark, sf):
    rows = story_rows(spark, sf).where("session_label <> 'UNKNOWN'")
    return rows.orderBy("ticker", F.col("asof_date").desc(), "id").limit(200).select("id", "ticker")


@query("SELECT ticker, day::DATE::VARCHAR AS day, close FROM (SELECT ticker, day, close, 1 AS old FROM daily WHERE day <= DATE '2024-01-20' UNION ALL SELECT ticker, day, close + 1, 0 FROM daily WHERE day >= DATE '2024-01-15') QUALIFY row_number() OVER (PARTITION BY ticker, day ORDER BY old DESC) = 1", TICKS, DAILY)
def q101_bars_joined(spark, sf):
    day = market.bars(ticks(spark, sf), "1 day")
    new = day.where("start >= DATE'2024-01-15'").withColumn("close", F.col("close") + 1)
    out = tables.unseen_added(day.where("start <= DATE'2024-01-20'"), new, ["ticker", "start"])
    return out.select("ticker", F.to_date("start").cast("string").alias("day"), "close")


@query("SELECT count(*) FILTER (contains(low, 'gold')) AS high, count(*) AS items FROM lows", ARTICLES, "lows AS (SELECT *, lower(title || ' ' || summary) AS low FROM articles)")
def q102_high_impact_count(spark, sf):
    low = F.lower(F.concat_ws(" ", "title", "summary"))
    return articles(spark, sf).agg(F.count_if(low.contains("gold")).alias("high"), F.count("*").alias("items"))


@query("SELECT DISTINCT upper(n_name) AS ticker, n_name AS name FROM nation")
def q103_stock_dimension(spark, sf):
    return table(spark, sf, "nation").select(F.upper("n_name").alias("ticker"), F.col("n_name").alias("name")).dropDuplicates(["ticker"])


@query(f"SELECT id, source FROM articles WHERE ticker IN ('T1', 'T8') AND published_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'", ARTICLES)
def q104_symbols_and_window(spark, sf):
    rows = tables.of_symbols(articles(spark, sf), "ticker", [" t1", "T8 "])
    return tables.within(rows, "published_at", *_january()).select("id", "source")


@query("SELECT id FROM articles QUALIFY row_number() OVER (PARTITION BY id % 400 ORDER BY ord) = 1", ARTICLES)
def q105_first_of_id(spark, sf):
    return tables.first_of_id(articles(spark, sf).withColumn("key", F.col("id") % 400), "key", "ord").select("id")


@query(f"SELECT DISTINCT day::DATE::VARCHAR AS day FROM (SELECT o_orderdate::DATE + INTERVAL 30 YEAR AS day FROM orders) WHERE isodow(day) < 6 AND day::DATE::VARCHAR NOT IN ({', '.join(f"'{d}'" for d in config.MARKET_HOLIDAYS)})")
def q106_trading_days(spark, sf):
    days = table(spark, sf, "orders").select(F.add_months(F.to_date("o_orderdate"), 360).alias("day")).distinct()
    return days.where(dates.is_business_day(F.col("day"))).select(F.col("day").cast("string").alias("day"))
