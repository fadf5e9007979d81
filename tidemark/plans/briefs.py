"""Queries of the briefing: signals of five kinds, summaries by symbol, warnings, rule-made summaries, tags and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import finance, text
from tidemark.inputs import ARTICLES, DAILY, FILINGS, MACRO, TICKS, articles, filings, macro_articles, table, ticks
from tidemark.operators import briefing, chunks, market, stories
from tidemark.plans.base import query


def _any(words, low="low"):
    return "(" + " OR ".join(f"contains({low}, '{w.lower()}')" for w in words) + ")"


def _count(words, low="low"):
    return "(" + " + ".join(f"contains({low}, '{w.lower()}')::INT" for w in words) + ")"


LOWS = "lows AS (SELECT *, lower(title || ' ' || summary) AS low FROM articles)"
NEWS_SIG = f"""news AS (SELECT ticker, greatest(least(sum(coalesce(({_count(config.POSITIVE)} - {_count(config.NEGATIVE)})::DOUBLE / nullif({_count(config.POSITIVE)} + {_count(config.NEGATIVE)}, 0) * CASE WHEN {_any(config.HIGH_IMPACT)} THEN 1.5 ELSE 1.0 END, 0)) / count(*), 1), -1)::DOUBLE AS s FROM lows GROUP BY ticker)"""
FILED = "filed AS (SELECT ticker, greatest(least(sum(CASE WHEN form_type = '10-K' AND id % 5 = 0 THEN 0.2::DOUBLE WHEN form_type = '10-K' THEN -0.1::DOUBLE ELSE 0 END), 1), -1)::DOUBLE AS s FROM filings WHERE filed_date >= DATE '1998-11-01' GROUP BY ticker)"
MACRO_SIG = "macro_sig AS (SELECT greatest(least(sum((CASE WHEN NOT contains(low, 'rate') THEN 0 WHEN contains(low, 'cut') OR contains(low, 'lower') THEN 0.3 WHEN contains(low, 'hike') OR contains(low, 'raise') THEN -0.3 ELSE 0 END)::DOUBLE + (CASE WHEN contains(low, 'beat') OR contains(low, 'strong') THEN 0.1 WHEN contains(low, 'miss') OR contains(low, 'weak') THEN -0.1 ELSE 0 END)::DOUBLE), 1), -1)::DOUBLE AS s FROM lows WHERE collector = 'gemini')"
SENT = "sent AS (SELECT 'T' || (user_id % 10) AS ticker, round(avg(value) / 100 - 0.5, 6) AS s FROM events WHERE event_type = 'view' GROUP BY 1)"
TECH = """tech AS (SELECT ticker, close, (close - prev) / nullif(prev, 0) * 100 AS change, low * 0.98 AS support, high * 1.02 AS resistance, (high - low) / nullif(close, 0) * 100 AS volatility FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY day) AS prev FROM daily QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY day DESC) = 1)),
  tech_sig AS (SELECT *, greatest(least(CASE WHEN change > 2 THEN 0.5 WHEN change > 0 THEN 0.2 WHEN change < -2 THEN -0.5 WHEN change < 0 THEN -0.2 ELSE 0 END + CASE WHEN close = 0 OR support = 0 OR resistance = 0 THEN 0 WHEN close < support * 1.02 THEN 0.3 WHEN close > resistance * 0.98 THEN -0.3 ELSE 0 END, 1), -1)::DOUBLE AS s FROM tech)"""
FIVE = """five AS (SELECT t.ticker, coalesce(n.s, 0) AS n, coalesce(x.s, 0) AS x, coalesce(e.s, 0) AS e, coalesce(f.s, 0) AS f, coalesce((SELECT s FROM macro_sig), 0) AS m FROM (SELECT DISTINCT ticker FROM ticks) t LEFT JOIN news n USING (ticker) LEFT JOIN tech_sig x USING (ticker) LEFT JOIN sent e USING (ticker) LEFT JOIN filed f USING (ticker)),
  scored AS (SELECT *, coalesce((0.25::DOUBLE * n + 0.3::DOUBLE * x + 0.2::DOUBLE * e + 0.15::DOUBLE * f + 0.1::DOUBLE * m) / nullif(CASE WHEN n <> 0 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN x <> 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN e <> 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN f <> 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN m <> 0 THEN 0.1::DOUBLE ELSE 0 END, 0), 0) AS score FROM five),
  decided AS (SELECT *, CASE WHEN score > 0.15 THEN 'buy' WHEN score < -0.15 THEN 'sell' ELSE 'hold' END AS direction FROM scored)"""
ALL = (ARTICLES, FILINGS, TICKS, DAILY, LOWS, NEWS_SIG, FILED, MACRO_SIG, SENT, TECH, FIVE)


def _inputs(spark, sf):
    news = articles(spark, sf)
    filed = filings(spark, sf).where("filed_date >= DATE'1998-11-01'").select("id", "ticker", "form_type", F.when(F.col("form_type") == "10-K", "high").otherwise("low").alias("impact"), F.when(F.col("id") % 5 == 0, "an Acquisition").alias("description"))
    views = table(spark, sf, "events").where("event_type = 'view'").groupBy(F.concat(F.lit("T"), F.col("user_id") % 10).alias("ticker"))
    sentiment = views.agg(F.round(F.avg("value") / 100 - 0.5, 6).alias("score"))
    levels = market.technical(market.bars(ticks(spark, sf), "1 day"))
    macro = news.where("collector = 'gemini'").select(text.both(F.col("title"), F.col("summary")).alias("low"))
    return news, filed, sentiment, levels, macro, ticks(spark, sf).select("ticker").distinct()


def _directions(spark, sf):
    news, filed, sentiment, levels, macro, symbols = _inputs(spark, sf)
    return briefing.directions(symbols, market.news_signal(news), levels, sentiment, market.filing_signal(filed), briefing.macro_signals(macro))


@query("SELECT ticker, direction, round(score, 4) AS score, round(least(abs(score), 1), 4) AS confidence FROM decided", *ALL)
def q144_direction_of_five_signals(spark, sf):
    return _directions(spark, sf).select("ticker", "direction", F.round("score", 4).alias("score"), F.round("confidence", 4).alias("confidence"))


@query("SELECT round(s, 4) AS signal FROM macro_sig", ARTICLES, LOWS, MACRO_SIG)
def q145_macro_signal(spark, sf):
    return briefing.macro_signals(_inputs(spark, sf)[4]).select(F.round("signal", 4).alias("signal"))


SUMMARY = """SELECT ticker, direction, (SELECT count(*) FROM articles a WHERE a.ticker = d.ticker) AS news_count, (SELECT count(*) FROM filings f WHERE f.ticker = d.ticker AND f.filed_date >= DATE '1998-11-01') AS filings_count, round(t.support, 4) AS support, round(t.resistance, 4) AS resistance,
  concat_ws('; ', CASE WHEN EXISTS (SELECT 1 FROM filings f WHERE f.ticker = d.ticker AND f.filed_date >= DATE '1998-11-01' AND form_type = '10-K') THEN 'High-impact SEC filing detected' END, CASE WHEN t.volatility > 3 THEN 'High volatility warning' END, CASE WHEN e.s < -0.3 THEN 'Negative social sentiment' END) AS risks
  FROM decided d LEFT JOIN tech t USING (ticker) LEFT JOIN sent e USING (ticker)"""


def _summaries(spark, sf):
    news, filed, sentiment, levels, _, _ = _inputs(spark, sf)
    return briefing.stock_summaries(_directions(spark, sf), news, filed, levels, sentiment)


@query(SUMMARY, *ALL)
def q146_stock_summaries(spark, sf):
    out = _summaries(spark, sf)
    return out.select("ticker", "direction", "news_count", "filings_count", F.round("support", 4).alias("support"), F.round("resistance", 4).alias("resistance"), F.array_join("risk_warnings", "; ").alias("risks"))


@query("""SELECT concat_ws(', ', CASE WHEN n > 0 THEN n || ' high-impact news items' END, CASE WHEN f > 0 THEN f || ' important SEC filings' END) AS counts, buys, sells, coalesce((SELECT string_agg(ticker, ', ' ORDER BY ticker) FROM (SELECT ticker FROM decided WHERE direction = 'buy' ORDER BY ticker LIMIT 3)), '') AS bullish, coalesce((SELECT string_agg(ticker, ', ' ORDER BY ticker) FROM (SELECT ticker FROM decided WHERE direction = 'sell' ORDER BY ticker LIMIT 3)), '') AS bearish
  FROM (SELECT count(*) AS n FROM lows WHERE contains(low, 'rate')), (SELECT count(*) AS f FROM filings WHERE filed_date >= DATE '1998-11-01' AND form_type = '10-K'), (SELECT count(*) FILTER (direction = 'buy') AS buys, count(*) FILTER (direction = 'sell') AS sells FROM decided)""", *ALL)
def q147_rule_summary(spark, sf):
    news, filed, *_ = _inputs(spark, sf)
    high = news.where(text.both(F.col("title"), F.col("summary")).contains("rate"))
    return briefing.rule_summary(high, filed.where("impact = 'high'"), _directions(spark, sf)).select("counts", "buys", "sells", "bullish", "bearish")


@query("SELECT 'Summary of ' || (SELECT count(*) FROM articles) || ' items.' AS summary, string_agg('• ' || substr(title, 1, 100), chr(10) ORDER BY id) AS points FROM (SELECT id, title FROM articles ORDER BY id LIMIT 5)", ARTICLES)
def q148_items_summary(spark, sf):
    return briefing.items_summary(articles(spark, sf), "id").select("summary", F.array_join("key_points", "\n").alias("points"))


@query("""SELECT concat_ws(chr(10), 'HIGH-IMPACT NEWS:' || chr(10) || (SELECT string_agg('  - ' || title || ' (' || ticker || ')', chr(10) ORDER BY id) FROM (SELECT id, title, ticker FROM lows WHERE contains(low, 'rate') ORDER BY id LIMIT 5)), 'SEC FILINGS:' || chr(10)
  || (SELECT string_agg('  - ' || ticker || ': ' || form_type, chr(10) ORDER BY id) FROM (SELECT id, ticker, form_type FROM filings WHERE filed_date >= DATE '1998-11-01' AND form_type = '10-K' ORDER BY id LIMIT 3))) AS context""", ARTICLES, FILINGS, LOWS)
def q149_summary_context(spark, sf):
    news, filed, *_ = _inputs(spark, sf)
    high = news.where(text.both(F.col("title"), F.col("summary")).contains("rate"))
    parts = {"HIGH-IMPACT NEWS:": (high, F.concat("title", F.lit(" ("), "ticker", F.lit(")")), 5), "SEC FILINGS:": (filed.where("impact = 'high'"), F.concat("ticker", F.lit(": "), "form_type"), 3)}
    return briefing.context(parts, "id")


@query("SELECT id, min(s) AS symbol FROM (SELECT id, CASE WHEN contains(low, lower(s)) OR ticker = s THEN s END AS s FROM lows, (VALUES ('T1'), ('T2'), ('GOLD')) v(s)) WHERE s IS NOT NULL GROUP BY id", ARTICLES, LOWS)
def q150_news_of_symbols(spark, sf):
    symbols = spark.createDataFrame([("T1",), ("T2",), ("GOLD",)], "symbol string")
    return briefing.news_of_symbols(articles(spark, sf), symbols).select("id", "symbol")


@query(f"SELECT id, {_any(('t1', 'gold'))} AND low <> '' AS relevant, array_to_string(list_filter(['earnings', 'rate', 'gold', 'fed'], lambda k: contains(low, k))[1:10], ',') AS matched FROM lows", ARTICLES, LOWS)
def q151_relevance_of_item(spark, sf):
    low = text.both(F.col("title"), F.col("summary"))
    return articles(spark, sf).select("id", (text.has_any(low, ["t1", "gold"]) & (low != "")).alias("relevant"), F.array_join(text.matched(low, ["earnings", "rate", "gold", "fed"]), ",").alias("matched"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'high' WHEN event_type = 'click' THEN 'medium' ELSE CASE WHEN value > 90 THEN 'high' ELSE 'low' END END AS impact FROM events")
def q152_macro_event_impact(spark, sf):
    e = table(spark, sf, "events").withColumn("impact", F.when(F.col("value") > 90, "high").otherwise("low"))
    return briefing.tagged_events(e, F.col("event_type"), {"high": ("error",), "medium": ("click",)}).select("event_id", "impact")


@query("SELECT id, form_type || CASE id % 3 WHEN 0 THEN '/A' ELSE '' END AS form, 'high' AS impact FROM filings WHERE id % 3 < 2 UNION ALL SELECT id, '4' || (id % 7), 'medium' FROM filings WHERE id % 3 = 2", FILINGS)
def q153_filing_impact(spark, sf):
    from tidemark.sources.feeds import filing_impact

    form = F.when(F.col("id") % 3 == 2, F.concat(F.lit("4"), F.col("id") % 7)).otherwise(F.concat("form_type", F.when(F.col("id") % 3 == 0, "/A").otherwise("")))
    return filings(spark, sf).select("id", form.alias("form")).withColumn("impact", filing_impact(F.col("form")))


@query("SELECT 'company_news' AS category, doc_id AS id FROM documents UNION ALL SELECT 'macro_event', event_id FROM events WHERE event_type = 'error' UNION ALL SELECT 'technical_data', n_nationkey FROM nation UNION ALL SELECT 'market_sentiment', r_regionkey FROM region")
def q154_categorised(spark, sf):
    every = {"company_news": table(spark, sf, "documents").select(F.col("doc_id").alias("id")), "macro_event": table(spark, sf, "events").where("event_type = 'error'").select(F.col("event_id").alias("id")),
             "technical_data": table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id")), "market_sentiment": table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"))}
    return briefing.categorised(every).select("category", "id")


@query("SELECT id, ticker FROM articles ORDER BY published_at DESC NULLS LAST, ord LIMIT 150", ARTICLES)
def q155_sorted_by_time(spark, sf):
    rows = articles(spark, sf)
    return rows.orderBy(F.col("published_at").desc_nulls_last(), "ord").limit(150).select("id", "ticker")


@query("SELECT id, CASE WHEN s IS NULL THEN 'medium' WHEN s >= 0.7 THEN 'high' WHEN s >= 0.3 THEN 'medium' ELSE 'low' END AS level FROM (SELECT event_id AS id, CASE WHEN event_id % 4 > 0 THEN value / 100 END AS s FROM events) ORDER BY s DESC NULLS LAST, id LIMIT 500")
def q156_by_impact_score(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 > 0, (F.col("value") / 100).cast("string")).otherwise("bad").alias("raw"))
    scored = rows.withColumn("s", F.col("raw").try_cast("double"))
    return scored.orderBy(F.col("s").desc_nulls_last(), "id").limit(500).select("id", finance.impact_of_score(F.col("s")).alias("level"))


@query("SELECT id, ticker, title, 'story' AS kind FROM articles WHERE lower(trim(title)) IN (SELECT lower(trim(title)) FROM articles GROUP BY 1 HAVING count(*) > 1) QUALIFY row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY id) > 1", ARTICLES)
def q157_repeated_titles(spark, sf):
    rows = articles(spark, sf).withColumn("key", F.lower(F.trim("title")))
    first = rows.groupBy("key").agg(F.min("id").alias("first"))
    return rows.join(first, "key").where("id <> first").select("id", "ticker", "title", F.lit("story").alias("kind"))


@query("SELECT event_id AS id, unnest(['drivers: x ' || event_id, 'drivers: name: y; note: link', 'risk: ' || event_type]) AS bullet FROM events")
def q158_bullets(spark, sf):
    made = F.concat(F.lit('{"drivers": ["x '), F.col("event_id"), F.lit('", {"name": "y", "note": "[link](http://z) ..."}], "empty": [], "risk": "'), F.col("event_type"), F.lit('"}'))
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), made.alias("body"))
    return rows.select("id", F.explode(chunks.bullets(F.col("body"))).alias("bullet"))


@query("SELECT id, array_to_string(list_sort(list_distinct([upper(ticker), 'T1'])), ',') AS related FROM articles", ARTICLES)
def q159_related_of_answer(spark, sf):
    answer = F.array(F.lower("ticker"), F.lit("T1 "), F.lit("zzz"), F.lit("SELF"))
    known = F.array(*(F.lit(f"T{k}") for k in range(10)), F.lit("SELF"))
    return articles(spark, sf).select("id", F.array_join(F.array_sort(stories.related_of_answer(answer, known, F.lit("SELF"))), ",").alias("related"))


@query("SELECT id, t.topic AS topic, round(t.score, 4) AS score FROM (SELECT id, list_reverse_sort(list_transform(list_filter(topics, lambda t: t.score IS NOT NULL), lambda t: {'score': t.score, 'o': CASE t.topic WHEN 'economy_macro' THEN 3 WHEN 'financial_markets' THEN 2 ELSE 1 END, 'topic': t.topic}))[1] AS t FROM macro) WHERE t.score > 0.9::DOUBLE", ARTICLES, MACRO)
def q160_primary_topic(spark, sf):
    rows = macro_articles(spark, sf).withColumn("t", finance.primary_topic(F.col("topics")))
    return rows.where("t.score > 0.9").select("id", F.col("t.topic").alias("topic"), F.round("t.score", 4).alias("score"))
