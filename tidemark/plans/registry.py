"""Registered queries of the news and market operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import dates, finance, ids, text
from tidemark.inputs import ARTICLES, DAILY, FILINGS, TICKS, VECTORS, articles, filings, table, ticks, vectors
from tidemark.operators import chunks, graph, market, search, stories, tables
from tidemark.operators import vectors as vec
from tidemark.plans import jobs
from tidemark.plans.base import QUERIES, SQL, query
from tidemark.streaming import limits

#: Thresholds for the supplied vectors, whose largest cosine is about 0.5.
T_ASSIGN, T_GRAPH = 0.30, 0.35
#: Words that occur in the supplied prose, beside the default lists.
FIXTURE_WORDS = ("rate", "gold", "ig", "fed", "the", "tion")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    import_all()
    return dict(SQL)


def import_all() -> None:
    """The other modules of queries register theirs when they are imported."""
    from tidemark.plans import briefs, reads, retrieval, sourcing, stored, storylines, writes  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q31_story_clusters(spark, sf_dir)


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _low():
    return text.both(F.col("title"), F.col("summary"))


def _sum_sql(words, low: str = "low") -> str:
    quoted = [w.lower().replace("'", "''") for w in words]
    return "(" + " + ".join(f"contains({low}, '{w}')::INT" for w in quoted) + ")"


def _any_sql(words, low: str = "low") -> str:
    return "(" + " OR ".join(f"contains({low}, '{w.lower()}')" for w in words) + ")"


LOW = "lows AS (SELECT *, lower(title || ' ' || summary) AS low FROM articles)"


# Table reads


@query("SELECT id, ticker, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, title FROM articles WHERE published_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY articles.published_at DESC, id LIMIT 50", ARTICLES)
def q01_article_range_topk(spark, sf):
    where = F.col("published_at").between(F.expr("TIMESTAMP_NTZ'2024-01-05 00:00:00'"), F.expr("TIMESTAMP_NTZ'2024-01-20 00:00:00'"))
    return tables.newest(articles(spark, sf), 50, where=where).select("id", "ticker", _stamp("published_at"), "title")


@query("SELECT id, ('0x' || substr(md5(ticker || '_' || id), 1, 14))::BIGINT AS stable_id, 'av_' || substr(md5(title || source), 1, 12) AS short_id FROM articles", ARTICLES)
def q02_stable_bigint_id(spark, sf):
    return articles(spark, sf).select("id", ids.bigint_id(ids.joined_key(F.col("ticker"), F.col("id"))).alias("stable_id"), ids.short_id("av_", F.col("title"), F.col("source")).alias("short_id"))


@query("SELECT id, ticker, published_at::DATE::VARCHAR AS day FROM articles QUALIFY row_number() OVER (PARTITION BY ticker, published_at::DATE ORDER BY length(summary) DESC, id) <= 2", ARTICLES)
def q03_cap_per_ticker_day(spark, sf):
    rows = articles(spark, sf).withColumn("day", F.to_date("published_at")).withColumn("score", F.length("summary"))
    return tables.capped(rows, ["ticker", "day"], "score", 2).select("id", "ticker", F.col("day").cast("string").alias("day"))


@query("SELECT event_type, event_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= CASE WHEN event_type = 'purchase' THEN 20 ELSE 3 END")
def q04_primary_plus_cross(spark, sf):
    return tables.primary_and_cross(table(spark, sf, "events"), "event_type", "purchase", "value", 20, 3, "event_id").select("event_type", "event_id", "rank")


@query("SELECT user_id, max((ts, event_id)).event_id AS event_id FROM (SELECT user_id, {'ts': ts, 'event_id': event_id} AS s FROM events) GROUP BY user_id".replace("max((ts, event_id)).event_id", "max(s).event_id"))
def q05_latest_per_key(spark, sf):
    return tables.latest_per(table(spark, sf, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id")


@query("SELECT t.event_id, f.id AS filing_id, f.filed_date::VARCHAR AS filed_date FROM (SELECT *, (ts::DATE - INTERVAL 27 YEAR)::DATE AS d FROM ticks) t LEFT JOIN (SELECT ticker, filed_date, max(id) AS id FROM filings GROUP BY ALL) f ON f.ticker = t.ticker AND f.filed_date = (SELECT max(g.filed_date) FROM filings g WHERE g.ticker = t.ticker AND g.filed_date <= t.d)", TICKS, FILINGS)
def q06_asof_latest_filing(spark, sf):
    left = ticks(spark, sf).select("event_id", "ticker", F.add_months(F.to_date("ts"), -12 * 27).alias("d"))
    found = tables.as_of(left, filings(spark, sf).select("ticker", "filed_date", "id"), "ticker", "d", "filed_date", "id", "f_")
    return found.select("event_id", F.col("f_id").alias("filing_id"), F.col("f_filed_date").cast("string").alias("filed_date"))


@query("SELECT id FROM filings a WHERE EXISTS (SELECT 1 FROM filings b WHERE b.ticker = a.ticker AND b.form_type = '10-K' AND b.filed_date > a.filed_date AND b.filed_date <= a.filed_date + 2)", FILINGS)
def q07_newer_filing_semi(spark, sf):
    f = filings(spark, sf)
    left = f.select("id", "ticker", "filed_date", F.date_add("filed_date", 2).alias("until"))
    return tables.has_between(left, f.where("form_type = '10-K'"), "ticker", "filed_date", "until", "filed_date").select("id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def q08_orphans_anti(spark, sf):
    had = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.without(table(spark, sf, "orders"), had, ["o_orderkey"]).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200) ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
def q09_discover_two_stage(spark, sf):
    return tables.newest(tables.newest(table(spark, sf, "orders"), 200, "o_orderdate", "o_orderkey"), 20, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_orderkey) AS orders, count(l_linenumber) AS lines, max(o_orderdate)::DATE::VARCHAR AS latest FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def q10_timeline_by_month(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("l_linenumber").alias("n"))
    rows = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    out = rows.groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return out.agg(F.count("*").alias("orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.to_date(F.max("o_orderdate")).cast("string").alias("latest"))


# Market data


@query("SELECT ticker, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close, count(*) AS volume FROM ticks GROUP BY 1, 2", TICKS)
def q11_bars_5min(spark, sf):
    return market.bars(ticks(spark, sf)).select("ticker", _stamp("start"), "open", "high", "low", "close", "volume")


@query("SELECT ticker, day::DATE::VARCHAR AS day, close >= coalesce(lag(close) OVER (PARTITION BY ticker ORDER BY day), open) AS rising FROM daily", TICKS, DAILY)
def q12_volume_flag_lag(spark, sf):
    return market.volume_flags(market.bars(ticks(spark, sf), "1 day")).select("ticker", F.to_date("start").cast("string").alias("day"), "rising")


@query("SELECT ticker, day::DATE::VARCHAR AS day, round(avg(volume) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), 4) AS mean_volume FROM daily", TICKS, DAILY)
def q13_trailing21_volume(spark, sf):
    return market.trailing_volume(market.bars(ticks(spark, sf), "1 day")).select("ticker", F.to_date("start").cast("string").alias("day"), F.round("mean_volume", 4).alias("mean_volume"))


@query("SELECT ticker, round(arg_max(close, day) - arg_min(open, day), 4) AS change, round((arg_max(close, day) - arg_min(open, day)) / arg_min(open, day) * 100, 4) AS percent FROM daily GROUP BY ticker", TICKS, DAILY)
def q14_visible_return(spark, sf):
    return market.visible_return(market.bars(ticks(spark, sf), "1 day")).select("ticker", F.round("change", 4).alias("change"), F.round("percent", 4).alias("percent"))


TECHNICAL = """technical AS (SELECT ticker, day, close, (close - prev) / nullif(prev, 0) * 100 AS change_percent, low * 0.98 AS support, high * 1.02 AS resistance, (high - low) / nullif(close, 0) * 100 AS volatility
  FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY day) AS prev, row_number() OVER (PARTITION BY ticker ORDER BY day DESC) AS n FROM daily) WHERE n = 1)"""


@query("SELECT ticker, close, round(change_percent, 4) AS change_percent, round(support, 4) AS support, round(resistance, 4) AS resistance, round(volatility, 4) AS volatility FROM technical", TICKS, DAILY, TECHNICAL)
def q15_technical_levels(spark, sf):
    out = market.technical(market.bars(ticks(spark, sf), "1 day"))
    return out.select("ticker", "close", *(F.round(c, 4).alias(c) for c in ("change_percent", "support", "resistance", "volatility")))


# Scores


_RELEVANCE = f"""least(CASE WHEN contains(low, 't1') OR contains(low, 'gold') OR upper(ticker) IN ('T1', 'GOLD') THEN 0.4::DOUBLE ELSE 0 END + least({_sum_sql(FIXTURE_WORDS)} * 0.1::DOUBLE, 0.4::DOUBLE)
  + CASE WHEN {_any_sql(config.RELIABLE_SOURCES, "lower(source)")} THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN date_diff('second', published_at, TIMESTAMP '2024-01-15') / 3600.0 < 6 THEN 0.1::DOUBLE ELSE 0 END, 1::DOUBLE)"""


@query(f"SELECT id, round({_RELEVANCE}, 4) AS score FROM lows", ARTICLES, LOW)
def q16_relevance_score(spark, sf):
    age = F.expr("timestampdiff(SECOND, published_at, TIMESTAMP_NTZ'2024-01-15 00:00:00')") / 3600
    score = finance.relevance(_low(), F.col("ticker"), ["t1", "gold"], F.col("source"), age, FIXTURE_WORDS)
    return articles(spark, sf).select("id", F.round(score, 4).alias("score"))


_IMPACT = f"CASE WHEN {_any_sql(config.HIGH_IMPACT + ('gold',))} THEN 'high' WHEN {_any_sql(config.MEDIUM_IMPACT + ('rate',))} THEN 'medium' ELSE 'low' END"


@query(f"SELECT id, {_IMPACT} AS impact FROM lows", ARTICLES, LOW)
def q17_impact_level(spark, sf):
    return articles(spark, sf).select("id", finance.impact_of_news(_low(), config.HIGH_IMPACT + ("gold",), config.MEDIUM_IMPACT + ("rate",)).alias("impact"))


def _argmax_sql(scores: dict, default: str) -> str:
    top = f"greatest({', '.join(scores.values())})"
    return f"CASE WHEN {top} <= 0 THEN '{default}' " + " ".join(f"WHEN {v} = {top} THEN '{k}'" for k, v in scores.items()) + " END"


@query(f"SELECT id, {_argmax_sql({k: _sum_sql(v) for k, v in config.CATEGORIES.items()}, 'company_news')} AS category FROM lows", ARTICLES, LOW)
def q18_category_argmax(spark, sf):
    return articles(spark, sf).select("id", finance.category(_low()).alias("category"))


_TOPIC_SQL = {k: f"(CASE WHEN {_sum_sql(v)} = 0 THEN 25 ELSE least(100, 50 + 10 * {_sum_sql(v)}) END)" for k, v in config.TOPICS.items()}


@query(f"SELECT id, {_argmax_sql(_TOPIC_SQL, 'FX')} AS topic, greatest({', '.join(_TOPIC_SQL.values())})::INT AS relevance_score FROM lows", ARTICLES, LOW)
def q19_topic_router(spark, sf):
    return finance.with_topic(articles(spark, sf), _low()).select("id", "topic", "relevance_score")


_SENT = f"""coalesce(({_sum_sql(config.POSITIVE)} - {_sum_sql(config.NEGATIVE)})::DOUBLE / nullif({_sum_sql(config.POSITIVE)} + {_sum_sql(config.NEGATIVE)}, 0) * CASE WHEN {_any_sql(config.HIGH_IMPACT)} THEN 1.5 ELSE 1.0 END, 0)"""
NEWS = f"news AS (SELECT ticker, greatest(least(sum({_SENT}) / count(*), 1), -1)::DOUBLE AS signal, count(*) AS items FROM lows GROUP BY ticker)"


@query("SELECT ticker, round(signal, 4) AS signal, items FROM news", ARTICLES, LOW, NEWS)
def q20_news_sentiment(spark, sf):
    return market.news_signal(articles(spark, sf)).select("ticker", F.round("signal", 4).alias("signal"), "items")


DIRECTIONS = """signals AS (SELECT coalesce(t.ticker, n.ticker) AS ticker, coalesce(n.signal, 0) AS ns,
    coalesce(greatest(least(CASE WHEN change_percent > 2 THEN 0.5 WHEN change_percent > 0 THEN 0.2 WHEN change_percent < -2 THEN -0.5 WHEN change_percent < 0 THEN -0.2 ELSE 0 END
    + CASE WHEN close = 0 OR support = 0 OR resistance = 0 THEN 0 WHEN close < support * 1.02 THEN 0.3 WHEN close > resistance * 0.98 THEN -0.3 ELSE 0 END, 1), -1), 0)::DOUBLE AS ts
  FROM technical t FULL JOIN news n ON t.ticker = n.ticker),
  scores AS (SELECT ticker, coalesce((CASE WHEN ts <> 0 THEN 0.3::DOUBLE * ts ELSE 0 END + CASE WHEN ns <> 0 THEN 0.25::DOUBLE * ns ELSE 0 END) / nullif(CASE WHEN ts <> 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN ns <> 0 THEN 0.25::DOUBLE ELSE 0 END, 0), 0) AS score FROM signals),
  directions AS (SELECT ticker, CASE WHEN score > 0.15 THEN 'buy' WHEN score < -0.15 THEN 'sell' ELSE 'hold' END AS direction, score, least(abs(score), 1) AS confidence FROM scores)"""


def _directions(spark, sf):
    levels = market.technical(market.bars(ticks(spark, sf), "1 day"))
    return market.trading_direction(levels, market.news_signal(articles(spark, sf))), levels


@query("SELECT ticker, direction, round(score, 4) AS score, round(confidence, 4) AS confidence FROM directions", TICKS, DAILY, TECHNICAL, ARTICLES, LOW, NEWS, DIRECTIONS)
def q21_trading_direction(spark, sf):
    return _directions(spark, sf)[0].select("ticker", "direction", F.round("score", 4).alias("score"), F.round("confidence", 4).alias("confidence"))


@query("""SELECT ticker, round(move, 4) AS move, CASE WHEN abs(move) < 0.1 THEN 'Neutral' WHEN move > 0 THEN 'Up' ELSE 'Down' END AS label FROM (
  SELECT 'T' || (user_id % 10) AS ticker, sum((CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END * value / 100 * CASE WHEN event_id % 7 > 0 THEN (event_id % 7) / 7.0::DOUBLE ELSE 1 END)) / sum(CASE WHEN event_id % 7 > 0 THEN (event_id % 7) / 7.0::DOUBLE ELSE 1 END) AS move FROM events GROUP BY 1)""")
def q22_expected_move(spark, sf):
    stories = table(spark, sf, "events").select(
        F.concat(F.lit("T"), F.col("user_id") % 10).alias("ticker"), F.when(F.col("event_type") == "purchase", "UP").when(F.col("event_type") == "error", "DOWN").alias("bias"),
        (F.col("value") / 100).alias("move"), ((F.col("event_id") % 7) / 7.0).alias("confidence"),
    )
    return market.expected_move(stories).select("ticker", F.round("move", 4).alias("move"), "label")


# Duplicates and graphs


@query("SELECT md5(lower(trim(text))) AS digest, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY 1")
def q23_exact_dedupe(spark, sf):
    return table(spark, sf, "documents").groupBy(F.md5(F.lower(F.trim("text"))).alias("digest")).agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies"))


@query("SELECT id FROM articles QUALIFY row_number() OVER (PARTITION BY ticker, lower(trim(title)), published_at::DATE ORDER BY id) > 1", ARTICLES)
def q24_dup_by_title(spark, sf):
    return stories.duplicate_ids(articles(spark, sf))


@query()
def q25_greedy_title_dedupe(spark, sf):
    return search.keep_first_titles(articles(spark, sf).select("ord", "title"))


#: One vector of each day after another, kept if no kept one is like it.
_KEEP = (
    "unitv AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM vec)",
    "items AS (SELECT id, published_at::DATE AS day, row_number() OVER (PARTITION BY published_at::DATE ORDER BY id) AS n, u FROM unitv)",
    f"near AS (SELECT b.id, list(a.id) AS earlier FROM items a JOIN items b ON a.day = b.day AND a.id < b.id AND round(list_dot_product(a.u, b.u), 5) >= {T_GRAPH}::DOUBLE GROUP BY b.id)",
    """keep AS (SELECT DISTINCT day, 0::BIGINT AS n, []::BIGINT[] AS kept FROM items UNION ALL
  SELECT k.day, k.n + 1, CASE WHEN earlier IS NULL OR len(list_intersect(kept, earlier)) = 0 THEN list_append(kept, i.id) ELSE kept END FROM keep k JOIN items i ON i.day = k.day AND i.n = k.n + 1 LEFT JOIN near USING (id))""",
)


@query("SELECT unnest(kept) AS id FROM (SELECT * FROM keep QUALIFY row_number() OVER (PARTITION BY day ORDER BY n DESC) = 1)", VECTORS, *_KEEP)
def q26_greedy_cosine_dedupe(spark, sf):
    rows = vec.with_unit(vectors(spark, sf)).withColumn("day", F.to_date("published_at"))
    return vec.keep_first_similar(rows, T_GRAPH, "day").select("id")


COSINE = """unitv AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM vec),
  sims AS (SELECT q.id AS query_id, r.id AS id, q.ticker AS query_ticker, r.ticker, r.published_at, round(list_dot_product(q.u, r.u), 5) AS sim FROM unitv q JOIN unitv r ON q.id <> r.id WHERE q.id % 50 = 0)"""


def _queries_of(rows):
    return vec.as_queries(rows.where("id % 50 = 0"), "ticker")


@query("SELECT query_id, id, sim, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM sims) WHERE rank <= 10", VECTORS, COSINE)
def q27_cosine_topk(spark, sf):
    rows = vec.with_unit(vectors(spark, sf))
    return vec.nearest(rows, vec.as_queries(rows.where("id % 50 = 0")), 10)


@query("""SELECT query_id, id, sim, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM (
  SELECT * FROM sims WHERE ticker = query_ticker QUALIFY row_number() OVER (PARTITION BY query_id, published_at::DATE ORDER BY sim DESC, id) <= 2)) WHERE rank <= 6""", VECTORS, COSINE)
def q28_retrieve_similar(spark, sf):
    rows = vec.with_unit(vectors(spark, sf))
    return vec.retrieve(rows, _queries_of(rows), 6, 2).select("query_id", "id", "sim", "rank")


@query("SELECT query_id, id, sim FROM sims WHERE ticker = query_ticker AND sim > 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) = 1", VECTORS, COSINE)
def q29_best_above_threshold(spark, sf):
    rows = vec.with_unit(vectors(spark, sf))
    return vec.best_above(rows, _queries_of(rows), 0.2)


ASSIGNED = """unitv AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM vec),
  best AS (SELECT r.id, a.id AS anchor_id, round(list_dot_product(a.u, r.u), 5) AS sim FROM unitv r JOIN unitv a ON a.anchor AND NOT r.anchor AND a.ticker = r.ticker QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY round(list_dot_product(a.u, r.u), 5) DESC, a.id) = 1)"""


@query(f"SELECT v.id, CASE WHEN sim >= {T_ASSIGN} THEN anchor_id END AS anchor_id, CASE WHEN sim >= {T_ASSIGN} THEN sim END AS sim FROM unitv v LEFT JOIN best USING (id) WHERE NOT v.anchor", VECTORS, ASSIGNED)
def q30_anchor_assign(spark, sf):
    rows = vec.with_unit(vectors(spark, sf))
    return vec.assign(rows.where("NOT anchor"), vec.as_queries(rows.where("anchor"), "ticker"), T_ASSIGN, "ticker")


CLUSTERS = f"""rest AS (SELECT id, u, ticker FROM unitv WHERE NOT anchor AND id NOT IN (SELECT id FROM best WHERE sim >= {T_ASSIGN})),
  edges AS (SELECT a.id AS a, b.id AS b FROM rest a JOIN rest b ON a.id <> b.id AND a.ticker = b.ticker WHERE round(list_dot_product(a.u, b.u), 5) >= {T_GRAPH}),
  reach AS (SELECT id, id AS r FROM rest UNION SELECT e.b, r FROM reach JOIN edges e ON e.a = reach.id WHERE r < e.b),
  members AS (SELECT id, min(r) AS cluster, 'discovered' AS cluster_type FROM reach GROUP BY id UNION ALL SELECT id, anchor_id, 'seeded' FROM best WHERE sim >= {T_ASSIGN} UNION ALL SELECT id, id, 'seeded' FROM unitv WHERE anchor)"""


@query("SELECT cluster, cluster_type, count(*) AS members, ('0x' || substr(md5(min(id) || '_' || count(*) || '_' || bit_xor(('0x' || substr(md5(id::VARCHAR), 1, 14))::BIGINT)), 1, 14))::BIGINT AS story_id FROM members GROUP BY 1, 2", VECTORS, ASSIGNED, CLUSTERS)
def q31_story_clusters(spark, sf):
    found = vec.clusters(vec.with_unit(vectors(spark, sf)), T_ASSIGN, T_GRAPH, "ticker")
    out = found.groupBy("cluster", "cluster_type").agg(F.count("*").alias("members"), ids.members_key(F.col("id")).alias("key"))
    return out.select("cluster", "cluster_type", "members", ids.bigint_id(F.col("key")).alias("story_id"))


# Search


BM25 = """tok AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM documents),
  stats AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM tok),
  qw AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w FROM benchmark),
  tf AS (SELECT id, dl, w, count(*) AS tf FROM (SELECT id, len(ws) AS dl, unnest(ws) AS w FROM tok) WHERE w IN (SELECT w FROM qw) GROUP BY ALL),
  df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
  kw AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (w) JOIN qw USING (w), stats GROUP BY 1, 2)"""


def _keyword(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.bm25(docs, table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text")))


@query("SELECT query_id, id, round(score, 4) AS score FROM kw QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, id) <= 10", BM25)
def q32_bm25(spark, sf):
    scored = _keyword(spark, sf).withColumn("score", F.round("score", 4))
    return tables.top_per(scored, ["query_id"], [F.col("score").desc(), F.col("id")], 10)


HYBRID = """unitv AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM vec),
  vsim AS (SELECT q.id AS query_id, r.id, round(list_dot_product(q.u, r.u), 5) AS sim FROM unitv q JOIN unitv r ON q.id IN (SELECT item_id FROM benchmark))"""


def _vector_sides(spark, sf):
    """Rows, and those of them that the keyword queries name, as queries."""
    rows = vec.with_unit(vectors(spark, sf))
    return rows, vec.as_queries(rows.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("id")), "id", "left_semi"))


@query("SELECT query_id, id, round(coalesce(score, 0) + 0.5::DOUBLE * coalesce(sim, 0), 4) AS score FROM kw FULL JOIN vsim USING (query_id, id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(score, 0) + 0.5::DOUBLE * coalesce(sim, 0), 4) DESC, id) <= 10", BM25, VECTORS, HYBRID)
def q33_hybrid(spark, sf):
    out = search.best_hybrid(_keyword(spark, sf), *_vector_sides(spark, sf), k=10).withColumn("score", F.round("score", 4))
    return tables.top_per(out, ["query_id"], [F.col("score").desc(), F.col("id")], 10)


RRF = """SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, id) AS rank FROM kw QUALIFY rank <= 20 UNION ALL
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM vsim QUALIFY rank <= 20) GROUP BY 1, 2"""


@query(RRF, BM25, VECTORS, HYBRID)
def q34_rrf(spark, sf):
    key = F.struct("query_id", "id").alias("k")
    kw = tables.top_per(_keyword(spark, sf).withColumn("score", F.round("score", 4)), ["query_id"], [F.col("score").desc(), F.col("id")], 20, rank="rank").select(key, "rank")
    vs = vec.nearest(*_vector_sides(spark, sf), 20, itself=True).select(key, "rank")
    return tables.fused({"kw": kw, "vs": vs}, "k").select("k.query_id", "k.id", F.round("score", 6).alias("score"))


# Selection, calendar


@query("""SELECT o_orderkey FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_totalprice DESC, o_orderkey) <= 4) ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def q35_select_span_months(spark, sf):
    return tables.span_months(table(spark, sf, "orders"), F.date_format("o_orderdate", "yyyy-MM"), F.col("o_totalprice"), 4, 100, "o_orderkey").orderBy("o_orderdate", "o_orderkey").select("o_orderkey")


@query("SELECT o_custkey, count(DISTINCT isoyear(o_orderdate) * 100 + week(o_orderdate)) AS weeks FROM orders GROUP BY 1 HAVING weeks <= 5")
def q36_same_week_gate(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.countDistinct(dates.iso_week(F.col("o_orderdate"))).alias("weeks")).where("weeks <= 5")


@query("""SELECT u.user_id, d.day::DATE::VARCHAR AS day FROM (SELECT DISTINCT user_id FROM events) u, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) d(day)
  WHERE isodow(d.day) < 6 AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.ts::DATE = d.day::DATE)""")
def q37_gap_detection(spark, sf):
    days = F.filter(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date")), lambda d: dates.is_business_day(d))
    return tables.missing_days(table(spark, sf, "events"), "user_id", F.to_date("ts"), days).select("user_id", F.col("day").cast("string").alias("day"))


_HOLIDAYS = "(" + ", ".join(f"'{d}'" for d in config.MARKET_HOLIDAYS) + ")"
#: Event times moved by 365 days, into a year with listed holidays.
MOVED = "moved AS (SELECT event_id, ts + INTERVAL 365 DAY AS ts FROM events), wall AS (SELECT event_id, ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny FROM moved)"


def _moved(spark, sf):
    return table(spark, sf, "events").select("event_id", (F.col("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts"))


@query(f"SELECT event_id, isodow(ts) < 6 AND ts::DATE::VARCHAR NOT IN {_HOLIDAYS} AS business FROM moved", MOVED)
def q38_business_day(spark, sf):
    return _moved(spark, sf).select("event_id", dates.is_business_day(F.to_date("ts")).alias("business"))


@query(f"""SELECT event_id, strftime(((max(d.day) + INTERVAL 16 HOUR) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS start
  FROM wall, generate_series(TIMESTAMP '2024-12-15', TIMESTAMP '2025-03-01', INTERVAL 1 DAY) d(day)
  WHERE d.day <= CASE WHEN hour(ny) >= 16 THEN ny::DATE ELSE ny::DATE - 1 END AND isodow(d.day) < 6 AND d.day::DATE::VARCHAR NOT IN {_HOLIDAYS} GROUP BY event_id""", MOVED)
def q39_overnight_window(spark, sf):
    return _moved(spark, sf).select("event_id", dates.overnight_start(F.col("ts")).alias("start")).select("event_id", _stamp("start"))


@query(f"SELECT event_id, CASE WHEN hour(ny) BETWEEN 9 AND 15 AND isodow(ny) < 6 AND ny::DATE::VARCHAR NOT IN {_HOLIDAYS} THEN 'INTRADAY' ELSE 'OVERNIGHT' END AS session FROM wall", MOVED)
def q40_session_label(spark, sf):
    return _moved(spark, sf).select("event_id", F.when(dates.is_intraday(F.col("ts")), "INTRADAY").otherwise("OVERNIGHT").alias("session"))


@query("SELECT id, year(filed_date)::INT AS fiscal_year, CASE form_type WHEN '10-K' THEN 'FY' ELSE 'Q' || quarter(filed_date) END AS period, form_type || ' · ' || CASE form_type WHEN '10-K' THEN '' ELSE 'Q' || quarter(filed_date) || ' ' END || year(filed_date) AS title FROM filings", FILINGS)
def q41_fiscal_period(spark, sf):
    out = filings(spark, sf).withColumn("fiscal_year", dates.fiscal_year(F.col("filed_date"))).withColumn("period", dates.fiscal_period(F.col("filed_date"), F.col("form_type")))
    return out.select("id", "fiscal_year", "period", finance.filing_title(F.col("form_type"), F.col("filed_date"), F.col("fiscal_year"), F.col("period")).alias("title"))


@query("SELECT user_id, strftime(max(ts) FILTER (event_type <> 'error'), '%Y-%m-%d %H:%M') AS latest FROM events GROUP BY 1")
def q42_evidence_latest(spark, sf):
    entry = F.when(F.col("event_type") == "error", "published_at=not-a-date").otherwise(F.concat(F.lit("published_at="), F.date_format("ts", "yyyy-MM-dd'T'HH:mm"), F.lit("Z")))
    daily = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.collect_set(entry).alias("evidence"))
    return daily.groupBy("user_id").agg(F.date_format(F.max(dates.latest_evidence(F.col("evidence"))), "yyyy-MM-dd HH:mm").alias("latest"))


# Texts


BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"


def cuts_sql(size: int, overlap: int, body: str = f"SELECT doc_id, trim(text, {BLANK}) AS t FROM documents") -> str:
    """Tables body and cuts: one chunk of each text after another, where it begins, and where the last blank line or blank
    before its end cuts it."""
    lo = f"greatest(c.following, c.following + {size - overlap - 200})"
    return f"""body AS ({body}), cuts AS (SELECT doc_id, 0::BIGINT AS n, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS following, false AS done FROM body WHERE length(t) > 0 UNION ALL
  SELECT doc_id, n + 1, a, CASE WHEN last THEN size ELSE e END, CASE WHEN e - {overlap} > a THEN e - {overlap} ELSE e END, last FROM (
    SELECT *, CASE WHEN gap > a THEN gap + 2 WHEN space > a THEN space + 1 ELSE a + {size} END AS e FROM (
      SELECT *, CASE WHEN g > 0 THEN lo + length(w) - g - 1 ELSE -1 END AS gap, CASE WHEN s > 0 THEN a + length(v) - s ELSE -1 END AS space FROM (
        SELECT *, instr(reverse(w), chr(10) || chr(10)) AS g, instr(reverse(v), ' ') AS s FROM (
          SELECT c.doc_id, c.n, c.following AS a, length(t) AS size, c.following + {size} >= length(t) AS last, {lo} AS lo,
            substr(t, {lo} + 1, c.following + {size + 1} - {lo}) AS w, substr(t, c.following + 1, {size + 1}) AS v
          FROM cuts c JOIN body USING (doc_id) WHERE NOT c.done AND c.following < length(t))))))"""


_CUTS = cuts_sql(2400, 288)


@query(f"SELECT doc_id AS id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS chunk_index, NULL::VARCHAR AS section, chunk FROM (SELECT doc_id, n, trim(substr(t, a + 1, b - a), {BLANK}) AS chunk FROM cuts JOIN body USING (doc_id) WHERE n > 0) WHERE chunk <> ''", _CUTS)
def q43_chunk_overlap(spark, sf):
    return chunks.chunked(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


_HEADED = "SELECT doc_id, coalesce(text, '') || chr(10) || 'item 1a Risk' || chr(10) || coalesce(text, '') || chr(10) || ' ITEM 7. ' || repeat('long ', 20) || chr(10) || coalesce(lang, '') || chr(10) || 'Item 9B.' || chr(10) || source AS text FROM documents"
#: Blocks of texts with headings, numbered; the key of a block is that of its text and its number.
_BLOCKS = f"""blocks AS (SELECT doc_id, n, CASE WHEN n > 1 THEN 'Item ' || upper(split_part(p, chr(2), 1)) || CASE WHEN rest = '' THEN '' ELSE '. ' || CASE WHEN length(rest) > 60 THEN substr(rest, 1, 57) || '...' ELSE rest END END END AS section,
    trim(CASE WHEN n > 1 THEN split_part(p, chr(3), 2) ELSE p END, {BLANK}) AS t FROM (
  SELECT *, trim(split_part(split_part(p, chr(2), 2), chr(3), 1), {BLANK}) AS rest FROM (
    SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS n FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n\\s*Item\\s+(\\d+[A-Z]?)\\s*[.\\s]+([^\\n]*)', chr(1) || '\\1' || chr(2) || '\\2' || chr(3), 'gi'), chr(1)) AS ps FROM ({_HEADED})))))"""


@query(f"SELECT x.doc_id AS id, (row_number() OVER (PARTITION BY x.doc_id ORDER BY x.n, k) - 1)::INT AS chunk_index, section, chunk FROM (SELECT doc_id[1] AS doc_id, doc_id[2] AS n, n AS k, trim(substr(t, a + 1, b - a), {BLANK}) AS chunk FROM cuts JOIN body USING (doc_id) WHERE n > 0) x JOIN blocks USING (doc_id, n) WHERE chunk <> ''", _BLOCKS, cuts_sql(2400, 288, "SELECT [doc_id, n] AS doc_id, t FROM blocks"))
def q44_section_blocks(spark, sf):
    d = table(spark, sf, "documents")
    whole = F.coalesce("text", F.lit(""))
    text = F.concat(whole, F.lit("\nitem 1a Risk\n"), whole, F.lit("\n ITEM 7. "), F.repeat(F.lit("long "), F.lit(20)), F.lit("\n"), F.coalesce("lang", F.lit("")), F.lit("\nItem 9B.\n"), F.col("source"))
    return chunks.chunked(d.select(F.col("doc_id").alias("id"), text.alias("text")), by_section=True)


@query()
def q45_html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", chunks.html_text(F.col("html")).alias("text"))


@query("""SELECT doc_id, len(ls) >= 2 AND ((list_min(ps) >= 2 AND list_min(ps) = list_max(ps)) OR len(list_filter(ls, lambda x: contains(x, chr(9)))) >= greatest(len(ls) - 1, 1)) AS is_table
  FROM (SELECT doc_id, ls, list_transform(ls, lambda x: length(x) - length(replace(x, '|', ''))) AS ps FROM (SELECT doc_id, string_split(trim(text), chr(10)) AS ls FROM documents))""")
def q46_looks_like_table(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.looks_like_table(F.col("text")).alias("is_table"))


@query("""SELECT query_id, id, round(score, 6) AS score FROM (SELECT s.query_id, s.id, 0.6::DOUBLE * s.sim + 0.3::DOUBLE * r + 0.1::DOUBLE * (CASE form_type WHEN '10-Q' THEN 0.6::DOUBLE + 0.4::DOUBLE * r WHEN '10-K' THEN 0.5::DOUBLE + 0.3::DOUBLE * r ELSE 0.5::DOUBLE END) AS score
  FROM (SELECT s.*, form_type, coalesce(1 / (1 + greatest(date_diff('day', filed_date, DATE '1999-01-01'), 0) / 365.25::DOUBLE), 0.5) AS r FROM sims s LEFT JOIN filings f ON f.id = s.id) s)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) <= 5""", VECTORS, COSINE, FILINGS)
def q47_filing_hybrid_score(spark, sf):
    rows = vec.with_unit(vectors(spark, sf))
    both = rows.select("id", "u").join(filings(spark, sf).select("id", "form_type", "filed_date"), "id", "left")
    both = both.withColumn("r", F.coalesce(finance.filing_recency(F.col("filed_date"), F.lit("1999-01-01").cast("date")), F.lit(0.5)))
    a, b, c = config.FILING_WEIGHTS
    scored = both.withColumn("bonus", b * F.col("r") + c * finance.filing_priority(F.col("form_type"), F.col("r")))
    return vec.nearest_scored(scored, _queries_of(rows), 5, a).select("query_id", "id", "score")


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE (props->>'k')::BIGINT IN (1, 3, 5)")
def q48_json_filter(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k IN (1, 3, 5)")


# Write rules


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1 UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1")
def q49_insert_ignore(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    existing = o.where("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return tables.insert_ignore(existing, o.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")


@query("SELECT o_custkey, coalesce(max(o_orderkey) FILTER (o_orderkey % 2 = 1), min(o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def q50_upsert(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    existing = o.where("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return tables.upsert(existing, o.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 5")
def q51_evict_oldest(spark, sf):
    return tables.keep_newest(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey", 5).drop("o_orderdate")


@query("SELECT o_orderkey AS id, min(r) AS kept FROM reach GROUP BY 1 HAVING min(r) <> o_orderkey", "p AS (SELECT o_orderkey, o_orderkey // 2 AS kept FROM orders WHERE o_orderkey > 0), reach AS (SELECT o_orderkey, kept AS r FROM p UNION SELECT reach.o_orderkey, p.kept FROM reach JOIN p ON p.o_orderkey = reach.r)")
def q52_canonical_dup_chain(spark, sf):
    o = table(spark, sf, "orders").where("o_orderkey > 0")
    return graph.resolved(o.select(F.col("o_orderkey").alias("id"), F.expr("o_orderkey div 2").alias("kept")))


# Limits and views


#: One ask of each key after another, with the times accepted in the window, the day, and how many were accepted on it.
_ASKS = "asks AS (SELECT user_id % 20 AS ip, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click')"
_RUN = """run AS (SELECT DISTINCT ip, 0::BIGINT AS n, NULL::BIGINT AS event_id, []::BIGINT[] AS recent, -1::BIGINT AS day, 0::BIGINT AS used, '' AS verdict FROM asks UNION ALL
  SELECT ip, n, event_id, CASE WHEN verdict = 'ok' THEN list_append(kept, us) ELSE kept END, d, u + (verdict = 'ok')::BIGINT, verdict FROM (
    SELECT *, CASE WHEN len(kept) >= 4 THEN 'window' WHEN u >= 30 THEN 'daily' ELSE 'ok' END AS verdict FROM (
      SELECT a.ip, a.n, a.event_id, a.us, list_filter(r.recent, lambda x: x > a.us - 3600000000) AS kept, a.us // 86400000000 AS d, CASE WHEN a.us // 86400000000 = r.day THEN r.used ELSE 0 END AS u FROM run r JOIN asks a ON a.ip = r.ip AND a.n = r.n + 1)))"""


@query("SELECT ip, event_id, verdict FROM run WHERE n > 0", _ASKS, _RUN)
def q53_rate_limit(spark, sf):
    asks = table(spark, sf, "events").where("event_type = 'click'").select((F.col("user_id") % 20).alias("ip"), "ts", "event_id")
    return limits.limited(asks, window_s=3600, most=4, daily=30)


@query("SELECT user_id AS ip, ts::DATE::VARCHAR AS day, count(*) AS asks, least(count(*), 3)::BIGINT AS accepted FROM events WHERE event_type = 'click' GROUP BY 1, 2")
def q54_daily_quota(spark, sf):
    asks = table(spark, sf, "events").where("event_type = 'click'").select(F.col("user_id").alias("ip"), "ts")
    return limits.daily_quota(asks).withColumn("day", F.col("day").cast("string"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') THEN 'zh' ELSE 'en' END AS tag FROM documents")
def q55_language_tag(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.language_tag(F.col("text")).alias("tag"))


@query(f"SELECT id, {_any_sql(config.FINANCE_WORDS, 'lower(title)')} AS financial FROM articles", ARTICLES)
def q56_finance_title(spark, sf):
    return articles(spark, sf).select("id", text.has_any(F.lower("title"), config.FINANCE_WORDS).alias("financial"))


@query("SELECT id, source, coalesce(priority, 999)::INT AS priority FROM (SELECT * FROM articles QUALIFY row_number() OVER (PARTITION BY source ORDER BY published_at DESC, id) <= 15) LEFT JOIN (VALUES ('src1', 1), ('src2', 2), ('src3', 2)) p(s, priority) ON s = source", ARTICLES)
def q57_source_union_priority(spark, sf):
    priority = spark.createDataFrame([("src1", 1), ("src2", 2), ("src3", 2)], "source string, priority int")
    return market.sources_merged(articles(spark, sf), priority, 15).select("id", "source", "priority")


@query("""SELECT n, buys, sells, volatile, sells > n / 2 AS mostly_sell, volatile > 2 AS high_volatility FROM
  (SELECT count(*) AS n, count(*) FILTER (direction = 'buy') AS buys, count(*) FILTER (direction = 'sell') AS sells FROM directions), (SELECT count(*) FILTER (volatility > 3) AS volatile FROM technical)""", TICKS, DAILY, TECHNICAL, ARTICLES, LOW, NEWS, DIRECTIONS)
def q58_briefing_summary(spark, sf):
    return market.briefing(*_directions(spark, sf))


@query("SELECT conv_id, turn FROM pack WHERE fits", "turns AS (SELECT conv_id, turn, coalesce(length(text), 0) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)",
       """pack AS (SELECT DISTINCT conv_id, NULL::BIGINT AS turn, 0::BIGINT AS n, 0::BIGINT AS used, false AS fits FROM turns UNION ALL
  SELECT t.conv_id, t.turn, t.n, p.used + CASE WHEN p.used + t.size <= 1000 THEN t.size ELSE 0 END, p.used + t.size <= 1000 FROM pack p JOIN turns t ON t.conv_id = p.conv_id AND t.n = p.n + 1)""")  # fmt: skip
def q59_context_packing(spark, sf):
    return chunks.packed(table(spark, sf, "conversations"), "conv_id", "turn", "text", 1000).drop("text")


@query("SELECT DISTINCT doc_id, w AS ticker FROM (SELECT doc_id, upper(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS w FROM documents) WHERE w IN (SELECT upper(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) FROM benchmark) AND length(w) BETWEEN 2 AND 5")
def q60_ticker_extract(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("w"))
    known = words.select(F.upper("w").alias("ticker")).where("length(ticker) BETWEEN 2 AND 5").distinct()
    return stories.tickers_of(table(spark, sf, "documents").select("doc_id", "text"), known)




# Stories, briefs, lists and jobs


@query("SELECT c_custkey AS id, count(o_orderkey) AS articles, max(o_orderdate)::DATE::VARCHAR AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def q61_stories_with_links(spark, sf):
    orders = table(spark, sf, "orders")
    links = orders.select(F.col("o_custkey").alias("story_id"), F.col("o_orderkey").alias("article_id"))
    dated = orders.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("published_at"))
    return stories.with_links(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), links, dated).withColumn("latest", F.col("latest").cast("string"))


@query("SELECT o_custkey AS story_id FROM orders GROUP BY 1 HAVING count(*) >= 4 AND count(DISTINCT strftime(o_orderdate, '%Y-%m')) >= 3")
def q62_month_gate(spark, sf):
    return stories.spread_enough(table(spark, sf, "orders").select(F.col("o_custkey").alias("story_id"), "o_orderdate"), "o_orderdate", 4, 3)


@query("SELECT event_id // 8 AS id FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(DISTINCT isoyear(ts) * 100 + week(ts)) <= 1")
def q63_one_week_stories(spark, sf):
    links = table(spark, sf, "events").where("event_type = 'purchase'").select(F.floor(F.col("event_id") / 8).alias("story_id"), "ts")
    return stories.within_one_week(links.select(F.col("story_id").alias("id")).distinct(), links, "ts")


@query("SELECT o_orderkey FROM (SELECT *, strftime(o_orderdate, '%Y-%m') AS month FROM orders QUALIFY row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_totalprice DESC, o_orderkey) = 1) ORDER BY month LIMIT 24")
def q64_best_per_month(spark, sf):
    return stories.best_per_month(table(spark, sf, "orders"), "o_orderdate", F.col("o_totalprice"), "o_orderkey", 24).select("o_orderkey")


@query("SELECT id FROM lows WHERE relevance >= 50 QUALIFY row_number() OVER (PARTITION BY topic ORDER BY relevance DESC, id) <= 20", ARTICLES, LOW.replace("lows AS", "lows0 AS"), f"lows AS (SELECT *, {_argmax_sql(_TOPIC_SQL, 'FX')} AS topic, greatest({', '.join(_TOPIC_SQL.values())}) AS relevance FROM lows0)")
def q65_raw_items_by_topic(spark, sf):
    routed = finance.with_topic(articles(spark, sf), _low()).where("relevance_score >= 50")
    return tables.top_per(routed, ["topic"], [F.col("relevance_score").desc(), F.col("id")], 20).select("id")


@query("SELECT n_nationkey AS ord, n_name AS symbol, coalesce(max(c_acctbal), 0) AS price FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY 1, 2")
def q66_requested_prices(spark, sf):
    nation = table(spark, sf, "nation")
    named = table(spark, sf, "customer").where("c_acctbal > 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    prices = named.groupBy(F.col("n_name").alias("symbol")).agg(F.max("c_acctbal").alias("price"))
    return stories.requested(nation.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("symbol")), prices).select("ord", "symbol", "price")


@query("SELECT p_partkey::VARCHAR AS ticker, p_name AS name FROM part WHERE starts_with(p_partkey::VARCHAR, '11') OR contains(lower(p_name), '11') ORDER BY ticker LIMIT 5")
def q67_typeahead(spark, sf):
    return stories.typeahead(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("ticker"), F.col("p_name").alias("name")), " 11 ")


@query("""SELECT id, value FROM (SELECT i.event_id AS id, p.value, row_number() OVER (PARTITION BY i.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(i.ts)), p.ts, p.event_id DESC) AS n
  FROM events i JOIN events p ON p.user_id = i.user_id AND p.event_type = 'purchase' WHERE i.event_type = 'view') WHERE n = 1""")
def q68_nearest_point(spark, sf):
    e = table(spark, sf, "events")
    points = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    items = e.where("event_type = 'view'").select(F.col("event_id").alias("id"), "user_id", "ts")
    return stories.nearest(items, points, "user_id", "ts", "value").where("value IS NOT NULL").select("id", "value")


@query("SELECT id FROM articles LEFT JOIN (VALUES ('src1', 1), ('src2', 2)) p(s, priority) ON s = source QUALIFY row_number() OVER (PARTITION BY language, md5(summary) ORDER BY coalesce(priority, 999), ord) = 1", ARTICLES)
def q69_cross_source(spark, sf):
    priority = spark.createDataFrame([("src1", 1), ("src2", 2)], "source string, priority int")
    return stories.cross_source(articles(spark, sf).withColumn("m", F.md5("summary")), priority, ["language", "m"]).select("id")


@query("SELECT topic, count(*) AS items, ('0x' || substr(md5('brief_2024-02-01_' || topic), 1, 14))::BIGINT AS id FROM (SELECT * FROM lows WHERE relevance >= 50 QUALIFY row_number() OVER (PARTITION BY topic ORDER BY relevance DESC, id) <= 20) GROUP BY 1", ARTICLES, LOW.replace("lows AS", "lows0 AS"), f"lows AS (SELECT *, {_argmax_sql(_TOPIC_SQL, 'FX')} AS topic, greatest({', '.join(_TOPIC_SQL.values())}) AS relevance FROM lows0)")
def q70_macro_digest(spark, sf):
    return jobs.macro_digest(articles(spark, sf), F.lit("2024-02-01").cast("date")).select("id", "topic", "items")


@query("SELECT ticker, round(stddev_samp(r) * sqrt(252), 4) AS volatility FROM (SELECT ticker, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY day), 0) - 1 AS r FROM daily) GROUP BY 1", TICKS, DAILY)
def q71_yearly_volatility(spark, sf):
    return market.volatility(market.bars(ticks(spark, sf), "1 day")).select("ticker", F.round("volatility", 4).alias("volatility"))


@query("SELECT id, level FROM (SELECT id, CASE WHEN contains(low, 'gold') THEN 'high' WHEN contains(low, 'rate') THEN 'medium' ELSE 'low' END AS level, published_at, ord FROM lows) ORDER BY CASE level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, published_at DESC, ord LIMIT 100", ARTICLES, LOW)
def q72_sort_by_impact(spark, sf):
    level = finance.impact_of_news(_low(), ("gold",), ("rate",))
    rows = articles(spark, sf).withColumn("level", level)
    return rows.orderBy(finance.impact_rank(F.col("level")), F.col("published_at").desc(), "ord").limit(100).select("id", "level")


def _story_inputs(spark, sf):
    from tidemark.inputs import vectors as vector_rows

    v = vector_rows(spark, sf).select("id", "v")
    return articles(spark, sf).join(v, "id", "left"), filings(spark, sf).withColumn("filed_date", F.date_add("filed_date", 365 * 20))


@query()
def q73_overnight_stories(spark, sf):
    rows, filed = _story_inputs(spark, sf)
    return jobs.overnight_stories(rows, filed, F.lit("2024-02-01").cast("date"), T_ASSIGN, T_GRAPH)[0].withColumn("as_of", F.col("as_of").cast("string")).withColumn("filing_filed_date", F.col("filing_filed_date").cast("string"))


@query()
def q74_story_links(spark, sf):
    rows, filed = _story_inputs(spark, sf)
    return jobs.overnight_stories(rows, filed, F.lit("2024-02-01").cast("date"), T_ASSIGN, T_GRAPH)[1]


@query()
def q75_answers(spark, sf):
    rows = vec.with_unit(articles(spark, sf).join(vectors(spark, sf).select("id", "v"), "id"))
    return jobs.answers(rows.where("id % 50 = 0").withColumn("text", F.col("title")), rows)


@query("SELECT ticker, sum((CASE WHEN form_type = '10-K' AND id % 5 = 0 THEN 0.2 WHEN form_type = '10-K' THEN -0.1 ELSE 0 END)::DOUBLE) AS s FROM filings GROUP BY 1".replace("sum(", "round(greatest(least(sum(").replace("::DOUBLE) AS s", "::DOUBLE), 1), -1), 4) AS signal"), FILINGS)
def q76_filing_signal(spark, sf):
    f = filings(spark, sf).select("ticker", F.when(F.col("form_type") == "10-K", "high").otherwise("low").alias("impact"), F.when(F.col("id") % 5 == 0, "an Acquisition").alias("description"))
    return market.filing_signal(f).select("ticker", F.round("signal", 4).alias("signal"))


@query("SELECT DISTINCT upper(trim(c_mktsegment)) AS symbol FROM customer")
def q77_watchlist(spark, sf):
    return stories.symbols(table(spark, sf, "customer").select(F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("symbol")))
