"""Queries of search over fields and vectors with filters, of requests to sources, and of the day's news."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import ids, text
from tidemark.inputs import ARTICLES, VECTORS, articles, table, vectors
from tidemark.operators import chunks, search, stories, tables
from tidemark.operators import vectors as vec
from tidemark.plans.base import query
from tidemark.plans.registry import BLANK, cuts_sql
from tidemark.sources import feeds, news


@query("SELECT 'http://feed/' || s.ticker || '/rss' AS url, s.ticker, f.source FROM (SELECT DISTINCT ticker FROM articles) s, (SELECT DISTINCT source FROM articles WHERE source IN ('src1', 'src2')) f", ARTICLES)
def q181_feed_requests(spark, sf):
    rows = articles(spark, sf)
    known = rows.where("source IN ('src1', 'src2')").select("source").distinct().withColumn("url", F.lit("http://feed/{symbol}/rss"))
    return feeds.requests(known, rows.select("ticker").distinct())


@query("SELECT t.ticker, b.start::DATE::VARCHAR AS start, least(b.start::DATE + 14, DATE '2024-02-10')::VARCHAR AS until FROM (SELECT DISTINCT ticker FROM articles) t, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-10', INTERVAL 15 DAY) b(start)", ARTICLES)
def q182_load_buckets(spark, sf):
    spans = feeds.buckets(F.lit("2024-01-01").cast("date"), F.lit("2024-02-10").cast("date"), 15)
    out = articles(spark, sf).select("ticker").distinct().select("ticker", F.explode(spans).alias("b"))
    return out.select("ticker", F.col("b.start").cast("date").cast("string").alias("start"), F.col("b.end").cast("date").cast("string").alias("until"))


@query("""SELECT id FROM articles WHERE trim(title) <> '' AND published_at BETWEEN TIMESTAMP '2024-01-14' AND TIMESTAMP '2024-01-15' AND (contains(lower(title || ' ' || summary), 'rate') OR contains(lower(title || ' ' || summary), 'the'))
  AND lower(trim(title)) NOT IN (SELECT lower(trim(title)) FROM articles WHERE id % 5 = 0 AND published_at::DATE BETWEEN DATE '2024-01-14' AND DATE '2024-01-15') QUALIFY row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY id) = 1""", ARTICLES)
def q183_todays_news(spark, sf):
    rows = articles(spark, sf)
    existing = rows.where("id % 5 = 0").where("to_date(published_at) BETWEEN DATE'2024-01-14' AND DATE'2024-01-15'")
    return news.todays(rows, existing, F.expr("TIMESTAMP_NTZ'2024-01-15 00:00:00'"), ["rate", "the"]).select("id")


def _field(name: str, column: str) -> str:
    return f"""{name}_tok AS (SELECT id, list_filter(regexp_split_to_array(lower({column}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ws FROM articles),
  {name}_stats AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM {name}_tok),
  {name}_tf AS (SELECT id, dl, w, count(*) AS tf FROM (SELECT id, len(ws) AS dl, unnest(ws) AS w FROM {name}_tok) WHERE w IN (SELECT w FROM qw) GROUP BY ALL),
  {name}_df AS (SELECT w, count(*) AS df FROM {name}_tf GROUP BY w),
  {name} AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75 * dl / avgdl))) AS score FROM {name}_tf JOIN {name}_df USING (w) JOIN qw USING (w), {name}_stats GROUP BY 1, 2)"""


QW = "qw AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w FROM benchmark)"


@query("""SELECT query_id, id, round(score, 4) AS score FROM (SELECT query_id, id, ticker, published_at, greatest(2 * coalesce(t.score, 0), coalesce(s.score, 0)) AS score FROM field_t t FULL JOIN field_s s USING (query_id, id) JOIN articles USING (id)
    WHERE collector <> 'gemini' AND published_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28' QUALIFY row_number() OVER (PARTITION BY query_id, ticker, published_at::DATE ORDER BY round(greatest(2 * coalesce(t.score, 0), coalesce(s.score, 0)), 4) DESC, id) <= 2)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, id) <= 10""", ARTICLES, QW, _field("field_t", "title"), _field("field_s", "summary"))
def q184_search_of_fields(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    rows = articles(spark, sf)
    scored = search.best_field(rows, asked, {"title": 2.0, "summary": 1.0}).withColumn("score", F.round("score", 4))
    dated = scored.join(rows.where("collector <> 'gemini' AND published_at BETWEEN TIMESTAMP_NTZ'2024-01-03 00:00:00' AND TIMESTAMP_NTZ'2024-01-28 00:00:00'").select("id", "ticker", F.to_date("published_at").alias("day")), "id")
    best = [F.col("score").desc(), F.col("id")]
    return tables.top_per(tables.top_per(dated, ["query_id", "ticker", "day"], best, 2), ["query_id"], best, 10).select("query_id", "id", "score")


COS = """unitv AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM vec),
  sims AS (SELECT q.id AS query_id, r.id, q.ticker AS query_ticker, r.ticker, r.published_at, round(list_dot_product(q.u, r.u), 5) AS sim FROM unitv q JOIN unitv r ON q.id <> r.id WHERE q.id % 50 = 0)"""


@query("SELECT query_id, id, sim FROM sims WHERE ticker = query_ticker QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) = 1 AND sim >= 0.22::DOUBLE", VECTORS, COS)
def q185_similar_long_story(spark, sf):
    rows = vec.with_unit(vectors(spark, sf))
    top = vec.retrieve(rows, vec.as_queries(rows.where("id % 50 = 0"), "ticker"), 1, 1)
    return top.where("sim >= 0.22").select("query_id", "id", "sim")


@query("SELECT query_id, id, sim FROM sims WHERE id % 9 <> 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) <= 8", VECTORS, COS)
def q186_chunks_of_dimension(spark, sf):
    v = vectors(spark, sf).withColumn("v", F.when(F.col("id") % 9 == 0, F.slice("v", 1, 10)).otherwise(F.col("v")))
    asked = vec.as_queries(vec.with_unit(vectors(spark, sf)).where("id % 50 = 0"))
    return vec.nearest(vec.of_dimension(vec.with_unit(v), 64), asked, 8).select("query_id", "id", "sim")


@query("""SELECT query_id, id, sim FROM (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY published_at DESC, id) AS recent FROM sims s WHERE ticker = query_ticker) WHERE recent <= 15 AND id % 25 <> 0 QUALIFY row_number() OVER (PARTITION BY query_id, published_at::DATE ORDER BY sim DESC, id) <= 2)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) <= 5""", VECTORS, COS)
def q187_retrieve_recent(spark, sf):
    rows = vec.with_unit(vectors(spark, sf))
    return vec.retrieve_recent(rows, vec.as_queries(rows.where("id % 50 = 0"), "ticker"), 5, 2, ~F.col("anchor")).select("query_id", "id", "sim")


@query("SELECT id, least(CASE WHEN contains(low, lower(ticker)) OR true THEN 0.4::DOUBLE ELSE 0 END + least((contains(low, 'rate')::INT + contains(low, 'fed')::INT + contains(low, 'the')::INT) * 0.1::DOUBLE, 0.4::DOUBLE), 1) >= 0.5::DOUBLE AS relevant FROM (SELECT *, lower(title || ' ' || summary) AS low FROM articles)", ARTICLES)
def q188_relevance_without_model(spark, sf):
    return news.relevant(articles(spark, sf), ["rate", "fed", "the"], least=0.5).select("id", "relevant")


@query("SELECT item_id, coalesce(string_agg(DISTINCT w, ',' ORDER BY w), '') AS tickers, count(w) = 0 AS macro FROM (SELECT item_id, NULL AS w FROM benchmark UNION ALL SELECT item_id, upper(w) FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS w FROM benchmark) WHERE length(w) = 2) GROUP BY 1")
def q189_tickers_of_question(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    known = asked.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("w")).where("length(w) = 2").select(F.upper("w").alias("ticker")).distinct()
    out = stories.question_tickers(asked, known)
    return out.select(F.col("doc_id").alias("item_id"), F.array_join("tickers", ",").alias("tickers"), "macro")


@query(f"SELECT doc_id, count(*) AS chunks, sum(length(chunk))::BIGINT AS characters, bit_xor(('0x' || substr(md5(n || ':' || chunk), 1, 14))::BIGINT) AS contents FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS n, chunk FROM (SELECT doc_id, n, trim(substr(t, a + 1, b - a), {BLANK}) AS chunk FROM cuts JOIN body USING (doc_id) WHERE n > 0) WHERE chunk <> '') GROUP BY 1", cuts_sql(4000, 600))
def q190_ingested_books(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    made = chunks.chunked(d, 4000, 600)
    content = ids.bigint_id(F.concat_ws(":", F.col("chunk_index").cast("string"), "chunk"))
    return made.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("characters"), F.bit_xor(content).alias("contents"))


@query("SELECT id, contains(low, 'rate') AS relevant, length(low) > 0 AS has_text FROM (SELECT *, lower(title || ' ' || summary) AS low FROM articles) WHERE ticker = 'T6'", ARTICLES)
def q191_item_of_ticker(spark, sf):
    low = text.both(F.col("title"), F.col("summary"))
    return tables.of_symbols(articles(spark, sf), "ticker", ["t6"]).select("id", low.contains("rate").alias("relevant"), (F.length(low) > 0).alias("has_text"))
