"""Logical inputs (articles, filings, bars, ...) derived from the supplied tables, and the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ticker, published_at, title, summary, source, language, collector, ord."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("T"), F.col("doc_id") % 10).alias("ticker"),
        F.expr("timestampadd(HOUR, CAST(doc_id % 720 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("published_at"),
        F.substring(F.substring_index("text", "\n", 1), 1, 120).alias("title"),
        F.col("text").alias("summary"),
        "source",
        F.col("lang").alias("language"),
        F.when(F.col("doc_id") % 25 == 0, "gemini").otherwise("feed").alias("collector"),
        F.col("doc_id").alias("ord"),
    )


ARTICLES = """articles AS (SELECT doc_id AS id, 'T' || (doc_id % 10) AS ticker, TIMESTAMP '2024-01-01' + to_hours((doc_id % 720)::INT) AS published_at,
  substr(split_part(text, chr(10), 1), 1, 120) AS title, text AS summary, source, lang AS language,
  CASE WHEN doc_id % 25 = 0 THEN 'gemini' ELSE 'feed' END AS collector, doc_id AS ord FROM documents)"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ticker, form_type, filed_date, accession."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("T"), F.col("o_custkey") % 10).alias("ticker"),
        F.when(F.col("o_orderpriority").startswith("1"), "10-K").otherwise("10-Q").alias("form_type"),
        F.to_date("o_orderdate").alias("filed_date"),
        F.col("o_orderkey").cast("string").alias("accession"),
    )


FILINGS = """filings AS (SELECT o_orderkey AS id, 'T' || (o_custkey % 10) AS ticker, CASE WHEN o_orderpriority LIKE '1%' THEN '10-K' ELSE '10-Q' END AS form_type,
  o_orderdate::DATE AS filed_date, o_orderkey::VARCHAR AS accession FROM orders)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ticker, published_at, anchor, v (array of double)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("T"), F.col("label")).alias("ticker"),
        F.expr("timestampadd(HOUR, CAST(vec_id % 720 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("published_at"),
        (F.col("vec_id") % 25 == 0).alias("anchor"),
        F.col("embedding").cast("array<double>").alias("v"),
    )


VECTORS = """vec AS (SELECT vec_id AS id, 'T' || label AS ticker, TIMESTAMP '2024-01-01' + to_hours((vec_id % 720)::INT) AS published_at, vec_id % 25 = 0 AS anchor, embedding::DOUBLE[] AS v FROM embeddings)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, ts, price, event_id."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("T"), F.col("user_id") % 10).alias("ticker"), "ts", F.col("value").alias("price"), "event_id")


TICKS = "ticks AS (SELECT 'T' || (user_id % 10) AS ticker, ts, value AS price, event_id FROM events)"
#: Daily bars over `ticks`.
DAILY = """daily AS (SELECT ticker, date_trunc('day', ts) AS day, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (ts, event_id)) AS close, count(*) AS volume FROM ticks GROUP BY ticker, day)"""


def macro_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """articles with related_tickers, topics (topic, relevance_score as text), primary_topic."""
    topics = F.expr("""filter(array(
      named_struct('topic', 'economy_macro', 'relevance_score', CAST(id % 101 / 100.0D AS STRING)),
      named_struct('topic', 'financial_markets', 'relevance_score', CAST(id % 53 / 52.0D AS STRING)),
      named_struct('topic', 'technology', 'relevance_score', CASE WHEN id % 6 = 0 THEN 'n/a' ELSE CAST(id % 7 / 7.0D AS STRING) END)), t -> id % 9 <> 0 OR t.topic = 'technology')""")
    out = articles(spark, sf_dir).withColumn("related_tickers", F.expr("array(' t' || id % 10, 'T' || id % 7, '', 'T' || id % 10)"))
    return out.withColumn("topics", topics)


MACRO = """macro AS (SELECT *, [' t' || (id % 10), 'T' || (id % 7), '', 'T' || (id % 10)] AS related_tickers,
  list_filter([{'topic': 'economy_macro', 'score': ((id % 101) / 100::DOUBLE)}, {'topic': 'financial_markets', 'score': ((id % 53) / 52::DOUBLE)},
    {'topic': 'technology', 'score': CASE WHEN id % 6 = 0 THEN NULL ELSE (id % 7) / 7::DOUBLE END}], lambda t: id % 9 <> 0 OR t.topic = 'technology') AS topics FROM articles)"""

#: Event types stand for the tables of briefs; a purchase brief has one of three topics.
ASSETS = {"signup": "FX", "purchase": "Policy", "view": "RATE", "click": "CREDIT", "error": "COMMODITY"}


def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """as_of_date, asset, topic, title, summary, revision: several revisions of the briefs of each day."""
    e = table(spark, sf_dir, "events")
    asset = F.element_at(F.create_map(*(F.lit(x) for kv in ASSETS.items() for x in kv)), F.col("event_type"))
    named = e.select(F.to_date("ts").alias("as_of_date"), asset.alias("asset"), F.col("event_id").alias("revision"), F.col("user_id"), "value")
    topic = F.when(F.col("asset") == "Policy", F.element_at(F.array(F.lit("Fiscal Policy"), F.lit("Monetary Policy"), F.lit("Trump")), (F.col("user_id") % 3 + 1).cast("int"))).otherwise(F.col("asset"))
    return named.select("as_of_date", "asset", topic.alias("topic"), F.concat(topic, F.lit(" at "), F.col("revision")).alias("title"), F.concat(F.lit("user "), F.col("user_id")).alias("summary"), "revision")


BRIEFS = """brief_rows AS (SELECT ts::DATE AS as_of_date, CASE event_type WHEN 'signup' THEN 'FX' WHEN 'purchase' THEN 'Policy' WHEN 'view' THEN 'RATE' WHEN 'click' THEN 'CREDIT' ELSE 'COMMODITY' END AS asset,
    CASE event_type WHEN 'signup' THEN 'FX' WHEN 'purchase' THEN ['Fiscal Policy', 'Monetary Policy', 'Trump'][(user_id % 3)::INT + 1] WHEN 'view' THEN 'RATE' WHEN 'click' THEN 'CREDIT' ELSE 'COMMODITY' END AS topic,
    event_id AS revision, 'user ' || user_id AS summary FROM events),
  brief AS (SELECT *, topic || ' at ' || revision AS title FROM brief_rows QUALIFY row_number() OVER (PARTITION BY as_of_date, asset, topic ORDER BY revision DESC) = 1)"""


def story_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ticker, title, asof_date, session_label, evidence, direction_bias, expected_abs_move_pct, risk_confidence from orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("T"), F.col("o_custkey") % 10).alias("ticker"), F.concat(F.lit("story "), F.col("o_orderkey")).alias("title"), F.to_date("o_orderdate").alias("asof_date"),
        F.element_at(F.array(F.lit("OVERNIGHT"), F.lit("INTRADAY"), F.lit("MIXED"), F.lit("UNKNOWN")), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("session_label"),
        F.array(F.concat(F.lit("published_at="), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:30:00Z")), F.lit("published_at=soon"), F.concat(F.lit("published_at="), F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd"), F.lit("T08:00:00Z"))).alias("evidence"),
        F.element_at(F.array(F.lit("UP"), F.lit("DOWN"), F.lit("MIXED")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("direction_bias"),
        F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 50 / 10.0).alias("expected_abs_move_pct"), (F.col("o_orderkey") % 7 / 7.0).alias("risk_confidence"),
    )


STORIES = """stories AS (SELECT o_orderkey AS id, 'T' || (o_custkey % 10) AS ticker, 'story ' || o_orderkey AS title, o_orderdate::DATE AS asof_date, ['OVERNIGHT', 'INTRADAY', 'MIXED', 'UNKNOWN'][(o_orderkey % 4)::INT + 1] AS session_label,
  o_orderdate::DATE::TIMESTAMP + INTERVAL 32 HOUR AS event_time, ['UP', 'DOWN', 'MIXED'][(o_custkey % 3)::INT + 1] AS direction_bias, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 50) / 10::DOUBLE END AS expected_abs_move_pct, (o_orderkey % 7) / 7::DOUBLE AS risk_confidence FROM orders)"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, title, author, source_uri from parts."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.concat(F.lit("file:"), F.col("p_partkey")).alias("source_uri"))


def book_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, book_id, chunk_index, text, page_start, embedded from order lines."""
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").withColumn("chunk_index", F.row_number().over(w) - 1)
    return rows.select(F.concat_ws("_", F.lit("file:").cast("string"), "l_partkey", "chunk_index").alias("key"), F.col("l_partkey").alias("book_id"), "chunk_index", F.concat_ws(" ", F.lit("line"), "l_orderkey", "l_linenumber").alias("text"), (F.col("chunk_index") * 2).alias("page_start"), (F.col("l_returnflag") != "N").alias("embedded"))


CHUNKS = """book_chunk AS (SELECT *, 'file:_' || book_id || '_' || chunk_index AS key, chunk_index * 2 AS page_start FROM (SELECT l_partkey AS book_id, (row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) - 1)::INT AS chunk_index,
  'line ' || l_orderkey || ' ' || l_linenumber AS text, l_returnflag <> 'N' AS embedded FROM lineitem))"""


def article_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """story_id, article_id, role of articles dealt to 97 stories."""
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % 97).alias("story_id"), F.col("doc_id").alias("article_id"), F.when(F.col("doc_id") < 97, "PRIMARY").otherwise("SUPPORTING").alias("role"))
