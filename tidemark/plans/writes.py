"""Queries of writes: each writes rows into a new table in the shared folder, twice where that must not matter, and reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, finance, ids
from tidemark.inputs import ARTICLES, BRIEFS, CHUNKS, FILINGS, MACRO, TICKS, article_links, articles, book_chunks, books, briefs, filings, macro_articles, table, ticks
from tidemark.operators import market, stories, tables
from tidemark.plans.base import query
from tidemark.providers import letter_embedding
from tidemark.storage import TABLES, delete, load, save, scratch, truncate


#: The vector of `letter_embedding` of x, with six digits.
VECTOR_OF = "list_transform(l, lambda c: round(c / greatest(sqrt(list_dot_product(l, l)), 1), 6)) AS v FROM (SELECT *, list_transform(['e', 't', 'a', 'o', 'i', 'n', 's', 'r'], lambda c: (length(x) - length(replace(x, c, '')))::DOUBLE) AS l FROM (SELECT *, lower(coalesce({}, '')) AS x FROM {}))"


def _rounded(vector: str):
    return F.transform(vector, lambda x: F.round(x, 6)).alias("v")


def _saved(name: str, *batches: DataFrame) -> tuple[DataFrame, str]:
    """The table after the batches, one after another."""
    spark = batches[0].sparkSession
    path = scratch(spark, name)
    for rows in batches:
        save(rows, path, TABLES[name])
    return load(spark, path), path


def _news(spark, sf):
    rows = articles(spark, sf).select("id", F.concat(F.lit("T"), F.col("id") % 3).alias("ticker"), "published_at", "title", F.when(F.col("id") % 4 > 0, F.concat(F.lit("u"), F.col("id") % 200)).alias("url"))
    return rows.withColumn("article_key", stories.article_key(F.col("url"), F.col("published_at"), F.col("title"))).withColumn("url", F.coalesce("url", F.lit("")))


_NEWS = "rows AS (SELECT id, 'T' || (id % 3) AS ticker, CASE WHEN id % 4 > 0 THEN 'u' || (id % 200) ELSE strftime(published_at, '%Y-%m-%d %H:%M:%S') || '|' || title END AS key, id % 2 AS batch FROM articles)"


@query("SELECT ticker, arg_min(id, (batch, id)) AS id FROM rows GROUP BY ticker, key", ARTICLES, _NEWS)
def q107_save_articles(spark, sf):
    rows = _news(spark, sf)
    return _saved("news_articles", rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), rows.where("id % 2 = 1"))[0].select("ticker", "id")


@query("""SELECT id, coalesce(t.topic, '') AS primary_topic, array_to_string(list_distinct_ordered, ',') AS tickers FROM (SELECT id, list_reverse_sort(list_transform(list_filter(topics, lambda t: t.score IS NOT NULL), lambda t: {'score': t.score, 'o': CASE t.topic WHEN 'economy_macro' THEN 3 WHEN 'financial_markets' THEN 2 ELSE 1 END, 'topic': t.topic}))[1] AS t,
  CASE WHEN id % 10 = id % 7 THEN ['T' || (id % 10)] ELSE ['T' || (id % 10), 'T' || (id % 7)] END AS list_distinct_ordered FROM macro)""", ARTICLES, MACRO)
def q108_save_macro_articles(spark, sf):
    rows = macro_articles(spark, sf).select("id", "published_at", finance.primary_topic(F.col("topics"))["topic"].alias("primary_topic"), stories.clean_tickers(F.col("related_tickers")).alias("related_tickers"))
    out = _saved("macro_articles", rows, rows)[0]
    return out.select("id", F.coalesce("primary_topic", F.lit("")).alias("primary_topic"), F.array_join("related_tickers", ",").alias("tickers"))


@query("SELECT id % 300 AS id, arg_max(id, (coalesce(s, 0), id)) AS source_id FROM (SELECT id, id % 97 AS s FROM articles WHERE id % 2 = 1) GROUP BY 1 UNION ALL SELECT id % 300, arg_max(id, (id % 97, id)) FROM articles WHERE id % 300 NOT IN (SELECT id % 300 FROM articles WHERE id % 2 = 1) GROUP BY 1", ARTICLES)
def q109_save_raw_items(spark, sf):
    rows = articles(spark, sf).select((F.col("id") % 300).alias("id"), F.struct(F.col("id") % 97, "id").alias("relevance_score"), F.col("id").alias("source_id"))
    return _saved("macro_raw_items", rows.where("source_id % 2 = 0"), rows.where("source_id % 2 = 1"))[0].select("id", "source_id")


@query("SELECT ticker, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS timestamp, arg_max(price, (ts, event_id)) AS close, count(*) AS volume FROM ticks GROUP BY 1, 2", TICKS)
def q110_save_prices(spark, sf):
    text = market.bars(ticks(spark, sf)).select("ticker", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("close").cast("string").alias("close"), F.col("volume").cast("string").alias("volume"))
    typed = text.select("ticker", "timestamp", F.col("close").try_cast("double").alias("close"), F.col("volume").try_cast("long").alias("volume"))
    return _saved("stock_prices_5min", typed.withColumn("close", F.lit(0.0)), typed)[0].select("ticker", "timestamp", "close", "volume")


@query("SELECT n_name AS ticker, CASE WHEN n_regionkey = 1 THEN 'second ' ELSE 'first ' END || n_nationkey AS name FROM nation")
def q111_save_stocks(spark, sf):
    rows = table(spark, sf, "nation")
    named = lambda x, df: df.select(F.col("n_name").alias("ticker"), F.concat(F.lit(x), F.col("n_nationkey")).alias("name"))
    return _saved("stocks", named("first ", rows), named("second ", rows.where("n_regionkey = 1")))[0]


@query("SELECT ticker, accession AS accession_number, year(filed_date)::INT AS fiscal_year, CASE form_type WHEN '10-K' THEN 'FY' ELSE 'Q' || quarter(filed_date) END AS period FROM filings", FILINGS)
def q112_upsert_filings(spark, sf):
    f = filings(spark, sf).withColumnRenamed("accession", "accession_number")
    rows = f.withColumn("fiscal_year", dates.fiscal_year(F.col("filed_date"))).withColumn("period", dates.fiscal_period(F.col("filed_date"), F.col("form_type")))
    return _saved("sec_filings", rows.where("id % 3 = 0"), rows)[0].select("ticker", "accession_number", "fiscal_year", "period")


@query("SELECT ('0x' || substr(md5(key), 1, 14))::BIGINT AS id, book_id, chunk_index, text, " + VECTOR_OF.format("text", "book_chunk"), CHUNKS)
def q113_store_chunks(spark, sf):
    rows = book_chunks(spark, sf).withColumn("id", ids.bigint_id(F.col("key"))).withColumn("embedding", letter_embedding(F.col("text")))
    return _saved("sec_filing_chunks", rows, rows.where("chunk_index = 0"))[0].select("id", "book_id", "chunk_index", "text", _rounded("embedding"))


@query("SELECT f.id, year(f.filed_date)::INT AS fiscal_year, l_linenumber AS chunk_index, coalesce(f.form_type, '10-K') AS doc_type FROM lineitem LEFT JOIN filings f ON f.id = l_orderkey", FILINGS)
def q114_backfill_filing_metadata(spark, sf):
    f = filings(spark, sf).withColumn("fiscal_year", F.when(F.col("id") % 2 == 0, F.year("filed_date")))
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("filing_id"), F.col("l_linenumber").alias("chunk_index"))
    filled, typed = stories.with_fiscal_year(f), stories.with_doc_type(chunks, f)
    return typed.join(filled.select(F.col("id"), F.col("id").alias("filing_id"), "fiscal_year"), "filing_id", "left").select("id", "fiscal_year", "chunk_index", "doc_type")


@query("SELECT 'file:' || p_partkey AS source_uri, p_name || CASE WHEN p_partkey % 4 = 0 THEN ' (2)' ELSE '' END AS title FROM part")
def q115_upsert_books(spark, sf):
    rows = books(spark, sf).withColumn("revision", F.lit(1))
    again = rows.where("book_id % 4 = 0").withColumn("title", F.concat("title", F.lit(" (2)"))).withColumn("revision", F.lit(2))
    return _saved("macro_kb_books", rows, again)[0].select("source_uri", "title")


@query("SELECT as_of_date::VARCHAR AS day, asset, topic, title FROM brief", BRIEFS)
def q116_save_briefs(spark, sf):
    rows = briefs(spark, sf)
    first = rows.where("revision % 2 = 0")
    last = rows.groupBy("as_of_date", "asset", "topic").agg(F.max("revision").alias("revision")).join(rows, ["as_of_date", "asset", "topic", "revision"])
    return _saved("macro_briefs", first, last.select(*rows.columns))[0].select(F.col("as_of_date").cast("string").alias("day"), "asset", "topic", "title")


@query("SELECT as_of_date::VARCHAR AS day, string_agg(title, '; ' ORDER BY topic) AS summary FROM brief GROUP BY as_of_date", BRIEFS)
def q117_save_daily_summaries(spark, sf):
    titles = stories.latest_briefs(briefs(spark, sf)).groupBy("as_of_date").agg(F.sort_array(F.collect_list(F.struct("topic", "title"))).alias("t"), F.max("revision").alias("revision"))
    rows = titles.select("as_of_date", F.array_join(F.transform("t", lambda x: x["title"]), "; ").alias("summary"), "revision")
    return _saved("macro_daily_summary", rows.withColumn("summary", F.lit("draft")), rows)[0].select(F.col("as_of_date").cast("string").alias("day"), "summary")


@query("SELECT as_of_date::VARCHAR AS day, p.portfolio_id, count(*) AS briefs, ('0x' || substr(md5('impact_' || as_of_date || '_' || p.portfolio_id), 1, 14))::BIGINT AS id FROM brief, (VALUES ('main'), ('other')) p(portfolio_id) GROUP BY 1, 2, as_of_date", BRIEFS)
def q118_save_impact_reports(spark, sf):
    portfolios = spark.createDataFrame([("main",), ("other",)], "portfolio_id string")
    rows = stories.impact_reports(stories.latest_briefs(briefs(spark, sf)), portfolios)
    return _saved("macro_daily_impact_reports", rows, rows)[0].select(F.col("as_of_date").cast("string").alias("day"), "portfolio_id", "briefs", "id")


@query("SELECT ('0x' || substr(md5(published_at::DATE || '_' || ticker || '_' || (min(id) || '_' || count(*) || '_' || bit_xor(('0x' || substr(md5(id::VARCHAR), 1, 14))::BIGINT))), 1, 14))::BIGINT AS id, ticker, published_at::DATE::VARCHAR AS day, count(*) AS cluster_size FROM articles GROUP BY ticker, published_at::DATE", ARTICLES)
def q119_insert_stories(spark, sf):
    rows = articles(spark, sf).withColumn("asof_date", F.to_date("published_at"))
    made = rows.groupBy("ticker", "asof_date").agg(F.count("*").alias("cluster_size"), ids.members_key(F.col("id")).alias("seed"))
    made = made.withColumn("id", stories.story_id(F.col("asof_date"), F.col("ticker"), F.col("seed"))).drop("seed")
    return _saved("story", made, made)[0].select("id", "ticker", F.col("asof_date").cast("string").alias("day"), "cluster_size")


@query("SELECT doc_id % 97 AS story_id, doc_id AS article_id, CASE WHEN doc_id < 97 THEN 'PRIMARY' ELSE 'SUPPORTING' END AS role FROM documents")
def q120_insert_story_links(spark, sf):
    rows = article_links(spark, sf)
    bad = rows.limit(10).withColumn("role", F.lit("OTHER"))
    return _saved("story_article_link", stories.valid_roles(rows.unionByName(bad)), rows)[0]


@query("SELECT story_id, min(article_id) AS filing_id FROM (SELECT id % 50 AS story_id, id AS article_id FROM filings) GROUP BY 1", FILINGS)
def q121_insert_story_filing_links(spark, sf):
    rows = filings(spark, sf).select((F.col("id") % 50).alias("story_id"), F.col("id").alias("filing_id"))
    return _saved("story_filing_link", rows, rows)[0]


@query("SELECT id, " + VECTOR_OF.format("coalesce(summary, title)", "(SELECT * FROM articles WHERE collector <> 'gemini')"), ARTICLES)
def q122_store_news_with_vectors(spark, sf):
    new = articles(spark, sf).where("collector <> 'gemini'").withColumn("url", F.concat(F.lit("u"), F.col("id"))).withColumn("article_key", F.col("url"))
    new = new.withColumn("embedding", letter_embedding(F.coalesce("summary", "title")))
    return _saved("news_articles", new.where("id % 2 = 0"), new)[0].select("id", _rounded("embedding"))


@query("SELECT kind, count(*) AS documents, CASE WHEN kind = 'kb_chunk' THEN 2 ELSE 1 END AS revision, bit_xor(('0x' || substr(md5(id || ':' || body), 1, 14))::BIGINT) AS contents FROM (SELECT 'news' AS kind, doc_id AS id, coalesce(text, '') AS body FROM documents UNION ALL SELECT 'filing_chunk', o_orderkey, o_orderpriority FROM orders UNION ALL SELECT 'kb_chunk', p_partkey, p_name FROM part UNION ALL SELECT 'long_story', c_custkey, c_mktsegment FROM customer) GROUP BY 1")
def q123_index_documents(spark, sf):
    docs = table(spark, sf, "documents").select(F.lit("news").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    lines = table(spark, sf, "orders").select(F.lit("filing_chunk").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("body"))
    parts = table(spark, sf, "part").select(F.lit("kb_chunk").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("body"))
    long = table(spark, sf, "customer").select(F.lit("long_story").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("body"))
    every = docs.unionByName(lines).unionByName(parts).unionByName(long).withColumn("revision", F.lit(1))
    out = _saved("search_index", every, every.where("kind = 'kb_chunk'").withColumn("revision", F.lit(2)))[0]
    content = ids.bigint_id(F.concat_ws(":", F.col("id").cast("string"), F.coalesce("body", F.lit(""))))
    return out.groupBy("kind").agg(F.count("*").alias("documents"), F.max("revision").alias("revision"), F.bit_xor(content).alias("contents"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def q124_delete_orphans(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("last_updated_at"))
    _, path = _saved("long_stories", rows)
    orphans = tables.without(rows, table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")), ["id"])
    delete(spark, path, orphans, ["id"])
    return load(spark, path).select("id")


@query("SELECT ('0x' || substr(md5(ticker || '_' || accession), 1, 14))::BIGINT AS id, accession, (SELECT count(*) FROM lineitem WHERE l_orderkey = f.id) AS chunks FROM filings f", FILINGS)
def q125_migrate_filing_ids(spark, sf):
    f = filings(spark, sf)
    moved = stories.new_ids(f, ids.bigint_id(ids.joined_key(F.col("ticker"), F.col("accession"))))
    chunks = stories.remapped(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("filing_id")), moved, "filing_id")
    counts = chunks.groupBy("filing_id").agg(F.count("*").alias("chunks")).withColumnRenamed("filing_id", "new_id")
    return f.join(moved, "id").join(counts, "new_id", "left").select(F.col("new_id").alias("id"), "accession", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("SELECT c_custkey AS id, c_mktsegment AS title FROM customer WHERE c_mktsegment = 'BUILDING'")
def q126_truncate_long_stories(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("title"), F.lit(1).alias("last_updated_at"))
    _, path = _saved("long_stories", rows)
    truncate(spark, path)
    save(rows.where("title = 'BUILDING'"), path, TABLES["long_stories"])  # of what was there before nothing is left
    return load(spark, path).select("id", "title")


@query("SELECT DISTINCT upper(trim(c_mktsegment)) AS symbol FROM customer WHERE c_mktsegment <> 'BUILDING' UNION SELECT 'NEW'")
def q127_watchlist_changes(spark, sf):
    now = stories.symbols(table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("symbol")))
    return stories.changed_symbols(now, add=[" new ", "new"], remove=["building"])
