"""Queries of story making and long stories: keys, model answers as rows, gates, merges, refreshes, queues of missing work."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, ids, text
from tidemark.inputs import ARTICLES, BRIEFS, CHUNKS, FILINGS, VECTORS, article_links, articles, book_chunks, briefs, filings, table, vectors
from tidemark.operators import chunks, longstories, stories, tables
from tidemark.operators import vectors as vec
from tidemark.plans.base import query
from tidemark.plans.writes import VECTOR_OF
from tidemark.providers import letter_embedding


@query("SELECT id, size, round(first, 4) AS first FROM (SELECT vec_id AS id, CASE WHEN vec_id % 4 = 3 THEN NULL ELSE 64 END AS size, CASE WHEN vec_id % 4 < 3 THEN embedding[1]::DOUBLE END AS first FROM embeddings)")
def q161_vectors_of_text(spark, sf):
    raw = F.when(F.col("vec_id") % 4 == 3, "not a vector").otherwise(F.to_json(F.col("embedding").cast("array<double>")))
    v = text.vector_of(raw)
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.size(v) > 0, F.size(v)).alias("size"), F.round(F.try_element_at(v, F.lit(1)), 4).alias("first"))


@query("SELECT id, 'brief_fx_' || day || ':' || ('0x' || substr(md5('brief_fx_' || day), 1, 14))::BIGINT AS brief, ('0x' || substr(md5('file:' || id || '_7'), 1, 14))::BIGINT AS chunk, 'av_macro_' || substr(md5('u' || id || day), 1, 12) AS article FROM (SELECT id, published_at::DATE::VARCHAR AS day FROM articles)", ARTICLES)
def q162_string_keys(spark, sf):
    rows = articles(spark, sf).select("id", F.to_date("published_at").cast("string").alias("day"))
    key = ids.joined_key(F.lit("brief"), F.lit("fx"), F.col("day"))
    return rows.select("id", F.concat_ws(":", key, ids.bigint_id(key).cast("string")).alias("brief"), ids.bigint_id(ids.joined_key(F.concat(F.lit("file:"), "id"), F.lit(7))).alias("chunk"), ids.short_id("av_macro_", F.concat(F.lit("u"), "id"), F.col("day")).alias("article"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') ELSE NULL END AS t FROM events")
def q163_times_of_text(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.element_at(F.array(iso, F.concat(iso, F.lit("Z")), F.concat(iso, F.lit("+05:00")), F.lit("not-a-date"), F.lit("")), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", F.date_format(dates.parse_time(raw), "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("""SELECT id, trim(title) AS title, CASE id % 4 WHEN 0 THEN 'OVERNIGHT' WHEN 1 THEN 'MIXED' ELSE 'UNKNOWN' END AS session_label, CASE WHEN id % 3 = 0 THEN 'UP' ELSE 'NEUTRAL' END AS direction_bias, CASE WHEN id % 5 > 0 THEN (id % 50) / 10::DOUBLE END AS expected_abs_move_pct, CASE WHEN id % 2 = 0 THEN published_at::DATE::VARCHAR END AS estimated_filing_date_et, CASE WHEN id % 7 = 0 THEN 2 ELSE 0 END AS topics FROM articles""", ARTICLES)
def q164_story_of_answer(spark, sf):
    date = F.when(F.col("id") % 2 == 0, F.concat(F.to_date("published_at").cast("string"), F.lit("T00:00"))).otherwise("soon")
    answer = F.to_json(F.struct(
        F.concat(F.lit(" "), "title", F.lit(" ")).alias("title"), F.lit("s").alias("summary"), F.when(F.col("id") % 7 == 0, F.lit('["a", "b"]')).otherwise(F.lit("none")).alias("topics"),
        F.element_at(F.array(F.lit("overnight "), F.lit("Mixed"), F.lit("WHENEVER"), F.lit(None).cast("string")), (F.col("id") % 4 + 1).cast("int")).alias("session_label"),
        F.when(F.col("id") % 3 == 0, "up").otherwise("sideways").alias("direction_bias"), F.when(F.col("id") % 5 > 0, (F.col("id") % 50 / 10.0).cast("string")).otherwise("much").alias("expected_abs_move_pct"), date.alias("estimated_filing_date_et"),
    ))
    s = longstories.story_of(answer)
    return articles(spark, sf).select("id", *(s[c].alias(c) for c in ("title", "session_label", "direction_bias", "expected_abs_move_pct", "estimated_filing_date_et")), F.size(s["topics"]).alias("topics"))


@query("""SELECT f.id FROM filings f WHERE form_type = '10-Q' AND filed_date >= DATE '1998-06-30' - 180 AND filed_date <= DATE '1998-06-30' AND NOT EXISTS (SELECT 1 FROM filings g WHERE g.ticker = f.ticker AND g.form_type = '10-K' AND g.filed_date > f.filed_date AND g.filed_date <= least(f.filed_date + 1, DATE '1998-06-30'))""", FILINGS)
def q165_filing_insight_gates(spark, sf):
    f = filings(spark, sf)
    cited = f.where("form_type = '10-Q'").withColumn("story_date", F.lit("1998-06-30").cast("date"))
    cited = longstories.young_enough(cited, "filed_date", "story_date", 180)
    until = F.least(F.date_add("filed_date", 1), F.col("story_date"))
    newer = tables.has_between(cited.withColumn("until", until), f.where("form_type = '10-K'"), "ticker", "filed_date", "until", "filed_date")
    return cited.select("id").join(newer.select("id"), "id", "left_anti")


@query("SELECT ticker, CASE WHEN min(filed_date) = max(filed_date) THEN min(filed_date)::VARCHAR ELSE min(filed_date) || ' – ' || max(filed_date) END AS range, count(DISTINCT accession) AS cited FROM filings GROUP BY 1", FILINGS)
def q166_citation_ranges(spark, sf):
    return filings(spark, sf).groupBy("ticker").agg(longstories.date_range(F.col("filed_date")).alias("range"), F.countDistinct("accession").alias("cited"))


COS = """unitv AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM vec), story AS (SELECT * FROM unitv WHERE id % 50 = 0),
  near AS (SELECT s.id AS story_id, r.id AS long_story_id, round(list_dot_product(s.u, r.u), 5) AS sim FROM story s JOIN unitv r ON r.ticker = s.ticker AND r.id % 50 <> 0 QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY round(list_dot_product(s.u, r.u), 5) DESC, r.id) = 1)"""


@query("""SELECT s.id AS story_id, CASE WHEN n.sim > 0.25::DOUBLE THEN 'merge' WHEN g.days >= 3 THEN 'create' ELSE 'none' END AS action, CASE WHEN n.sim > 0.25::DOUBLE THEN n.long_story_id END AS long_story_id
  FROM story s LEFT JOIN near n ON n.story_id = s.id LEFT JOIN (SELECT ticker, count(DISTINCT isoyear(published_at) * 100 + week(published_at)) AS days FROM vec GROUP BY 1) g ON g.ticker = s.ticker""", VECTORS, COS)
def q167_merge_or_create(spark, sf):
    rows = vec.with_unit(vectors(spark, sf))
    asked = rows.where("id % 50 = 0")
    return longstories.merge_or_create(asked, rows.where("id % 50 <> 0"), rows, 0.25, 3).select("story_id", "action", "long_story_id")


@query("""SELECT story_id, count(*) AS links, string_agg(title, ' | ' ORDER BY n) AS titles FROM (SELECT l.story_id, a.title, row_number() OVER (PARTITION BY l.story_id ORDER BY a.published_at DESC, a.id) AS n FROM (SELECT doc_id % 97 AS story_id, doc_id AS article_id FROM documents) l JOIN articles a ON a.id = l.article_id) WHERE n <= 5 GROUP BY 1""", ARTICLES)
def q168_refresh_long_stories(spark, sf):
    return longstories.refreshed(article_links(spark, sf), articles(spark, sf), 5).select("story_id", "links", F.array_join("titles", " | ").alias("titles"))


@query("SELECT story_id, coalesce(min(CASE WHEN role = 'ANCHOR' THEN article_id END), min(article_id)) AS anchor_id FROM (SELECT doc_id % 97 AS story_id, doc_id AS article_id, CASE WHEN doc_id % 11 = 0 THEN 'ANCHOR' ELSE 'SUPPORTING' END AS role FROM documents) GROUP BY 1")
def q169_anchor_of_story(spark, sf):
    links = article_links(spark, sf).withColumn("role", F.when(F.col("article_id") % 11 == 0, "ANCHOR").otherwise("SUPPORTING"))
    return longstories.anchors(links)


@query("SELECT key, book_id, " + VECTOR_OF.format("text", "book_chunk"), CHUNKS)
def q170_backfill_vectors(spark, sf):
    rows = book_chunks(spark, sf).withColumn("embedding", F.when(F.col("embedded"), letter_embedding(F.col("text"))))
    filled = longstories.with_vectors(rows, "embedding", F.col("text"), letter_embedding)
    return filled.select("key", "book_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("v"))


@query("SELECT day::DATE::VARCHAR AS day FROM generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-05', INTERVAL 1 DAY) d(day) WHERE day::DATE NOT IN (SELECT ts::DATE FROM events WHERE event_type = 'error')")
def q171_days_to_summarise(spark, sf):
    had = table(spark, sf, "events").where("event_type = 'error'").select(F.to_date("ts").alias("day"))
    return longstories.days_without(spark, "2023-12-25", "2024-02-05", had).select(F.col("day").cast("string").alias("day"))


@query("SELECT topic, substr(string_agg(title || ' ' || summary, ' ' ORDER BY revision), 1, 200) AS q FROM (SELECT * FROM brief QUALIFY row_number() OVER (PARTITION BY topic ORDER BY revision) <= 15) GROUP BY topic", BRIEFS)
def q172_query_text_of_items(spark, sf):
    return longstories.query_text(stories.latest_briefs(briefs(spark, sf)), "topic", "revision", 15, 200).select("topic", F.col("text").alias("q"))


@query("SELECT event_id, CASE event_id % 3 WHEN 2 THEN 'No synthesis' ELSE 't' || event_id END AS title, event_id % 3 = 2 AS coverage_gap FROM events")
def q173_synthesis_of_answer(spark, sf):
    body = F.concat(F.lit('{"title": "t'), "event_id", F.lit('", "summary": "s"}'))
    raw = F.element_at(F.array(body, F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.lit("sorry, no")), (F.col("event_id") % 3 + 1).cast("int"))
    s = longstories.synthesis_of(raw, F.lit("No synthesis"))
    return table(spark, sf, "events").select("event_id", s["title"].alias("title"), s["coverage_gap"].alias("coverage_gap"))


@query("SELECT id, published_at::DATE::VARCHAR AS as_of_date, title, 'feed' AS collector FROM articles WHERE trim(title) <> ''", ARTICLES)
def q174_article_to_raw_item(spark, sf):
    return longstories.raw_items(articles(spark, sf), F.to_date("published_at")).select("id", F.col("as_of_date").cast("string").alias("as_of_date"), "title", F.lit("feed").alias("collector"))


@query("SELECT chunk_doc AS doc, c_start AS start, min(page) AS page_start, max(page) AS page_end FROM (SELECT doc_id AS chunk_doc, unnest(range(0, n_chars, 500)) AS c_start, n_chars FROM documents) c JOIN (SELECT doc_id, unnest(range(0, n_chars, 700)) AS p_start, n_chars FROM documents) q ON q.doc_id = c.chunk_doc JOIN LATERAL (SELECT p_start // 700 + 1 AS page) ON true WHERE least(p_start + 700, q.n_chars) > c_start AND p_start < least(c_start + 600, c.n_chars) GROUP BY 1, 2")
def q175_pages_of_chunks(spark, sf):
    d = table(spark, sf, "documents")
    cut = lambda step: F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars") - 1, F.lit(step).cast("long")))
    d = d.where("n_chars > 0")
    spans = d.select(F.col("doc_id").alias("doc"), "n_chars", cut(500).alias("start")).withColumn("end", F.least(F.col("start") + 600, "n_chars"))
    pages = d.select(F.col("doc_id").alias("doc"), "n_chars", cut(700).alias("start")).select("doc", (F.floor(F.col("start") / 700) + 1).alias("page"), "start", F.least(F.col("start") + 700, "n_chars").alias("end"))
    return chunks.page_ranges(spans.drop("n_chars"), pages).select("doc", "start", "page_start", "page_end")


@query("SELECT c_custkey AS id, concat_ws(chr(10), 'story ' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a, b' END, c_mktsegment) AS text FROM customer")
def q176_text_to_embed(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("story "), "c_custkey").alias("title"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("topics"), F.col("c_mktsegment").alias("summary"))
    return rows.select("id", longstories.story_text(F.col("title"), F.col("topics"), F.col("summary")).alias("text"))


@query("SELECT id, 'T' || (id % 10) AS ticker, relation FROM (SELECT doc_id AS id, CASE WHEN doc_id % 10 = doc_id % 97 % 10 THEN 'OWN' ELSE 'RELATED' END AS relation FROM documents)")
def q177_relation_of_links(spark, sf):
    rows = article_links(spark, sf).select(F.col("article_id").alias("id"), F.concat(F.lit("T"), F.col("article_id") % 10).alias("ticker"), F.concat(F.lit("T"), F.col("story_id") % 10).alias("story_ticker"))
    return rows.select("id", "ticker", F.when(F.col("ticker") == F.col("story_ticker"), "OWN").otherwise("RELATED").alias("relation"))


@query()
def q178_cross_source_similar(spark, sf):
    from tidemark.operators import search

    priority = spark.createDataFrame([("src1", 1), ("src2", 2)], "source string, priority int")
    return search.cross_source_similar(articles(spark, sf).select("ord", "language", "title", "source"), priority).select("ord", "source")


@query()
def q179_similar_articles(spark, sf):
    from tidemark.operators import search

    rows = articles(spark, sf).select("ord", "title", "summary", (F.col("ord") % 7).alias("relevance"))
    return search.keep_relevant_articles(rows).select("ord")


@query(f"SELECT id FROM articles WHERE contains(lower(title || ' ' || summary), 'rate') QUALIFY row_number() OVER (PARTITION BY lower(trim(title)), source ORDER BY ord) = 1", ARTICLES)
def q180_dedupe_then_relevance(spark, sf):
    rows = articles(spark, sf).withColumn("key", F.concat_ws("|", F.lower(F.trim("title")), "source"))
    relevant = rows.where(text.both(F.col("title"), F.col("summary")).contains("rate"))
    return tables.first_of_id(relevant.select("key", "ord", "id"), "key", "ord").select("id")
