"""Queries over what is stored first: archives of payloads, feeds and filing answers, indexes, answers of models."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import answers
from tidemark.inputs import ARTICLES, BRIEFS, DAILY, TICKS, VECTORS, articles, briefs, table, ticks, vectors
from tidemark.operators import growing, longstories, market, postings, search, stories, tables, vectorindex
from tidemark.operators import vectors as vec
from tidemark.plans.base import query
from tidemark.plans.registry import BM25, COSINE, HYBRID, RRF
from tidemark.plans.sourcing import _RANGE, _at, _recorded
from tidemark.providers import letter_embedding
from tidemark.sources import feeds, recorded
from tidemark.storage import scratch, written

_NOW = "2024-02-01 00:00:00"
_FROM, _UNTIL = datetime(2024, 1, 5), datetime(2024, 1, 20)


# Payloads


@query(f"SELECT 'massive_' || substr(md5('a' || id || 'http://x/' || id), 1, 12) AS id, ticker, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, 'http://x/' || id AS url, source FROM articles WHERE trim(title) <> '' AND ticker IN ('T1', 'T2', 'T3') AND published_at BETWEEN {_RANGE}", ARTICLES)
def q192_recorded_window(spark, sf):
    made = _recorded(spark, sf, "massive", "results", ("id", "concat('a', id)"), ("title", "title"), ("published_utc", "iso"), ("article_url", "concat('http://x/', id)"), ("publisher", "named_struct('name', source)"))
    path = scratch(spark, "archive")
    recorded.record(made.unionByName(made.withColumn("source", F.lit("marketaux"))), path)
    out = recorded.collect(spark, path, _FROM, _UNTIL, _at(_NOW), ["massive"], ["t1", "T2", " T3 "], days_per_task=4)
    return out.select("id", "ticker", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "url", "source")


@query("SELECT n_name AS source_id, (n_nationkey % 5)::INT AS priority FROM nation WHERE n_regionkey <> 0 AND n_regionkey <> 3")
def q193_registered_sources(spark, sf):
    kind = F.when(F.col("n_regionkey") == 3, "macro").when(F.col("n_regionkey") == 2, "multi").otherwise("news")
    rows = table(spark, sf, "nation").select(F.col("n_name").alias("source_id"), (F.col("n_regionkey") != 0).alias("enabled"), (F.col("n_nationkey") % 5).cast("int").alias("priority"), kind.alias("source_type"))
    return feeds.registered(rows).select("source_id", "priority")


@query(f"""SELECT 'av_' || substr(md5('http://v/' || id || strftime(published_at, '%Y%m%dT%H%M%S')), 1, 12) AS id, CASE WHEN id % 3 = 0 THEN 'T9' ELSE ticker END AS ticker, title, source, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at
  FROM articles WHERE (id % 3 = 0 OR ticker IN ('T1', 'T2', 'T9')) AND published_at BETWEEN {_RANGE}""", ARTICLES)
def q194_ticker_news(spark, sf):
    fields = (("title", "title"), ("url", "concat('http://v/', id)"), ("time_published", "date_format(published_at, \"yyyyMMdd'T'HHmmss\")"), ("source", "source"), ("ticker_sentiment", "transform(IF(id % 3 = 0, array('zz', 't9'), array('none', lower(ticker))), t -> named_struct('ticker', t))"))
    out = feeds.ticker_news(_recorded(spark, sf, "alpha", "feed", *fields), ["T1", "t2", "T9"], _at("2024-01-05 00:00:00"), _at("2024-01-20 00:00:00"))
    return out.select("id", "ticker", "title", "source", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query("SELECT ticker, day::DATE::VARCHAR AS day, nullif(round(close, 4), 0) AS price, nullif(round(close - open, 2), 0) AS change_percent FROM daily", TICKS, DAILY)
def q195_quotes(spark, sf):
    days = market.bars(ticks(spark, sf), "1 day")
    quote = F.struct(F.round("close", 4).cast("decimal(18,4)").cast("string").alias("05. price"), F.concat(F.round(F.col("close") - F.col("open"), 2).cast("decimal(18,2)").cast("string"), F.lit("%")).alias("10. change percent"))
    bodies = days.select("ticker", F.to_date("start").cast("string").alias("day"), F.to_json(F.struct(quote.alias("Global Quote"))).alias("body"))
    return bodies.select("ticker", "day", feeds.quote(F.col("body")).alias("q")).select("ticker", "day", F.col("q.price").alias("price"), F.col("q.change_percent").alias("change_percent"))


#: Texts of feeds without tags, entities resolved and blanks collapsed; the articles' texts have no tags of their own.
_PLAIN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query(f"""SELECT 'feed_' || substr(md5('http://j/' || id || shown), 1, 12) AS id, shown AS title, 'a' || (id % 3) || ', b' AS author, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, CASE WHEN regexp_matches(shown, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'zh' ELSE 'en' END AS language
  FROM (SELECT *, {_PLAIN.format("CASE WHEN id % 4 > 0 AND trim(title) <> '' THEN trim(title) WHEN length(summary) > 100 THEN substr(summary, 1, 100) || '...' ELSE summary END")} AS shown FROM articles) WHERE shown IS NOT NULL AND published_at BETWEEN TIMESTAMP '2024-01-25' AND TIMESTAMP '{_NOW}'""", ARTICLES)
def q196_json_feeds(spark, sf):
    item = F.struct(
        F.when(F.col("id") % 4 > 0, F.col("title")).alias("title"), F.concat(F.lit("http://j/"), "id").alias("url"), F.col("summary").alias("content_text"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_published"),
        F.array(F.struct(F.concat(F.lit("a"), F.col("id") % 3).alias("name")), F.struct(F.lit("b").alias("name"))).alias("authors"),
    )
    made = articles(spark, sf).groupBy("source", "ticker", F.to_date("published_at").alias("day")).agg(F.to_json(F.struct(F.lit("https://jsonfeed.org/version/1.1").alias("version"), F.collect_list(item).alias("items"))).alias("body"))
    out = feeds.feed_news(made, _at(_NOW), 7)
    return out.select("id", "title", "author", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "language")


@query(f"SELECT 'http://r/' || id AS url, shown AS title, CASE WHEN id % 10 = 0 THEN '{_NOW}' ELSE strftime(published_at, '%Y-%m-%d %H:%M:%S') END AS published_at FROM (SELECT *, {_PLAIN.format('title')} AS shown FROM articles) WHERE shown <> '' AND (id % 10 = 0 OR published_at BETWEEN TIMESTAMP '2024-01-25' AND TIMESTAMP '{_NOW}')", ARTICLES)
def q197_xml_feeds(spark, sf):
    safe = F.replace(F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    dated = F.when(F.col("id") % 10 == 0, "<pubDate>soon</pubDate>").otherwise(F.concat(F.lit("<pubDate>"), F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate>")))
    item = F.concat(F.lit("<item><title>"), safe, F.lit("</title>"), F.when(F.col("id") % 2 == 0, F.lit("<link>")).otherwise("<guid>"), F.lit("http://r/"), F.col("id"), F.when(F.col("id") % 2 == 0, F.lit("</link>")).otherwise("</guid>"), dated, F.lit("<description>&lt;p&gt;x&lt;/p&gt;</description></item>"))
    rows = articles(spark, sf).where("trim(title) <> ''")
    made = rows.groupBy("source", "ticker", F.to_date("published_at").alias("day")).agg(F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>c</title>'), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("body"))
    return feeds.feed_news(made, _at(_NOW), 7).select("url", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query("SELECT 'C' || o_custkey AS ticker, lpad(o_custkey::VARCHAR, 10, '0') AS cik, form AS form_type, o_orderdate::DATE::VARCHAR AS filed_date, o_orderkey::VARCHAR AS accession, CASE WHEN form IN ('8-K', '10-K', '10-Q') THEN 'high' WHEN form = '4' THEN 'medium' ELSE 'low' END AS impact FROM (SELECT *, ['8-K', '10-K', '4', 'S-1', '10-Q'][substr(o_orderpriority, 1, 1)::INT] AS form FROM orders) WHERE o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'")
def q198_company_filings(spark, sf):
    o = table(spark, sf, "orders").withColumn("form", F.element_at(F.array(*map(F.lit, ("8-K", "10-K", "4", "S-1", "10-Q"))), F.substring("o_orderpriority", 1, 1).cast("int")))
    of = F.sort_array(F.collect_list(F.struct("o_orderkey", "form", F.to_date("o_orderdate").cast("string").alias("day"))))
    lists = o.groupBy("o_custkey").agg(of.alias("x"))
    recent = F.struct(F.transform("x", lambda r: r["form"]).alias("form"), F.transform("x", lambda r: r["day"]).alias("filingDate"), F.transform("x", lambda r: r["o_orderkey"].cast("string")).alias("accessionNumber"), F.transform("x", lambda r: F.concat(r["o_orderkey"], F.lit(".htm"))).alias("primaryDocument"))
    bodies = lists.select(F.concat(F.lit("C"), "o_custkey").alias("ticker"), F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("body"))
    out = feeds.company_filings(bodies, F.lit("1995-01-01").cast("date"), F.lit("1997-12-31").cast("date"), most=1000)
    return out.select("ticker", feeds.padded_cik(F.substring("ticker", 2, 20)).alias("cik"), "form_type", F.col("filed_date").cast("string").alias("filed_date"), "accession", "impact")


@query("SELECT ticker AS indicator, day::DATE::VARCHAR AS day, round(close, 4) AS value, round(previous, 4) AS previous FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY day) AS previous FROM daily) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY day DESC) = 1", TICKS, DAILY)
def q199_indicators(spark, sf):
    series = market.bars(ticks(spark, sf), "1 day").select(F.col("ticker").alias("indicator"), F.to_date("start").alias("day"), F.col("close").alias("value"))
    return feeds.latest_with_previous(series).select("indicator", F.col("day").cast("string").alias("day"), F.round("value", 4).alias("value"), F.round("previous", 4).alias("previous"))


@query("SELECT ticker, strftime(published_at, '%Y-%m-%d') AS day, 'n' || id || ' ' || language AS title, 's' || id AS summary, source, CASE WHEN id % 2 = 0 THEN strftime(published_at, '%Y-%m-%d') END AS date FROM articles", ARTICLES)
def q200_markdown_articles(spark, sf):
    block = F.concat(F.lit("**Title:** n"), "id", F.lit(" "), "language", F.lit("\n*Summary*: s"), "id", F.lit("\n* source : * "), "source", F.when(F.col("id") % 2 == 0, F.concat(F.lit("\n**Date**: "), F.date_format("published_at", "yyyy-MM-dd"))).otherwise(""))
    made = articles(spark, sf).groupBy("ticker", F.date_format("published_at", "yyyy-MM-dd").alias("day")).agg(F.concat(F.lit("Here they are.\n"), F.array_join(F.collect_list(block), "\n\n")).alias("body"))
    return made.select("ticker", "day", F.explode(feeds.markdown_articles(F.col("body"))).alias("a")).select("ticker", "day", "a.*")


# Indexes


def _texts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _indexed(spark, sf):
    """An index of the texts in two loads; the second brings all, of which half is known."""
    path = scratch(spark, "postings")
    docs = _texts(spark, sf)
    postings.add(docs.where("id % 2 = 0"), path)
    postings.add(docs, path)
    return path


@query("SELECT query_id, id, round(score, 4) AS score FROM kw QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, id) <= 10", BM25)
def q201_stored_search(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return postings.search(spark, _indexed(spark, sf), asked, 10)


@query("SELECT w, count(*) AS documents, sum(tf)::BIGINT AS occurrences, max(tf) AS most FROM (SELECT id, w, count(*) AS tf FROM (SELECT id, unnest(ws) AS w FROM tok) GROUP BY ALL) GROUP BY w", BM25)
def q202_stored_words(spark, sf):
    rows = postings.postings(spark, _indexed(spark, sf))
    total = F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x["tf"])
    return rows.groupBy("w").agg(F.sum("n").alias("documents"), F.sum(total).alias("occurrences"), F.max("max_tf").alias("most"))


def _vector_index(spark, sf):
    rows = vec.with_unit(vectors(spark, sf))
    return rows, vectorindex.build(rows.select("id", "u", "ticker"), scratch(spark, "vectors"))


@query("SELECT query_id, id, sim, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM sims) WHERE rank <= 10", VECTORS, COSINE)
def q203_vector_index_exact(spark, sf):
    rows, index = _vector_index(spark, sf)
    return vectorindex.search(spark, index, vec.as_queries(rows.where("id % 50 = 0")), 10, probes=1, exact=True)


@query()
def q204_vector_index(spark, sf):
    """Two thirds of the cells are read: these vectors have no clusters, so that fewer would find fewer than 0.9."""
    rows, index = _vector_index(spark, sf)
    return vectorindex.search(spark, index, vec.as_queries(rows.where("id % 50 = 0")), 10, probes=-(-2 * len(index.centroids) // 3))


@query(RRF, BM25, VECTORS, HYBRID)
def q214_stored_hybrid(spark, sf):
    """Ranks of a keyword index and of a vector index, merged."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    words_side = tables.top_per(postings.search(spark, _indexed(spark, sf), asked, 20), ["query_id"], [F.col("score").desc(), F.col("id")], 20, rank="rank")
    rows, index = _vector_index(spark, sf)
    named = vec.as_queries(rows.join(asked.select(F.col("query_id").alias("id")), "id", "left_semi"))
    vector_side = vectorindex.search(spark, index, named, 20, probes=1, exact=True, itself=True)
    key = F.struct("query_id", "id").alias("k")
    fused = tables.fused({"words": words_side.select(key, "rank"), "vectors": vector_side.select(key, "rank")}, "k")
    return fused.select("k.query_id", "k.id", F.round("score", 6).alias("score"))


# Answers of models; stand-ins answer by rule


def _judge(common: str, items: list[str]) -> list[str | None]:
    """Says whether an item speaks of rates, and nothing of items whose length ends in 0 or 5."""
    return [None if len(x) % 5 == 0 else json.dumps("rate" in x.lower()) for x in items]


@query("SELECT id, CASE WHEN length('Title: ' || title || chr(10) || '   Summary: ' || summary) % 5 = 0 THEN (0.4::DOUBLE + least((contains(low, 'the')::INT + contains(low, 'fed')::INT) * 0.1::DOUBLE, 0.4::DOUBLE)) >= 0.5::DOUBLE ELSE contains(low, 'rate') END AS relevant FROM (SELECT *, lower(title || ' ' || summary) AS low FROM articles)", ARTICLES)
def q205_relevance_of_model(spark, sf):
    path = scratch(spark, "answers")
    rows = articles(spark, sf)
    answers.relevant(rows.where("id % 2 = 0"), _judge, path, ["the", "fed"], 0.5)
    return answers.relevant(rows, _judge, path, ["the", "fed"], 0.5).select("id", "relevant")


@query("SELECT min(id) AS id FROM articles WHERE CASE WHEN length('Title: ' || title || chr(10) || '   Summary: ' || summary) % 5 = 0 THEN contains(lower(title || ' ' || summary), 'the') OR contains(lower(title || ' ' || summary), 'fed') ELSE contains(lower(title || ' ' || summary), 'rate') END GROUP BY ticker, lower(trim(title))", ARTICLES)
def q206_filtered_by_model(spark, sf):
    return answers.filtered(articles(spark, sf), _judge, scratch(spark, "answers"), ["the", "fed"], 0.5).select("id")


def _teller(prompt: str) -> str | None:
    lines = prompt.split("\n")
    return json.dumps({"title": f"{lines[0]}: {len(lines) - 1} articles", "summary": lines[1], "omit_story": len(lines) == 2})


@query("SELECT min(id) AS cluster, 'Ticker ' || ticker || ' on ' || published_at::DATE || ': ' || count(*) || ' articles' AS title, '- n' || min(id) || ': ' || arg_min(source, id) AS summary FROM articles GROUP BY ticker, published_at::DATE HAVING count(*) > 1", ARTICLES)
def q207_stories_of_model(spark, sf):
    item = F.struct("id", F.concat(F.lit("n"), "id").alias("title"), F.col("source").alias("summary"))
    made = articles(spark, sf).groupBy("ticker", F.to_date("published_at").alias("day")).agg(F.min("id").alias("cluster"), F.sort_array(F.collect_list(item)).alias("articles"))
    return answers.stories(made, _teller, scratch(spark, "answers")).select("cluster", "title", "summary")


@query("SELECT c_custkey AS id, c_mktsegment IN ('BUILDING', 'MACHINERY') AS worth FROM customer")
def q208_worth_long_story(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("story "), "c_custkey").alias("title"), F.lit("s").alias("summary"), F.array("c_mktsegment").alias("topics"))
    gate = lambda p: {"BUILDING": "true", "MACHINERY": " Yes", "FURNITURE": None}.get(p.split("\n")[-1], "false")
    return answers.worth_long_story(rows, gate, scratch(spark, "answers")).select("id", "worth")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'order ' || o_orderkey || '  of ' || o_custkey ELSE 'ORDER ' || o_orderkey || '  OF ' || o_custkey END AS formatted FROM orders")
def q209_formatted_chunks(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order "), "o_orderkey", F.lit("  of "), "o_custkey").alias("text"))
    model = lambda t: None if int(t.split()[1]) % 4 == 0 else t.upper()
    return answers.formatted(rows, model, scratch(spark, "answers")).select("id", "formatted")


def _grouper(prompt: str) -> str:
    groups: dict[str, list[int]] = {}
    for line in prompt.split("\n")[1:]:
        number, _, title = line.partition("\t")
        groups.setdefault(title.strip(), []).append(int(number))
    return json.dumps([g for g in groups.values()])


@query("SELECT id, kept FROM (SELECT id, min(id) OVER (PARTITION BY ticker, trim(lower(coalesce(title, '')))) AS kept FROM articles) WHERE id <> kept", ARTICLES)
def q210_groups_of_model(spark, sf):
    rows = articles(spark, sf).select("ticker", "id", F.lower(F.coalesce("title", F.lit(""))).alias("title"))
    return answers.proposed_groups(rows, _grouper, scratch(spark, "answers"), part=1 << 20)


# Components


@query("SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS cluster FROM orders")
def q211_growing_components(spark, sf):
    """Orders of a customer, linked one to the next, in three loads of which each brings every third order."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    last = F.lag("id").over(Window.partitionBy("o_custkey").orderBy("id"))
    edges = written(o.withColumn("a", last).where("a IS NOT NULL").select("a", F.col("id").alias("b")), "edges")  # read for each load
    load_of = lambda c: F.col(c) % 3
    path = scratch(spark, "components")
    for n in range(3):
        growing.grow(o.where(load_of("id") == n).select("id"), edges.where(F.greatest(load_of("a"), load_of("b")) == n), path)
    return growing.labels(spark, path)


# Excerpts of a knowledge base


_LETTERS = "list_transform(['e', 't', 'a', 'o', 'i', 'n', 's', 'r'], lambda c: (length({0}) - length(replace({0}, c, '')))::DOUBLE)"
_UNIT = "CASE WHEN list_dot_product(l, l) = 0 THEN l ELSE list_transform(l, lambda x: x / sqrt(list_dot_product(l, l))) END"
KB = f"""kb AS (SELECT id, text, {_UNIT} AS u FROM (SELECT p_partkey AS id, p_name AS text, {_LETTERS.format("lower(p_name)")} AS l FROM part)),
  near AS (SELECT query_id, kb.id, round(list_dot_product(a.u, kb.u), 5) AS sim FROM (SELECT *, {_UNIT} AS u FROM (SELECT *, {_LETTERS.format("lower(query_text)")} AS l FROM asked)) a, kb WHERE a.vector)"""
_TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
KB_WORDS = f"""kt AS (SELECT id, {_TOKENS.format("text")} AS ws FROM kb), ks AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM kt),
  ktf AS (SELECT id, len(ws) AS dl, w, count(*) AS tf FROM (SELECT id, ws, unnest(ws) AS w FROM kt) GROUP BY ALL), kdf AS (SELECT w, count(*) AS df FROM ktf GROUP BY w),
  kq AS (SELECT DISTINCT query_id, unnest({_TOKENS.format("query_text")}) AS w FROM asked WHERE NOT vector),
  byword AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75 * dl / a))), 4) AS score FROM ktf JOIN kdf USING (w) JOIN kq USING (w), ks GROUP BY 1, 2)"""


def _knowledge(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return rows.withColumn("u", letter_embedding(F.col("text")))


@query("SELECT query_id, id, 'vector' AS way, (row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id))::INT AS rank FROM near QUALIFY rank <= 4 UNION ALL SELECT query_id, id, 'keywords', (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM byword QUALIFY rank <= 4",
       "asked AS (SELECT item_id AS query_id, text AS query_text, item_id % 3 > 0 AS vector FROM benchmark WHERE trim(text) <> '' UNION ALL SELECT n_nationkey + 100000, p_name, false FROM nation JOIN part ON p_partkey = n_nationkey)", KB, KB_WORDS)
def q212_excerpts(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("query_text"), (F.col("item_id") % 3 > 0).alias("vector"))
    named = table(spark, sf, "nation").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("n_nationkey"))
    asked = asked.unionByName(named.select((F.col("n_nationkey") + 100000).cast("long").alias("query_id"), F.col("p_name").alias("query_text"), F.lit(False).alias("vector")))
    asked = asked.withColumn("q", F.when(F.col("vector"), letter_embedding(F.col("query_text"))))
    return search.excerpts(asked, _knowledge(spark, sf), 8, 4)


@query("SELECT topic, string_agg(text, ' | ' ORDER BY sim DESC, id) AS excerpts FROM (SELECT query_id AS topic, kb.id, kb.text, sim FROM near JOIN kb USING (id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, kb.id) <= 3) GROUP BY 1", BRIEFS,
       "asked AS (SELECT topic AS query_id, substr(string_agg(title || ' ' || summary, ' ' ORDER BY revision), 1, 200) AS query_text, true AS vector FROM (SELECT * FROM brief QUALIFY row_number() OVER (PARTITION BY topic ORDER BY revision) <= 15) GROUP BY topic)", KB)
def q213_briefs_with_excerpts(spark, sf):
    asked = longstories.query_text(stories.latest_briefs(briefs(spark, sf)), "topic", "revision", 15, 200).select(F.col("topic").alias("query_id"), F.col("text").alias("query_text"))
    kb = _knowledge(spark, sf)
    found = search.excerpts(asked.withColumn("q", letter_embedding(F.col("query_text"))), kb, 6, 3).join(kb.select("id", "text"), "id")
    lists = found.groupBy(F.col("query_id").alias("topic")).agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("x"))
    return lists.select("topic", F.array_join(F.transform("x", lambda r: r["text"]), " | ").alias("excerpts"))
