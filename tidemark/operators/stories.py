"""Stories, their links, briefs and lists as table rules."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import finance
from tidemark.functions.dates import fiscal_period, iso_week, latest_evidence
from tidemark.functions.ids import bigint_id, joined_key
from tidemark.operators.tables import carried, latest_per, top_per


def with_links(stories: DataFrame, links: DataFrame, articles: DataFrame) -> DataFrame:
    """stories (id) with the number of linked articles and the latest one's time; stories without links stay."""
    joined = links.join(articles.select(F.col("id").alias("article_id"), "published_at"), "article_id")
    counts = joined.groupBy("story_id").agg(F.count("*").alias("articles"), F.max("published_at").alias("latest"))
    return stories.join(counts, F.col("id") == F.col("story_id"), "left").drop("story_id").withColumn("articles", F.coalesce("articles", F.lit(0)))


def spread_enough(links: DataFrame, at: str, least: int, months: int) -> DataFrame:
    """story_id of the stories with at least so many links in so many different months."""
    out = links.groupBy("story_id").agg(F.count("*").alias("n"), F.countDistinct(F.date_format(at, "yyyy-MM")).alias("m"))
    return out.where((F.col("n") >= least) & (F.col("m") >= months)).select("story_id")


def within_one_week(stories: DataFrame, links: DataFrame, at: str) -> DataFrame:
    """Stories (id) whose links lie in one ISO week at most, or that have none."""
    weeks = links.groupBy(F.col("story_id").alias("id")).agg(F.countDistinct(iso_week(F.col(at))).alias("weeks"))
    return stories.join(weeks, "id", "left").where(F.coalesce("weeks", F.lit(0)) <= 1).drop("weeks")


def best_per_month(rows: DataFrame, at: str, score: Column, key: str, most: int) -> DataFrame:
    """The best row of each month, the earliest months first; rows without a month drop out."""
    dated = rows.where(F.col(at).isNotNull()).withColumn("month", F.date_format(at, "yyyy-MM")).withColumn("__s", score)
    return top_per(dated, ["month"], [F.col("__s").desc(), F.col(key)], 1).drop("__s").orderBy("month").limit(most)


def fallback_score(rerank: Column, similarity: Column) -> Column:
    """The rerank score unless it is missing or 0, then the similarity, then 0."""
    return F.coalesce(F.nullif(rerank, F.lit(0.0)), F.nullif(similarity, F.lit(0.0)), F.lit(0.0))


def briefs(tables: Mapping[str, DataFrame], day: Column, order: list[str]) -> DataFrame:
    """Briefs of one day from several tables (as_of_date, title, summary, ...) with their topic, in a given order."""
    out = None
    for topic, df in tables.items():
        part = df.where(F.col("as_of_date") == day).withColumn("topic", F.lit(topic))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.orderBy(F.array_position(F.array(*map(F.lit, order)), F.col("topic")), "topic")


def symbols(listed: DataFrame) -> DataFrame:
    """A watchlist (symbol): trimmed, upper case, distinct, sorted; blanks drop out."""
    return listed.select(F.upper(F.trim("symbol")).alias("symbol")).where("symbol <> ''").distinct().orderBy("symbol")


def requested(wanted: DataFrame, snapshots: DataFrame) -> DataFrame:
    """wanted (ord, symbol) with the price of each, 0 where there is none, in the order asked for."""
    return wanted.join(snapshots.select("symbol", "price"), "symbol", "left").withColumn("price", F.coalesce("price", F.lit(0.0))).orderBy("ord")


def typeahead(stocks: DataFrame, typed: str, most: int = 5) -> DataFrame:
    """Stocks (ticker, name) whose ticker starts with what is typed or whose name has it."""
    t = typed.strip().lower()
    return stocks.where(F.lower("ticker").startswith(t) | F.lower("name").contains(t)).orderBy("ticker").limit(most)


def nearest(items: DataFrame, points: DataFrame, by: str, at: str, key: str) -> DataFrame:
    """Each item with the point of its group that is nearest in time (ties: the earlier): its value, or null.

    The last point before and the first after are carried on from sorted days of both sides; no pairs are built.
    """
    p = points.select(F.col(by).alias("__by"), F.col(at).alias("__t"), F.lit(0).alias("__side"), F.struct(F.col(at).alias("t"), F.col(key).alias("v")).alias("__p"))
    i = items.select(F.col(by).alias("__by"), F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*items.columns).alias("__i"))
    both = carried(p.unionByName(i, allowMissingColumns=True), "__by", "__t", ["__side"], "__p").withColumnRenamed("__found", "a")
    both = both.withColumn("__turned", -F.col("__side"))  # backwards too, a point of the same time comes before the item
    both = carried(both, "__by", "__t", ["__turned"], "__p", back=True).withColumnRenamed("__found", "b").where("__side = 1")
    gap = lambda c: F.abs(F.unix_micros(F.col(f"{c}.t").cast("timestamp")) - F.unix_micros(F.col("__t").cast("timestamp")))
    pick = F.when(F.col("__t").isNull(), F.lit(None)).when(F.col("b").isNull() | (gap("a") <= gap("b")), F.col("a")).otherwise(F.col("b"))
    return both.withColumn("__n", pick).select("__i.*", F.col("__n.v").alias(key))


def cross_source(rows: DataFrame, priority: DataFrame, group: list[str]) -> DataFrame:
    """One row of each group of equal news: the source of least priority (999 if unknown), then the first."""
    known = rows.join(F.broadcast(priority), "source", "left").withColumn("priority", F.coalesce("priority", F.lit(999)))
    return top_per(known, group, [F.col("priority"), F.col("ord")], 1)


def unembedded(rows: DataFrame, vector: str, key: str, most: int) -> DataFrame:
    """The next rows that have no vector yet."""
    return rows.where(F.col(vector).isNull()).orderBy(key).limit(most)


def clean_tickers(tickers: Column) -> Column:
    """Trimmed, upper case, without blanks; each once, in the order in which they come."""
    return F.array_distinct(F.filter(F.transform(tickers, lambda t: F.upper(F.trim(t))), lambda t: t != ""))


def neighbours(rows: DataFrame, ticker: str, related: str) -> DataFrame:
    """ticker, related: each ticker that stands beside another one, once."""
    pairs = rows.select(F.col(ticker).alias("ticker"), F.explode(clean_tickers(F.col(related))).alias("related"))
    return pairs.where("ticker <> related").distinct()


def latest_briefs(briefs: DataFrame) -> DataFrame:
    """The last revision of each day's brief of an asset and topic."""
    return latest_per(briefs, ["as_of_date", "asset", "topic"], "revision")


def briefs_between(briefs: DataFrame, topic: str | None, since: Column, until: Column) -> DataFrame:
    """The briefs of a topic (or all) in a closed range of days, newest first."""
    asked = briefs.where(F.col("as_of_date").between(since, until))
    asked = asked if topic is None else asked.where(F.col("topic") == topic)
    return latest_briefs(asked).orderBy(F.col("as_of_date").desc(), "topic")


def daily_summary(briefs: DataFrame, day: Column, answer: Callable[..., Column] | None = None) -> DataFrame:
    """as_of_date, title, summary of one day from its briefs' titles, by topic; no row for a day without briefs."""
    titles = briefs.where(F.col("as_of_date") == day).groupBy("as_of_date").agg(F.sort_array(F.collect_list(F.struct("topic", "title"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["title"]), "; ")
    return titles.select("as_of_date", F.concat(F.lit("Summary of "), F.col("as_of_date").cast("string")).alias("title"), (answer(text) if answer else text).alias("summary"))


def anchor_seeds(articles: DataFrame, day: Column, tickers: list[str], collector: str = "gemini") -> DataFrame:
    """The articles of one collector, day and some tickers, with trimmed titles."""
    found = articles.where((F.to_date("published_at") == day) & F.col("ticker").isin(tickers) & (F.col("collector") == collector))
    return found.withColumn("title", F.trim("title"))


def with_articles(links: DataFrame, articles: DataFrame) -> DataFrame:
    """The articles of stories with their role, newest first in each story."""
    return links.join(articles.withColumnRenamed("id", "article_id"), "article_id").withColumnRenamed("article_id", "id").orderBy("story_id", F.col("published_at").desc(), "id")


def filing_chunk(links: DataFrame, filings: DataFrame, chunks: DataFrame) -> DataFrame:
    """The first filing of each story with its first chunk and the filing's title."""
    one = links.groupBy("story_id").agg(F.min("filing_id").alias("filing_id"))
    chunk = chunks.groupBy("filing_id").agg(F.min("chunk_index").alias("chunk_index"))
    filed = filings.select(F.col("id").alias("filing_id"), "form_type", "filed_date")
    title = finance.filing_title(F.col("form_type"), F.col("filed_date"), F.year("filed_date"), fiscal_period(F.col("filed_date"), F.col("form_type")))
    return one.join(filed, "filing_id").join(chunk, "filing_id").withColumn("title", title)


def overnight(stories: DataFrame, since: Column, until: Column, tickers: list[str] | None = None, labels: tuple[str, ...] = ("OVERNIGHT", "MIXED", "UNKNOWN")) -> DataFrame:
    """Stories of some session labels whose latest evidence lies in a closed range (event_time), newest first."""
    found = stories.where(F.col("session_label").isin(*labels))
    found = found.where(F.col("ticker").isin(tickers)) if tickers else found
    timed = found.withColumn("event_time", latest_evidence(F.col("evidence")))
    return timed.where(F.col("event_time").between(since, until)).orderBy(F.col("event_time").desc(), "id")


def large_moves(stories: DataFrame, least: float) -> DataFrame:
    """Overnight stories with an expected move of at least so many per cent, and the move with its sign."""
    sign = F.when(F.col("direction_bias") == "UP", 1.0).when(F.col("direction_bias") == "DOWN", -1.0).otherwise(0.0)
    found = stories.where((F.col("session_label") == "OVERNIGHT") & (F.col("expected_abs_move_pct") >= least))
    return found.withColumn("move", sign * F.col("expected_abs_move_pct"))


def article_key(url: Column, published_at: Column, title: Column) -> Column:
    """What tells articles of a ticker apart: the URL, else time and title."""
    named = F.concat_ws("|", F.date_format(published_at, "yyyy-MM-dd HH:mm:ss"), F.coalesce(title, F.lit("")))
    return F.coalesce(F.nullif(F.trim(url), F.lit("")), named)


def with_fiscal_year(filings: DataFrame) -> DataFrame:
    """Filings whose year and period are filled where they are missing."""
    out = filings.withColumn("fiscal_year", F.coalesce("fiscal_year", F.year("filed_date")))
    period = fiscal_period(F.col("filed_date"), F.col("form_type"))
    return out.withColumn("period", F.coalesce("period", period) if "period" in filings.columns else period)


def with_doc_type(chunks: DataFrame, filings: DataFrame, default: str = "10-K") -> DataFrame:
    """Chunks (filing_id) with the form of their filing; without a filing the default."""
    forms = filings.select(F.col("id").alias("filing_id"), F.col("form_type").alias("doc_type"))
    return chunks.join(forms, "filing_id", "left").withColumn("doc_type", F.coalesce("doc_type", F.lit(default)))


def impact_reports(briefs: DataFrame, portfolios: DataFrame, answer: Callable[..., Column] | None = None) -> DataFrame:
    """One report per day and portfolio: id, as_of_date, portfolio_id, topics, briefs, report_markdown, revision."""
    days = briefs.groupBy("as_of_date").agg(F.count("*").alias("briefs"), F.sort_array(F.collect_list(F.struct("topic", "title"))).alias("t"), F.max("revision").alias("revision"))
    each = days.join(F.broadcast(portfolios), F.lit(True))  # portfolios are a stated set
    text = F.array_join(F.transform("t", lambda x: F.concat(F.lit("- "), x["title"])), "\n")
    key = F.concat_ws("_", F.lit("impact"), F.col("as_of_date").cast("string"), "portfolio_id")
    return each.select(bigint_id(key).alias("id"), "as_of_date", "portfolio_id", F.transform("t", lambda x: x["topic"]).alias("topics"), "briefs", (answer(text) if answer else text).alias("report_markdown"), "revision")


def story_id(day: Column, ticker: Column, seed: Column) -> Column:
    """The same day, ticker and seed give the same number."""
    return bigint_id(joined_key(day, ticker, seed))


def valid_roles(links: DataFrame, roles: tuple[str, ...] = ("PRIMARY", "SUPPORTING", "ANCHOR")) -> DataFrame:
    """Links of known roles; others are left out."""
    return links.where(F.col("role").isin(*roles))


def new_ids(rows: DataFrame, new: Column) -> DataFrame:
    """id, new_id of the rows, those that have theirs already included."""
    return rows.select("id", new.alias("new_id"))


def remapped(rows: DataFrame, moved: DataFrame, column: str) -> DataFrame:
    """Rows whose reference follows to the new ids; references to unknown ids stay."""
    to = moved.select(F.col("id").alias(column), "new_id")
    return rows.join(to, column, "left").withColumn(column, F.coalesce("new_id", column)).drop("new_id")


def changed_symbols(listed: DataFrame, add: list[str] = (), remove: list[str] = ()) -> DataFrame:
    """A watchlist after symbols were added and removed; both in either case."""
    gone = [s.strip().upper() for s in remove]
    new = listed.sparkSession.createDataFrame([(s,) for s in add], "symbol string")
    return symbols(listed.select("symbol").unionByName(new)).where(~F.col("symbol").isin(gone))


def of_missing_days(rows: DataFrame, day: str, since: Column, until: Column, loaded: DataFrame) -> DataFrame:
    """Rows of the days of a closed range that aren't loaded yet."""
    return rows.where(F.col(day).between(since, until)).join(loaded.select(day).distinct(), day, "left_anti")


def duplicate_ids(articles: DataFrame) -> DataFrame:
    """id of the articles that repeat one of a smaller id: ticker, title (case and blanks around don't count) and day."""
    keyed = articles.select("id", "ticker", F.lower(F.trim("title")).alias("t"), F.to_date("published_at").alias("day"))
    kept = keyed.groupBy("ticker", "t", "day").agg(F.min("id").alias("kept"))
    both = keyed.alias("x").join(kept.alias("k"), F.col("x.ticker").eqNullSafe(F.col("k.ticker")) & F.col("x.t").eqNullSafe(F.col("k.t")) & F.col("x.day").eqNullSafe(F.col("k.day")))
    return both.where("id <> kept").select("id")


def tickers_of(texts: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, ticker: known tickers (ticker) that stand in parentheses or as words of their own, in either case, each once."""
    words = texts.select("doc_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.upper(w)))).alias("ticker"))
    return words.join(known, "ticker", "left_semi").select("doc_id", "ticker")


def related_of_answer(answer: Column, known: Column, own: Column) -> Column:
    """Tickers of a model's answer that are known, without the own one, each once."""
    return F.array_except(F.array_intersect(clean_tickers(answer), known), F.array(own))


def question_tickers(questions: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, tickers (sorted, known ones that a question names), macro (true where it names none)."""
    found = tickers_of(questions, known).groupBy("doc_id").agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))
    out = questions.select("doc_id").distinct().join(found, "doc_id", "left")
    tickers = F.coalesce("tickers", F.array().cast("array<string>"))
    return out.select("doc_id", tickers.alias("tickers"), (F.size(tickers) == 0).alias("macro"))
