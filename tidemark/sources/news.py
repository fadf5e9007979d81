"""News sources over recorded payloads: one contract for all, an adapter for each provider's answers.

payloads: source, symbol, body (a provider's answer as text), in a table that Spark reads; stored by source and day, a
window and a list of sources or symbols prune what is read. An adapter turns the bodies of its source into NEWS columns by
expressions; what can't be parsed gives no rows. Times without a zone are UTC.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import FINANCE_WORDS
from tidemark.functions.dates import parse_time
from tidemark.functions.ids import short_id
from tidemark.functions.text import has_any

NEWS = ("id", "ticker", "published_at", "title", "summary", "url", "source", "collector")


def _text(c: Column) -> Column:
    """Trimmed; blank counts as missing."""
    return F.nullif(F.trim(c), F.lit(""))


def day_or_time(raw: Column) -> Column:
    """A time, or noon of a day that stands alone or begins a range of days ('2024-01-05 – 2024-01-07')."""
    first = F.trim(F.element_at(F.split(F.trim(raw), " [–-] "), 1))
    noon = F.try_to_timestamp(F.concat(F.substring(first, 1, 10), F.lit("T12:00:00")))
    return F.when(first.contains("T"), parse_time(first)).otherwise(noon)


def _items(payloads: DataFrame, path: str, schema: str) -> DataFrame:
    """symbol and one row (i) per item of an array in the bodies."""
    return payloads.select(F.upper("symbol").alias("symbol"), F.explode(F.from_json("body", f"struct<{path}:array<struct<{schema}>>>")[path]).alias("i")).select("symbol", "i.*")


def _news(rows: DataFrame, prefix: str, ticker: Column, at: Column, now: Column, key: tuple[Column, ...], summary: Column, url: Column, source: Column) -> DataFrame:
    rows = rows.where(_text(F.col("title")).isNotNull())
    return rows.select(short_id(f"{prefix}_", *key).alias("id"), ticker.alias("ticker"), F.coalesce(at, now.cast("timestamp")).alias("published_at"), F.trim("title").alias("title"), _text(summary).alias("summary"), _text(url).alias("url"), source.alias("source"), F.lit(prefix).alias("collector"))


def massive(payloads: DataFrame, now: Column) -> DataFrame:
    """Items of `results`: the id comes from the item's id and address, else from title and time."""
    rows = _items(payloads, "results", "id:string,title:string,published_utc:string,description:string,article_url:string,amp_url:string,publisher:struct<name:string>")
    named = F.coalesce(F.concat(_text(F.col("id")), F.coalesce("article_url", F.lit(""))), F.concat("title", F.coalesce("published_utc", F.lit(""))))
    return _news(rows, "massive", F.col("symbol"), parse_time(F.col("published_utc")), now, (named,), F.col("description"), F.coalesce(_text(F.col("article_url")), F.col("amp_url")), F.coalesce("publisher.name", F.lit("Massive")))


def marketaux(payloads: DataFrame, now: Column) -> DataFrame:
    """Items of `data`: the ticker is the first entity's symbol, else the one asked for."""
    rows = _items(payloads, "data", "uuid:string,title:string,published_at:string,description:string,snippet:string,url:string,source:string,entities:array<struct<symbol:string,sentiment_score:double>>")
    symbols = F.filter(F.transform("entities", lambda e: F.upper(e["symbol"])), lambda s: s.isNotNull() & (s != ""))
    named = F.coalesce(_text(F.col("uuid")), F.concat("title", F.coalesce("published_at", F.lit(""))))
    return _news(rows, "marketaux", F.coalesce(F.try_element_at(symbols, F.lit(1)), F.col("symbol")), parse_time(F.col("published_at")), now, (named,), F.coalesce(_text(F.col("description")), F.col("snippet")), F.col("url"), F.coalesce("source", F.lit("marketaux.com")))


def financial_datasets(payloads: DataFrame, now: Column) -> DataFrame:
    """Items of `news`, which have no summary; pages of an older end date repeat items, so ids count once."""
    rows = _items(payloads, "news", "title:string,date:string,url:string,source:string")
    out = _news(rows, "fd", F.col("symbol"), day_or_time(F.col("date")), now, (F.col("url"), F.col("title"), F.col("date")), F.lit(None).cast("string"), F.col("url"), F.coalesce("source", F.lit("Financial Datasets")))
    return out.withColumn("collector", F.lit("financial_datasets")).dropDuplicates(["id", "ticker"])


def openai(payloads: DataFrame, now: Column) -> DataFrame:
    """A model's answer: a JSON list, alone or in a fence."""
    body = F.coalesce(_text(F.regexp_extract("body", r"```(?:json)?\s*([\s\S]*?)```", 1)), F.col("body"))
    rows = _items(payloads.withColumn("body", F.concat(F.lit('{"items":'), body, F.lit("}"))), "items", "title:string,summary:string,url:string,source:string,published_at:string")
    return _news(rows, "openai", F.col("symbol"), day_or_time(F.col("published_at")), now, (F.trim("title"), F.col("url"), F.col("published_at"), F.col("symbol")), F.col("summary"), F.col("url"), F.trim(F.coalesce("source", F.lit("OpenAI Generated"))))


def gemini(payloads: DataFrame, now: Column) -> DataFrame:
    """Topics or articles of a model's answer; ranges of days count from their first day."""
    rows = _items(payloads, "topics", "topic:string,title:string,summary:string,sources:array<string>,url:string,source:string,published_at:string")
    rows = rows.withColumn("title", F.coalesce(_text(F.col("topic")), F.col("title"))).withColumn("url", F.coalesce(_text(F.try_element_at("sources", F.lit(1))), F.col("url")))
    return _news(rows, "gemini", F.col("symbol"), day_or_time(F.col("published_at")), now, (F.col("title"), F.col("url"), F.col("published_at"), F.col("symbol")), F.col("summary"), F.col("url"), F.trim(F.coalesce("source", F.lit("Gemini Generated"))))


def newsnow(payloads: DataFrame, now: Column) -> DataFrame:
    """A platform's ranked list (symbol: the platform), as of now, under MACRO; only financial titles stay.

    Whole numbers as titles lose their fraction; an item without a title is named after its rank.
    """
    items = F.from_json("body", "struct<items:array<struct<title:string,url:string,mobileUrl:string>>>")["items"]
    rows = payloads.select("symbol", F.posexplode(items).alias("pos", "i")).select("symbol", (F.col("pos") + 1).alias("rank"), "i.*")
    title = F.regexp_replace(F.trim("title"), r"^(\d+)\.0$", "$1")
    rows = rows.withColumn("title", F.coalesce(_text(title), F.concat(F.lit("News Item "), F.col("rank")))).withColumn("address", F.coalesce(_text(F.col("mobileUrl")), _text(F.col("url"))))
    rows = rows.where(has_any(F.lower("title"), FINANCE_WORDS))
    out = _news(rows, "newsnow", F.lit("MACRO"), now.cast("timestamp"), now, (F.col("address"), F.col("title"), F.col("symbol"), F.col("rank").cast("string")), F.lit(None).cast("string"), F.col("address"), F.col("symbol"))
    return out


ADAPTERS: dict[str, Callable[[DataFrame, Column], DataFrame]] = {
    "massive": massive, "marketaux": marketaux, "financial_datasets": financial_datasets, "openai": openai, "gemini": gemini, "newsnow": newsnow,
}


def collect(payloads: DataFrame, since: Column, until: Column, now: Column, sources: Iterable[str] = tuple(ADAPTERS), symbols: Iterable[str] | None = None) -> DataFrame:
    """News of some sources and symbols in a closed time range; the model-made ones are compared by day."""
    asked = payloads if symbols is None else payloads.where(F.upper("symbol").isin([s.strip().upper() for s in symbols]))
    out = None
    for name in sources:
        found = ADAPTERS[name](asked.where(F.col("source") == name), now).select(*NEWS)
        at, low, high = (F.to_date("published_at"), F.to_date(since), F.to_date(until)) if name == "gemini" else (F.col("published_at"), since.cast("timestamp"), until.cast("timestamp"))
        found = found.where(at.between(low, high))
        out = found if out is None else out.unionByName(found)
    return out


def of_day(payloads: DataFrame, day: Column, now: Column, **how) -> DataFrame:
    """News of one UTC day."""
    start = day.cast("timestamp")
    return collect(payloads, start, start + F.expr("INTERVAL '23:59:59.999999' HOUR TO SECOND"), now, **how)


def to_rows(news: DataFrame) -> DataFrame:
    """News as rows of the table of articles: no address is '', ids are numbers."""
    from tidemark.functions.ids import bigint_id

    return news.select(bigint_id(F.col("id")).alias("id"), "ticker", "published_at", "title", "summary", F.coalesce("url", F.lit("")).alias("url"), "source", "collector")


def health(calls: DataFrame) -> DataFrame:
    """source, available, last_error from calls (source, at, error): a source with an error stays unavailable."""
    last = F.max(F.when(F.col("error").isNotNull(), F.struct("at", "error")))
    out = calls.groupBy("source").agg(last.alias("e"))
    return out.select("source", F.col("e").isNull().alias("available"), F.col("e.error").alias("last_error"))


def metadata(sources: DataFrame, calls: DataFrame) -> DataFrame:
    """Registered sources with their state; a source that was never called is available."""
    state = health(calls).withColumnRenamed("source", "source_id")
    return sources.join(state, "source_id", "left").withColumn("available", F.coalesce("available", F.lit(True)))


def macro_kept(articles: DataFrame, topics: Iterable[str], least: float = 0.9) -> DataFrame:
    """Macro articles, those of one address (else title and time) once, whose main topic is one of `topics` with more than `least`."""
    from tidemark.functions.finance import primary_topic

    key = F.coalesce(_text(F.col("url")), F.concat_ws("|", "title", F.col("published_at").cast("string")))
    first = articles.withColumn("__key", key).groupBy("__key").agg(F.min(F.struct("ord", *[c for c in articles.columns if c != "ord"])).alias("a")).select("a.*")
    best = first.withColumn("__t", primary_topic(F.col("topics")))
    return best.where(F.col("__t.topic").isin(list(topics)) & (F.col("__t.score") > least)).select("*", F.col("__t.topic").alias("primary_topic")).drop("__t")


def todays(rows: DataFrame, existing: DataFrame, now: Column, words: Iterable[str], hours: int = 24) -> DataFrame:
    """Rows of the last hours that have one of the words and a title that no existing row of these days has, each title once."""
    from tidemark.functions.text import both

    key = F.lower(F.trim("title"))
    fresh = rows.where(F.col("published_at").between(now - F.make_dt_interval(F.lit(0), F.lit(hours)), now) & (F.trim("title") != ""))
    fresh = fresh.where(has_any(both(F.col("title"), F.col("summary")), words)).withColumn("__key", key)
    new = fresh.join(existing.select(key.alias("__key")).distinct(), "__key", "left_anti")
    first = new.groupBy("__key").agg(F.min("id").alias("__first"))
    return new.join(first, "__key").where(F.col("id") == F.col("__first")).drop("__key", "__first")


def relevant(rows: DataFrame, words: Iterable[str], least: float = 0.3, model: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """rows with relevant: what a model says of ticker and text; without a model, or where it says nothing, by keywords."""
    from tidemark.functions.text import both, keyword_count

    low = both(F.col("title"), F.col("summary"))
    score = F.lit(0.4) + F.least(keyword_count(low, words) * 0.1, F.lit(0.4))  # the rows are of the ticker that is asked for
    plain = F.least(score, F.lit(1.0)) >= least
    return rows.withColumn("relevant", plain if model is None else F.coalesce(model(F.col("ticker"), low), plain))
