"""Feeds, filing indexes and provider answers as typed tables.

Payloads are read with Spark's readers, one row each (`payloads`), and parsed by expressions or Arrow functions, so each
parser runs on recorded payloads as well as on fresh ones. What can't be parsed gives no rows.
"""

from __future__ import annotations

import re
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import parse_time
from tidemark.functions.ids import short_id
from tidemark.functions.text import language_tag, strip_tags
from tidemark.operators.chunks import unescaped

ENTRY = "array<struct<title:string,url:string,published:string,summary:string,author:string>>"


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """path, body of the files of a folder, one row each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def is_json_feed(body: Column) -> Column:
    return F.ltrim(body).startswith("{") & body.contains("jsonfeed.org")


def json_feed_entries(body: Column) -> Column:
    """Entries of a JSON feed; a missing title is the start of the text, 100 characters at most."""
    kind = "struct<items:array<struct<title:string,url:string,external_url:string,date_published:string,date_modified:string,content_text:string,content_html:string,summary:string,author:struct<name:string>,authors:array<struct<name:string>>>>>"
    text = lambda i: F.coalesce(i["summary"], i["content_text"], strip_tags(i["content_html"]))
    title = lambda i: F.coalesce(F.nullif(F.trim(i["title"]), F.lit("")), F.when(F.length(text(i)) > 100, F.concat(F.substring(text(i), 1, 100), F.lit("..."))).otherwise(text(i)))
    author = lambda i: F.coalesce(i["author"]["name"], F.array_join(F.transform(i["authors"], lambda a: a["name"]), ", "))
    entry = lambda i: F.struct(title(i).alias("title"), F.coalesce(i["url"], i["external_url"]).alias("url"), F.coalesce(i["date_published"], i["date_modified"]).alias("published"), text(i).alias("summary"), author(i).alias("author"))
    return F.transform(F.from_json(body, kind)["items"], entry)


def _xml_entries(body: str | None) -> list[dict] | None:
    try:
        root = ElementTree.fromstring(body.strip().encode())
    except (ElementTree.ParseError, AttributeError):
        return None
    out = []
    for node in root.iter():
        if node.tag.rpartition("}")[2] in ("item", "entry"):
            found: dict[str, str] = {}
            for child in node.iter():
                name, value = child.tag.rpartition("}")[2], (child.text or "").strip()
                value = value or (child.get("href") or "" if name == "link" else "")
                if value:
                    found.setdefault(name, value)
            raw = next((found[k] for k in ("pubDate", "published", "updated", "date") if k in found), None)
            try:
                raw = parsedate_to_datetime(raw).isoformat() if raw else None
            except (TypeError, ValueError):
                pass
            out.append({"title": found.get("title"), "url": found.get("link") or found.get("guid") or found.get("id"), "published": raw, "summary": found.get("description") or found.get("summary") or found.get("content"), "author": found.get("creator") or found.get("name") or found.get("author")})
    return out


def xml_entries(body: Column) -> Column:
    """Entries of an RSS or Atom feed."""
    return F.udf(_xml_entries, ENTRY, useArrow=False)(body)  # few rows at once, as a feed may be long


def feed_news(feeds: DataFrame, now: Column, max_age_days: int = 7) -> DataFrame:
    """News of feeds (body, source, ticker): id, ticker, title, summary, url, source, author, published_at, language.

    Without a date that can be read, an item counts as of `now`; older and future items are left out.
    """
    entries = F.when(is_json_feed(F.col("body")), json_feed_entries(F.col("body"))).otherwise(xml_entries(F.col("body")))
    rows = feeds.select("source", "ticker", F.explode(entries).alias("e")).select("source", "ticker", "e.*")
    rows = rows.withColumn("title", strip_tags(unescaped(F.col("title")))).withColumn("summary", strip_tags(unescaped(F.col("summary"))))
    rows = rows.withColumn("published_at", F.coalesce(parse_time(F.col("published")), now)).where(F.col("title").isNotNull())
    fresh = rows.where((F.col("published_at") <= now) & (F.col("published_at") >= now - F.make_dt_interval(F.lit(max_age_days))))
    return fresh.select(short_id("feed_", F.col("url"), F.col("title")).alias("id"), "ticker", "title", "summary", "url", "source", "author", "published_at", language_tag(F.col("title")).alias("language"))


def filing_index(lines: DataFrame, forms: list[str] | None = None) -> DataFrame:
    """form_type, company, cik, filed_date, path of the fixed-width lines (value) of a form index; other lines drop out."""
    cut = lambda a, b: F.trim(F.substring("value", a + 1, b - a))
    rows = lines.select(cut(0, 12).alias("form_type"), cut(12, 74).alias("company"), F.try_to_number(cut(74, 86), F.lit("999999999999")).cast("long").alias("cik"), F.try_to_date(cut(86, 98), "yyyy-MM-dd").alias("filed_date"), F.trim(F.substring("value", 99, 200)).alias("path"))
    rows = rows.where(F.col("cik").isNotNull() & F.col("filed_date").isNotNull())
    return rows.where(F.col("form_type").isin(forms)) if forms else rows


def padded_cik(cik: Column) -> Column:
    return F.lpad(cik.cast("string"), 10, "0")


def company_filings(bodies: DataFrame, since: Column, until: Column, most: int = 100) -> DataFrame:
    """ticker, form_type, filed_date, accession, document, impact from a company's answer of parallel arrays (ticker, body)."""
    kind = "struct<filings:struct<recent:struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>,primaryDocument:array<string>>>>"
    recent = F.from_json("body", kind)["filings"]["recent"]
    zipped = F.slice(F.arrays_zip(recent["form"].alias("form"), recent["filingDate"].alias("filed"), recent["accessionNumber"].alias("accession"), recent["primaryDocument"].alias("document")), 1, most)
    rows = bodies.select("ticker", F.explode(zipped).alias("f")).select("ticker", F.col("f.form").alias("form_type"), F.try_to_date("f.filed", "yyyy-MM-dd").alias("filed_date"), "f.accession", "f.document")
    return rows.where(F.col("filed_date").between(since, until)).withColumn("impact", filing_impact(F.col("form_type")))


def filing_impact(form: Column) -> Column:
    return F.when(form.startswith("8-K") | form.startswith("10-K") | form.startswith("10-Q"), "high").when(form.startswith("4") | form.startswith("13"), "medium").otherwise("low")


def ticker_news(bodies: DataFrame, wanted: list[str], since: Column, until: Column) -> DataFrame:
    """News of a provider's feed (body): the first wanted ticker of each item that names one, in a closed time range."""
    kind = "struct<feed:array<struct<title:string,url:string,time_published:string,summary:string,source:string,ticker_sentiment:array<struct<ticker:string>>>>>"
    rows = bodies.select(F.explode(F.from_json("body", kind)["feed"]).alias("f")).select("f.*")
    named = F.filter(F.transform("ticker_sentiment", lambda t: F.upper(F.trim(t["ticker"]))), lambda t: t.isin(*(w.upper() for w in wanted)))
    rows = rows.withColumn("ticker", F.try_element_at(named, F.lit(1))).withColumn("published_at", F.try_to_timestamp("time_published", F.lit("yyyyMMdd'T'HHmmss")))
    rows = rows.where(F.col("ticker").isNotNull() & F.col("published_at").between(since, until))
    return rows.select(short_id("av_", F.col("url"), F.col("time_published")).alias("id"), "ticker", "title", "summary", "url", "source", "published_at")


def quote(body: Column) -> Column:
    """Price and change of a quote answer; percent signs go and 0 counts as missing."""
    field = lambda name: F.nullif(F.try_to_number(F.regexp_replace(F.get_json_object(body, f"$['Global Quote']['{name}']"), "[%+]", ""), F.lit("S999999999D999999")).cast("double"), F.lit(0.0))
    return F.struct(field("05. price").alias("price"), field("10. change percent").alias("change_percent"))


def latest_with_previous(series: DataFrame) -> DataFrame:
    """series (indicator, day, value): the last value of each indicator and the one before."""
    w = Window.partitionBy("indicator").orderBy(F.col("day").desc())
    return series.withColumn("n", F.row_number().over(w)).withColumn("previous", F.lead("value").over(w)).where("n = 1").drop("n")


_BLOCK = re.compile(r"\*+\s*(Title|Summary|Source|Date)\s*:?\s*\*+\s*:?\s*(.+)", re.IGNORECASE)


def _markdown(body: str | None) -> list[dict]:
    out: list[dict] = []
    for m in _BLOCK.finditer(body or ""):
        key = m[1].lower()
        if key == "title" or not out:
            out.append({})
        out[-1][key] = m[2].strip().strip("*: ").strip()
    return [{k: x.get(k) for k in ("title", "summary", "source", "date")} for x in out if x.get("title")]


def markdown_articles(body: Column) -> Column:
    """Articles of a model's answer in blocks of *Title*, *Summary*, *Source*, *Date*."""
    return F.pandas_udf(lambda s: pd.Series([_markdown(b) for b in s], dtype=object), "array<struct<title:string,summary:string,source:string,date:string>>")(body)


def hot_list(bodies: DataFrame, now: Column) -> DataFrame:
    """Ranked items (rank from 1) of a platform's list (platform, body), as of `now`, under the ticker MACRO."""
    items = F.from_json("body", "struct<items:array<struct<id:string,title:string,url:string>>>")["items"]
    rows = bodies.select("platform", F.posexplode(items).alias("pos", "i"))
    return rows.select(short_id("hot_", F.col("i.url"), F.col("i.title")).alias("id"), F.lit("MACRO").alias("ticker"), (F.col("pos") + 1).alias("rank"), "i.title", "i.url", F.col("platform").alias("source"), now.alias("published_at"))


def months(first: Column, last: Column) -> Column:
    """The first days of the months of a range, both ends included."""
    return F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("INTERVAL 1 MONTH"))


def buckets(first: Column, last: Column, days: int = 15) -> Column:
    """(start, end) of ranges of so many days that cover first to last."""
    starts = F.sequence(first, last, F.make_dt_interval(F.lit(days)))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.date_add(s, days - 1), last).alias("end")))


def registered(sources: DataFrame, kinds: tuple[str, ...] = ("news", "multi")) -> DataFrame:
    """Enabled sources of some kinds, by priority, from a table (source_id, enabled, priority, source_type)."""
    return sources.where(F.col("enabled") & F.col("source_type").isin(*kinds)).orderBy("priority", "source_id")


def recent_filers(lines: DataFrame, tickers: DataFrame, since: Column, until: Column, forms: list[str] | None = None) -> DataFrame:
    """Tickers (cik, ticker) with a filing in a closed range of days in form index lines, each once."""
    found = filing_index(lines, forms).where(F.col("filed_date").between(since, until))
    return found.select("cik").distinct().join(tickers, "cik").select("ticker").distinct()


def requests(feeds: DataFrame, symbols: DataFrame) -> DataFrame:
    """url, ticker, source: each feed (source, url, perhaps with {symbol}) for each symbol (ticker); both are stated sets."""
    each = symbols.join(F.broadcast(feeds.select("source", F.col("url").alias("template"))), F.lit(True))
    return each.select(F.replace("template", F.lit("{symbol}"), F.col("ticker")).alias("url"), "ticker", "source")
