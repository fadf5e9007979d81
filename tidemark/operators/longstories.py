"""Long stories and model answers as table rules: gates, merges, refreshes, repairs, and queues of missing work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import iso_week
from tidemark.operators import vectors as vec
from tidemark.operators.tables import top_per

#: Values of the session and direction of a story; others count as unknown and neutral.
SESSIONS, BIASES = ("OVERNIGHT", "INTRADAY", "MIXED", "UNKNOWN"), ("UP", "DOWN", "NEUTRAL", "MIXED")
_TEXT = ("title", "summary", "session_label", "direction_bias", "risk_horizon", "estimated_filing_date_et")
_NUMBERS = ("session_confidence", "risk_confidence", "prob_move_ge_1pct", "prob_move_ge_2pct", "expected_abs_move_pct")
_LISTS = ("topics", "event_time_evidence", "risk_drivers", "risk_caveats", "filing_form_types", "filing_signals")


def story_of(answer: Column) -> Column:
    """A model's JSON as the columns of a story: texts trimmed, lists empty unless they are lists, unknown values defaulted."""
    field = lambda c: F.get_json_object(answer, f"$.{c}")
    blank = lambda c: F.coalesce(F.trim(field(c)), F.lit(""))
    listed = lambda c: F.coalesce(F.from_json(field(c), "array<string>"), F.array().cast("array<string>"))
    within = lambda c, values, default: F.when(F.upper(blank(c)).isin(*values), F.upper(blank(c))).otherwise(default)
    number = {c: field(c).try_cast("double") for c in _NUMBERS}
    number |= {c: F.coalesce(number[c], F.lit(0.0)) for c in ("session_confidence", "risk_confidence")}
    day = F.substring(blank("estimated_filing_date_et"), 1, 10)
    return F.struct(
        blank("title").alias("title"), blank("summary").alias("summary"), F.nullif(blank("risk_horizon"), F.lit("")).alias("risk_horizon"),
        within("session_label", SESSIONS, "UNKNOWN").alias("session_label"), within("direction_bias", BIASES, "NEUTRAL").alias("direction_bias"),
        F.when(day.rlike(r"^.{4}-.{2}-.{2}$"), day).alias("estimated_filing_date_et"), F.coalesce(field("is_filing_related").try_cast("boolean"), F.lit(False)).alias("is_filing_related"),
        *(v.alias(c) for c, v in number.items()), *(listed(c).alias(c) for c in _LISTS),
    )


def synthesis_of(raw: Column, title: Column) -> Column:
    """title, summary, summary_bullets, coverage_gap of a model's brief, alone or in a fence; else the given title and a gap."""
    fenced = F.nullif(F.regexp_extract(raw, r"```(?:json)?\s*([\s\S]*?)```", 1), F.lit(""))
    body = F.from_json(F.coalesce(fenced, raw), "struct<title:string,summary:string,summary_bullets:array<string>,coverage_gap:boolean>")
    known = body["title"].isNotNull()
    return F.struct(F.when(known, body["title"]).otherwise(title).alias("title"), F.coalesce(body["summary"], F.lit("")).alias("summary"), F.coalesce(body["summary_bullets"], F.array().cast("array<string>")).alias("summary_bullets"), F.when(known, F.coalesce(body["coverage_gap"], F.lit(False))).otherwise(True).alias("coverage_gap"))


def young_enough(rows: DataFrame, filed: str, at: str, days: int) -> DataFrame:
    """Rows whose date lies at most so many days before their story's, and not after it."""
    return rows.where(F.datediff(at, filed).between(0, days))


def date_range(day: Column) -> Column:
    """'first – last' of the days of a group, or the one day."""
    low, high = F.min(day).cast("string"), F.max(day).cast("string")
    return F.when(low == high, low).otherwise(F.concat_ws(" – ", low, high))


def merge_or_create(asked: DataFrame, long: DataFrame, history: DataFrame, threshold: float, weeks: int) -> DataFrame:
    """story_id, action, long_story_id of stories (id, ticker, u; a stated set).

    'merge' with the most similar long story of the ticker that is above the threshold; else 'create' if the ticker's
    history spans enough ISO weeks; else 'none'.
    """
    near = vec.best_above(long, vec.as_queries(asked, "ticker"), threshold).select(F.col("query_id").alias("story_id"), F.col("id").alias("long_story_id"))
    spans = history.groupBy("ticker").agg((F.countDistinct(iso_week(F.col("published_at"))) >= weeks).alias("enough"))
    out = asked.select(F.col("id").alias("story_id"), "ticker").join(near, "story_id", "left").join(spans, "ticker", "left")
    return out.withColumn("action", F.when(F.col("long_story_id").isNotNull(), "merge").when(F.col("enough"), "create").otherwise("none"))


def refreshed(links: DataFrame, articles: DataFrame, most: int = 30) -> DataFrame:
    """story_id, links, titles (newest first) of the newest linked articles of each story, as a model would be given."""
    known = links.join(articles.select(F.col("id").alias("article_id"), "published_at", "title"), "article_id")
    top = top_per(known, ["story_id"], [F.col("published_at").desc(), F.col("article_id")], most, rank="rank")
    out = top.groupBy("story_id").agg(F.count("*").alias("links"), F.sort_array(F.collect_list(F.struct("rank", "title"))).alias("t"))
    return out.select("story_id", "links", F.transform("t", lambda x: x["title"]).alias("titles"))


def anchors(links: DataFrame) -> DataFrame:
    """story_id, anchor_id: the first article with the role ANCHOR, else the first of all."""
    first = F.coalesce(F.min(F.when(F.col("role") == "ANCHOR", F.col("article_id"))), F.min("article_id"))
    return links.groupBy("story_id").agg(first.alias("anchor_id"))


def with_vectors(rows: DataFrame, column: str, text: Column, embed: Callable[[Column], Column]) -> DataFrame:
    """Rows with the missing vectors computed; those that have one don't reach the model."""
    missing = rows.where(F.col(column).isNull()).withColumn(column, embed(text))
    return rows.where(F.col(column).isNotNull()).unionByName(missing)


def days_without(spark: SparkSession, first: str, last: str, had: DataFrame) -> DataFrame:
    """The days of a closed range that `had` (day) has no row for."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.join(had.select("day").distinct(), "day", "left_anti")


def query_text(items: DataFrame, group: str, order: str, most: int = 15, size: int = 1200) -> DataFrame:
    """group, text: titles and summaries of the first items of a group, cut to a length."""
    top = top_per(items, [group], [F.col(order)], most, rank="rank")
    out = top.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("rank", F.concat_ws(" ", "title", "summary").alias("t")))).alias("t"))
    return out.select(group, F.substring(F.array_join(F.transform("t", lambda x: x["t"]), " "), 1, size).alias("text"))


def raw_items(articles: DataFrame, day: Column) -> DataFrame:
    """Articles with a title as rows of the table of raw items."""
    kept = articles.where(F.trim("title") != "")
    return kept.select("id", day.alias("as_of_date"), "title", "summary", *(F.col(c) for c in ("url", "source", "published_at", "collector") if c in articles.columns))


def story_text(title: Column, topics: Column, summary: Column) -> Column:
    """What is embedded of a story: title, topics and summary on lines of their own, missing ones left out."""
    return F.concat_ws("\n", F.nullif(F.trim(title), F.lit("")), F.nullif(F.array_join(topics, ", "), F.lit("")), F.nullif(F.trim(summary), F.lit("")))
