"""Impact, categories, topics, relevance, filings and trading signals as expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.text import has_any, keyword_count


def impact_of_news(low: Column, high: Iterable[str] = config.HIGH_IMPACT, medium: Iterable[str] = config.MEDIUM_IMPACT) -> Column:
    return F.when(has_any(low, high), "high").when(has_any(low, medium), "medium").otherwise("low")


def impact_of_score(score: Column) -> Column:
    return F.when(score.isNull(), "medium").when(score >= 0.7, "high").when(score >= 0.3, "medium").otherwise("low")


def impact_rank(level: Column) -> Column:
    return F.when(level == "high", 0).when(level == "medium", 1).otherwise(2)


def _first_best(scores: Mapping[str, Column], default: Column | str) -> tuple[Column, Column]:
    """Name and value of the first largest score; default where none is above zero."""
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    name = F.lit(default) if isinstance(default, str) else default
    pick = F.when(top <= 0, name)
    for k, v in scores.items():
        pick = pick.when(v == top, k)
    return pick, top


def category(low: Column, patterns: Mapping[str, Iterable[str]] = config.CATEGORIES, default: str = "company_news") -> Column:
    """The category with most matching words; the first one on ties."""
    return _first_best({k: keyword_count(low, v) for k, v in patterns.items()}, default)[0]


def _score(hits: Column) -> Column:
    return F.when(hits == 0, 25).otherwise(F.least(F.lit(100), 50 + hits * 10))


def topic_scores(low: Column, topics: Mapping[str, Iterable[str]] = config.TOPICS) -> dict[str, Column]:
    """25 without a match, else 50 and 10 for each matching word, 100 at most."""
    return {k: _score(keyword_count(low, words)) for k, words in topics.items()}


def route(low: Column, topics: Mapping[str, Iterable[str]] = config.TOPICS) -> tuple[Column, Column]:
    """Topic and score; the first topic on ties, so a text without any match goes to the first with 25."""
    return _first_best(topic_scores(low, topics), next(iter(topics)))


def with_topic(df: DataFrame, low: Column, topics: Mapping[str, Iterable[str]] = config.TOPICS) -> DataFrame:
    """df with topic and relevance_score as `route` gives them.

    Words are looked for once: scores come from a generator of one row, which no filter on them is pushed through; through
    a projection Spark would push it, with the lower-casing of the text for each word.
    """
    hits = F.array(*(keyword_count(F.col("__low"), words) for words in topics.values()))
    scored = df.withColumn("__low", low).withColumn("__scores", F.explode(F.array(F.transform(hits, _score))))
    named = scored.withColumn("relevance_score", F.array_max("__scores"))
    place = F.array_position("__scores", F.col("relevance_score"))
    return named.withColumn("topic", F.element_at(F.array(*map(F.lit, topics)), place.cast("int"))).drop("__low", "__scores")


def relevance(low: Column, ticker: Column, wanted: Iterable[str], source: Column, age_hours: Column, words: Iterable[str] = config.DEFAULT_KEYWORDS) -> Column:
    """0.4 for a wanted ticker, 0.1 a keyword up to 0.4, 0.1 for a known source, 0.1 under six hours; 1 at most."""
    wanted = list(wanted)
    about = has_any(low, wanted) | F.upper(ticker).isin(*(w.upper() for w in wanted))
    score = F.when(about, 0.4).otherwise(0.0) + F.least(keyword_count(low, words) * 0.1, F.lit(0.4))
    score = score + F.when(has_any(F.lower(source), config.RELIABLE_SOURCES), 0.1).otherwise(0.0) + F.when(age_hours < 6, 0.1).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def sentiment(low: Column) -> Column:
    """(positive - negative) / (positive + negative) words, 1.5 times that for high impact; 0 without any."""
    up, down = keyword_count(low, config.POSITIVE), keyword_count(low, config.NEGATIVE)
    score = (up - down) / F.nullif(up + down, F.lit(0))
    return F.coalesce(score * F.when(impact_of_news(low) == "high", 1.5).otherwise(1.0), F.lit(0.0))


def technical_signal(change: Column, close: Column, support: Column, resistance: Column) -> Column:
    moved = F.when(change > 2, 0.5).when(change > 0, 0.2).when(change < -2, -0.5).when(change < 0, -0.2).otherwise(0.0)
    near = F.when((close == 0) | (support == 0) | (resistance == 0), 0.0).when(close < support * 1.02, 0.3).when(close > resistance * 0.98, -0.3)
    return F.greatest(F.least(moved + F.coalesce(near, F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))


def macro_signal(low: Column) -> Column:
    """What one macro headline adds."""
    rate = F.when(~low.contains("rate"), 0.0).when(low.contains("cut") | low.contains("lower"), 0.3).when(low.contains("hike") | low.contains("raise"), -0.3).otherwise(0.0)
    data = F.when(low.contains("beat") | low.contains("strong"), 0.1).when(low.contains("miss") | low.contains("weak"), -0.1).otherwise(0.0)
    return rate + data


def direction(signals: Mapping[str, Column], at: float = config.DIRECTION_AT) -> tuple[Column, Column]:
    """(buy, sell or hold; score) from the weighted mean of the signals that are not zero."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, value in signals.items():
        w = F.when(F.coalesce(value, F.lit(0.0)) != 0, config.SIGNAL_WEIGHTS.get(name, 0.1)).otherwise(0.0)
        total, weight = total + w * F.coalesce(value, F.lit(0.0)), weight + w
    score = F.coalesce(total / F.nullif(weight, F.lit(0.0)), F.lit(0.0))
    return F.when(score > at, "buy").when(score < -at, "sell").otherwise("hold"), score


def filing_recency(filed: Column, at: Column) -> Column:
    """1 / (1 + years since filing); later filings count as new."""
    return 1 / (1 + F.greatest(F.datediff(at, filed), F.lit(0)) / 365.25)


def filing_priority(form: Column, recency: Column) -> Column:
    return F.when(form == "10-Q", 0.6 + 0.4 * recency).when(form == "10-K", 0.5 + 0.3 * recency).otherwise(0.5)


def filing_title(form: Column, filed: Column, year: Column, period: Column) -> Column:
    """'10-Q · Q3 2024'; without a period the year; without a form 'Filing'."""
    y = F.coalesce(year.cast("string"), F.year(filed).cast("string"))
    tail = F.when(period.isNotNull() & y.isNotNull() & (period != "FY"), F.concat_ws(" ", period, y)).otherwise(y)
    return F.concat_ws(" · ", F.coalesce(form, F.lit("Filing")), tail)


def primary_topic(topics: Column) -> Column:
    """(topic, score) of the largest relevance_score of an array of topics, the first of equal ones; null without a number."""
    scored = F.transform(topics, lambda t, i: F.struct(t["relevance_score"].try_cast("double").alias("score"), (-i).alias("place"), t["topic"].alias("topic")))
    best = F.array_max(F.filter(scored, lambda t: t["score"].isNotNull()))
    return F.struct(best["topic"].alias("topic"), best["score"].alias("score"))
