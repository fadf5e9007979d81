"""Bars, technical levels and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import finance
from tidemark.functions.text import both


def bars(ticks: DataFrame, width: str = "5 minutes") -> DataFrame:
    """ticker, start, open, high, low, close, volume of tumbling windows; ties of time by event_id. Map-side partial sums."""
    order = F.struct("ts", "event_id")
    out = ticks.groupBy("ticker", F.window("ts", width).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.count("*").alias("volume"),
    )
    return out.select("ticker", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def volume_flags(bars: DataFrame) -> DataFrame:
    """Adds rising: close at or over the close before (the first bar: its open)."""
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("start"))
    return bars.withColumn("rising", F.col("close") >= F.coalesce(before, "open"))


def trailing_volume(bars: DataFrame, n: int = 21) -> DataFrame:
    """Adds mean_volume over the last n bars."""
    return bars.withColumn("mean_volume", F.avg("volume").over(Window.partitionBy("ticker").orderBy("start").rowsBetween(1 - n, 0)))


def visible_return(bars: DataFrame) -> DataFrame:
    """ticker, change and percent from the first open to the last close."""
    out = bars.groupBy("ticker").agg(F.min_by("open", "start").alias("first_open"), F.max_by("close", "start").alias("last_close"))
    return out.select("ticker", (F.col("last_close") - F.col("first_open")).alias("change"), ((F.col("last_close") - F.col("first_open")) / F.col("first_open") * 100).alias("percent"))


def technical(bars: DataFrame) -> DataFrame:
    """The latest bar of a ticker with its change against the one before, support, resistance and volatility."""
    w = Window.partitionBy("ticker").orderBy(F.col("start").desc())
    last = bars.withColumn("n", F.row_number().over(w)).withColumn("previous", F.lead("close").over(w)).where("n = 1")
    return last.select(
        "ticker", "start", "close",
        ((F.col("close") - F.col("previous")) / F.nullif(F.col("previous"), F.lit(0.0)) * 100).alias("change_percent"),
        (F.col("low") * 0.98).alias("support"), (F.col("high") * 1.02).alias("resistance"),
        ((F.col("high") - F.col("low")) / F.nullif(F.col("close"), F.lit(0.0)) * 100).alias("volatility"),
    )


def volatility(bars: DataFrame) -> DataFrame:
    """Yearly volatility of a ticker from its daily returns."""
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("start"))
    returns = bars.withColumn("r", F.col("close") / F.nullif(before, F.lit(0.0)) - 1)
    return returns.groupBy("ticker").agg((F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("volatility"))


def news_signal(articles: DataFrame) -> DataFrame:
    """ticker, signal: summed sentiment over all items of a ticker, within -1 and 1."""
    score = finance.sentiment(both(F.col("title"), F.col("summary")))
    out = articles.withColumn("s", score).groupBy("ticker").agg((F.sum("s") / F.count("*")).alias("signal"), F.count("*").alias("items"))
    return out.withColumn("signal", F.greatest(F.least("signal", F.lit(1.0)), F.lit(-1.0)))


def filing_signal(filings: DataFrame) -> DataFrame:
    """ticker, signal from filings (impact, description): high ones count -0.1, acquisitions 0.2, within -1 and 1."""
    part = F.when(F.col("impact") != "high", 0.0).when(F.lower(F.coalesce("description", F.lit(""))).contains("acquisition"), 0.2).otherwise(-0.1)
    return filings.groupBy("ticker").agg(F.greatest(F.least(F.sum(part), F.lit(1.0)), F.lit(-1.0)).alias("signal"))


def trading_direction(technical: DataFrame, news: DataFrame, filings: DataFrame | None = None) -> DataFrame:
    """ticker, direction, score, confidence from technical levels, news and filing signals."""
    out = technical.withColumn("technical", finance.technical_signal(F.col("change_percent"), F.col("close"), F.col("support"), F.col("resistance")))
    out = out.join(news.select("ticker", F.col("signal").alias("news_sentiment")), "ticker", "full")
    signals = {"technical": F.col("technical"), "news_sentiment": F.col("news_sentiment")}
    if filings is not None:
        out = out.join(filings.select("ticker", F.col("signal").alias("sec_filings")), "ticker", "full")
        signals["sec_filings"] = F.col("sec_filings")
    name, score = finance.direction(signals)
    return out.select("ticker", name.alias("direction"), score.alias("score"), F.least(F.abs(score), F.lit(1.0)).alias("confidence"))


def expected_move(stories: DataFrame) -> DataFrame:
    """ticker, move, label from stories (ticker, bias, move, confidence): mean signed move, weighted by confidence if above 0."""
    sign = F.when(F.col("bias") == "UP", 1.0).when(F.col("bias") == "DOWN", -1.0).otherwise(0.0)
    w = F.when(F.col("confidence") > 0, F.col("confidence")).otherwise(1.0)
    out = stories.where(F.col("move").isNotNull()).groupBy("ticker").agg((F.sum(sign * F.col("move") * w) / F.sum(w)).alias("move"))
    return out.withColumn("label", F.when(F.abs("move") < 0.1, "Neutral").when(F.col("move") > 0, "Up").otherwise("Down"))


def briefing(directions: DataFrame, technical: DataFrame) -> DataFrame:
    """One row: counts of directions and which warnings hold."""
    d = directions.agg(F.count("*").alias("n"), F.count_if(F.col("direction") == "buy").alias("buys"), F.count_if(F.col("direction") == "sell").alias("sells"))
    t = technical.agg(F.count_if(F.col("volatility") > 3).alias("volatile"))
    return d.join(t, F.lit(True)).select("n", "buys", "sells", "volatile", (F.col("sells") > F.col("n") / 2).alias("mostly_sell"), (F.col("volatile") > 2).alias("high_volatility"))


def sources_merged(articles: DataFrame, priority: DataFrame, per_source: int) -> DataFrame:
    """At most per_source rows of each source, the newest, with priority (999 if unknown), first by priority, then newest."""
    w = Window.partitionBy("source").orderBy(F.col("published_at").desc(), "id")
    kept = articles.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_source).drop("n")
    known = kept.join(F.broadcast(priority), "source", "left").withColumn("priority", F.coalesce("priority", F.lit(999)))
    return known.orderBy("priority", F.col("published_at").desc(), "id")


def bars_between(ticks: DataFrame, width: str, since: Column, until: Column) -> DataFrame:
    """Bars of some width over a closed time range; the range reaches the scan."""
    return bars(ticks.where((F.col("ts") >= since) & (F.col("ts") <= until)), width)


def snapshots(days: DataFrame, trades: DataFrame, market_open: Column) -> DataFrame:
    """symbol, price, daily_close, previous_close, change, change_percent, extended_change, extended_change_percent.

    days: daily bars; trades: ticker, trade (its last price, null: the close). The change of the day is 0 without a close
    before; changes after hours are null while the market is open.
    """
    top = F.sort_array(F.collect_list(F.struct("start", "close")), asc=False)
    w = Window.partitionBy("ticker").orderBy(F.col("start").desc())
    two = days.withColumn("n", F.row_number().over(w)).where("n <= 2").groupBy("ticker").agg(top.alias("d"))
    rows = two.select(F.col("ticker"), F.try_element_at("d", F.lit(1))["close"].alias("close"), F.try_element_at("d", F.lit(2))["close"].alias("previous")).join(trades, "ticker", "left")
    price = F.coalesce("trade", "close")
    moved = F.when(F.col("previous") > 0, F.col("close") - F.col("previous")).otherwise(0.0)
    after = F.when(~market_open & (F.col("close") > 0), price - F.col("close"))
    return rows.select(
        F.col("ticker").alias("symbol"), F.round(price, 2).alias("price"), F.round("close", 2).alias("daily_close"), F.round("previous", 2).alias("previous_close"),
        F.round(moved, 2).alias("change"), F.round(F.coalesce(moved / F.nullif(F.col("previous"), F.lit(0.0)) * 100, F.lit(0.0)), 2).alias("change_percent"),
        F.round(after, 2).alias("extended_change"), F.round(after / F.col("close") * 100, 2).alias("extended_change_percent"),
    )
