"""The briefing as table rules: directions from five signals, summaries by symbol, rule-made texts, tags."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import finance
from tidemark.functions.text import both, has_any


def macro_signals(events: DataFrame) -> DataFrame:
    """One row: signal, what macro headlines (low: lower-cased) add up to, within -1 and 1."""
    total = F.coalesce(F.sum(finance.macro_signal(F.col("low"))), F.lit(0.0))
    return events.agg(F.greatest(F.least(total, F.lit(1.0)), F.lit(-1.0)).alias("signal"))


def directions(symbols: DataFrame, news: DataFrame, technical: DataFrame, sentiment: DataFrame, filings: DataFrame, macro: DataFrame) -> DataFrame:
    """ticker, direction, score, confidence, drivers (up to five, the strongest first) for symbols (ticker).

    news, filings: ticker, signal; sentiment: ticker, score; macro: one row, which counts for every symbol. Signals that are
    missing or 0 have no weight.
    """
    levels = technical.select("ticker", finance.technical_signal(F.col("change_percent"), F.col("close"), F.col("support"), F.col("resistance")).alias("technical"))
    out = symbols.join(news.select("ticker", F.col("signal").alias("news_sentiment")), "ticker", "left").join(levels, "ticker", "left")
    out = out.join(sentiment.select("ticker", F.col("score").alias("market_sentiment")), "ticker", "left").join(filings.select("ticker", F.col("signal").alias("sec_filings")), "ticker", "left")
    out = out.join(F.broadcast(macro.select(F.col("signal").alias("macro"))), F.lit(True))  # one row
    names = ("news_sentiment", "technical", "market_sentiment", "sec_filings", "macro")
    name, score = finance.direction({k: F.col(k) for k in names})
    ranked = F.sort_array(F.array(*(F.struct(F.abs(F.coalesce(k, F.lit(0.0))).alias("size"), F.lit(k).alias("name")) for k in names)), asc=False)
    drivers = F.transform(F.filter(ranked, lambda x: x["size"] > 0), lambda x: x["name"])
    return out.select("ticker", name.alias("direction"), score.alias("score"), F.least(F.abs(score), F.lit(1.0)).alias("confidence"), drivers.alias("drivers"))


def stock_summaries(directions: DataFrame, news: DataFrame, filings: DataFrame, technical: DataFrame, sentiment: DataFrame) -> DataFrame:
    """directions with counts of news and filings, levels, and the warnings that hold for the symbol."""
    counted = news.groupBy("ticker").agg(F.count("*").alias("news_count"))
    filed = filings.groupBy("ticker").agg(F.count("*").alias("filings_count"), F.bool_or(F.col("impact") == "high").alias("__high"))
    out = directions.join(counted, "ticker", "left").join(filed, "ticker", "left")
    out = out.join(technical.select("ticker", "support", "resistance", "volatility"), "ticker", "left").join(sentiment.select("ticker", F.col("score").alias("sentiment")), "ticker", "left")
    warnings = F.array_compact(F.array(F.when(F.col("__high"), "High-impact SEC filing detected"), F.when(F.col("volatility") > 3, "High volatility warning"), F.when(F.col("sentiment") < -0.3, "Negative social sentiment")))
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("news_count", "filings_count")}
    return out.withColumns(counts | {"risk_warnings": warnings}).drop("__high")


def rule_summary(news: DataFrame, filings: DataFrame, directions: DataFrame, most: int = 3) -> DataFrame:
    """One row: counts (of high-impact news and filings, as text), buys, sells, bullish and bearish (the first symbols)."""
    first = lambda d: F.array_join(F.slice(F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.col("ticker")))), 1, most), ", ")
    n = news.agg(F.count("*").alias("n"))
    f = filings.agg(F.count("*").alias("f"))
    d = directions.agg(F.count_if(F.col("direction") == "buy").alias("buys"), F.count_if(F.col("direction") == "sell").alias("sells"), first("buy").alias("bullish"), first("sell").alias("bearish"))
    text = F.concat_ws(", ", F.when(F.col("n") > 0, F.concat("n", F.lit(" high-impact news items"))), F.when(F.col("f") > 0, F.concat("f", F.lit(" important SEC filings"))))
    return n.join(f, F.lit(True)).join(d, F.lit(True)).withColumn("counts", F.when(text == "", "normal market conditions").otherwise(text))


def items_summary(items: DataFrame, order: str, most: int = 5) -> DataFrame:
    """One row: summary (how many items) and key_points, the first titles, 100 characters each."""
    total = items.agg(F.count("*").alias("n"))
    top = items.orderBy(order).limit(most).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "title"))), lambda x: F.concat(F.lit("• "), F.substring(x["title"], 1, 100))).alias("key_points"))
    text = F.when(F.col("n") == 0, "No items to summarize.").otherwise(F.concat(F.lit("Summary of "), "n", F.lit(" items.")))
    return total.join(top, F.lit(True)).select(text.alias("summary"), "key_points")


def context(parts: Mapping[str, tuple[DataFrame, Column, int]], order: str) -> DataFrame:
    """One row: context, the first lines of each part (rows, line, how many) under its heading; empty parts are left out."""
    out = None
    for k, (heading, (rows, line, most)) in enumerate(parts.items()):
        top = rows.orderBy(order).limit(most).select(F.lit(k).alias("k"), F.lit(heading).alias("h"), F.col(order).alias("o"), line.alias("line"))
        out = top if out is None else out.unionByName(top)
    lines = out.groupBy("k", "h").agg(F.sort_array(F.collect_list(F.struct("o", "line"))).alias("l"))
    text = F.concat_ws("\n", "h", F.transform("l", lambda x: F.concat(F.lit("  - "), x["line"])))
    return lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", text.alias("t")))), lambda x: x["t"]), "\n").alias("context"))


def news_of_symbols(news: DataFrame, symbols: DataFrame) -> DataFrame:
    """News that name one of the symbols (a stated set: symbol) or have its ticker, each once, with the first such symbol."""
    low = both(F.col("title"), F.col("summary"))
    wanted = sorted(r["symbol"] for r in symbols.collect())
    first = F.coalesce(*(F.when(low.contains(s.lower()) | (F.upper("ticker") == s), s) for s in wanted))
    return news.withColumn("symbol", first).where("symbol IS NOT NULL")


def tagged_events(events: DataFrame, title: Column, words: Mapping[str, Iterable[str]]) -> DataFrame:
    """Macro events whose impact is overridden by the first level with a word in the title; others keep theirs."""
    low, impact = F.lower(title), None
    for level, listed in words.items():
        impact = (F.when if impact is None else impact.when)(has_any(low, listed), level)
    return events.withColumn("impact", impact.otherwise(F.col("impact")))


def categorised(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of several kinds in one table with their category."""
    out = None
    for name, df in tables.items():
        part = df.withColumn("category", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
