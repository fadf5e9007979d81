"""Dates, business days, sessions, fiscal periods."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import MARKET_HOLIDAYS, MARKET_TZ


def parse_time(raw: Column) -> Column:
    """ISO-8601 text (30 characters at most) as timestamp; without an offset it is UTC; what can't be read is null."""
    text = F.regexp_replace(F.substring(F.trim(raw), 1, 30), "Z$", "+00:00")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm[XXX]")))


def latest_evidence(evidence: Column) -> Column:
    """The latest time of an array of 'published_at=...' entries; entries that can't be read don't count."""
    return F.array_max(F.filter(F.transform(evidence, lambda e: parse_time(F.substring_index(e, "published_at=", -1))), lambda t: t.isNotNull()))


def is_business_day(day: Column, holidays: Iterable[str] = MARKET_HOLIDAYS) -> Column:
    return (F.weekday(day) < 5) & ~F.date_format(day, "yyyy-MM-dd").isin(*holidays)


def market_time(utc: Column) -> Column:
    """A UTC time without zone as New York wall time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(MARKET_TZ), utc)


def is_intraday(utc: Column, holidays: Iterable[str] = MARKET_HOLIDAYS) -> Column:
    """From 9 to before 16 o'clock in New York on a business day."""
    local = market_time(utc)
    return F.hour(local).between(9, 15) & is_business_day(F.to_date(local), holidays)


def last_business_day(day: Column, holidays: Iterable[str] = MARKET_HOLIDAYS, back: int = 10) -> Column:
    """The latest business day up to a day, looked for so many days back."""
    days = F.sequence(F.date_sub(day, back), day)
    return F.array_max(F.filter(days, lambda d: is_business_day(d, holidays)))


def overnight_start(utc: Column, holidays: Iterable[str] = MARKET_HOLIDAYS) -> Column:
    """16 o'clock in New York on the last business day that had closed by then, in UTC."""
    local = market_time(utc)
    day = F.when(F.hour(local) >= 16, F.to_date(local)).otherwise(F.date_sub(F.to_date(local), 1))
    close = F.expr("INTERVAL 16 HOURS") + last_business_day(day, holidays).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(MARKET_TZ), F.lit("UTC"), close)


def fiscal_year(filed: Column) -> Column:
    return F.year(filed)


def fiscal_period(filed: Column, form: Column) -> Column:
    """FY for 10-K, the quarter of the filing month for 10-Q, else null."""
    return F.when(form.startswith("10-K"), "FY").when(form.startswith("10-Q"), F.concat(F.lit("Q"), F.quarter(filed)))


def iso_week(day: Column) -> Column:
    """ISO year and week as one number."""
    return F.extract(F.lit("YEAROFWEEK"), day) * 100 + F.weekofyear(day)


def window_start(until: Column, days: int) -> Column:
    """So many days before a time; from a Monday, Sunday or Saturday the weekend counts on top, so that days with trade remain."""
    extra = F.when(F.weekday(until) == 0, 2).when(F.weekday(until) == 6, 2).when(F.weekday(until) == 5, 1).otherwise(0)
    return F.date_sub(F.to_date(until), F.lit(days) + extra).cast("timestamp_ntz")


def from_market_time(raw: Column) -> Column:
    """New York wall time as text (yyyy-MM-dd HH:mm:ss) in UTC, without zone; what can't be read is null."""
    wall = F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(MARKET_TZ), F.lit("UTC"), wall)
