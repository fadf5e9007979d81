"""Text expressions: keyword counts, languages, cleaning, tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def both(title: Column, summary: Column) -> Column:
    """Title and summary, lower-cased, as keywords are looked for."""
    return F.lower(F.concat_ws(" ", title, F.coalesce(summary, F.lit(""))))


def keyword_count(low: Column, words: Iterable[str]) -> Column:
    """How many of the words occur as substrings of a lower-cased text."""
    return F.size(F.filter(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(low, w)))


def has_any(low: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out


def matched(low: Column, words: Iterable[str], most: int = 10) -> Column:
    """The first `most` of the words that occur, in the order of the list."""
    return F.slice(F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(F.lower(w))), 1, most)


def language_tag(text: Column) -> Column:
    """zh if a CJK ideograph occurs, else en."""
    return F.when(text.rlike("[\\u4e00-\\u9fff]"), "zh").otherwise("en")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def strip_tags(text: Column) -> Column:
    return collapse(F.regexp_replace(text, "<[^>]+>", ""))


def strip_links(text: Column) -> Column:
    """Markdown links reduced to their labels, ellipses and empty brackets dropped."""
    plain = F.regexp_replace(text, "\\[([^\\]]*)\\]\\([^)]*\\)", "$1")
    return collapse(F.regexp_replace(plain, "\\.\\.\\.|…|\\[\\]|\\(\\)", ""))


def looks_like_table(text: Column) -> Column:
    """Two lines or more with the same number of pipes, at least two, or with tabs on all lines but one."""
    lines = F.split(F.trim(text), "\n")
    pipes = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))))
    tabs = F.size(F.filter(lines, lambda x: x.contains("\t")))
    piped = (F.array_min(pipes) >= 2) & (F.array_min(pipes) == F.array_max(pipes))
    return (F.size(lines) >= 2) & (piped | (tabs >= F.greatest(F.size(lines) - 1, F.lit(1))))


def tickers_in(text: Column, known: Iterable[str]) -> Column:
    """Sorted known tickers that stand in parentheses or as words of their own, in either case."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.upper(w))
    return F.array_sort(F.array_intersect(F.array_distinct(words), F.array(*(F.lit(k.upper()) for k in known))))


def vector_of(raw: Column) -> Column:
    """A vector from its text ('[0.1, 0.2]'); what can't be read is null."""
    return F.from_json(raw, "array<double>")


def normalised(text: Column) -> Column:
    """Lower case, single blanks, without common punctuation."""
    return F.regexp_replace(collapse(F.lower(F.coalesce(text, F.lit("")))), "[.,'\"!?:;]", "")
