"""Splitting of long texts, tables and web pages: table functions and Arrow functions over whole texts."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config

#: A heading of a filing's item at the start of a line; what follows its number on the line is its title.
_HEADING = r"(?iU)\n\s*Item\s+(\d+[A-Z]?)\s*[.\s]+([^\n]*)"
#: Signs that stand for nothing in a text: before an item's number, its title and its body.
_MARKS = "\ufdd0\ufdd1\ufdd2"


def chunk_spans(text: str, size: int = config.CHUNK_CHARS, overlap: int = config.CHUNK_OVERLAP) -> Iterator[tuple[int, int]]:
    """Start and end of chunks of about `size` characters, cut after a blank line near the end, else after a space.

    Blank lines and spaces of the text are found once, as ascending offsets; each cut is the last of these in reach.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    line, space = codes == 10, codes == 32
    gaps, spaces = np.flatnonzero(line[:-1] & line[1:]), np.flatnonzero(space)
    begin = 0
    while len(text) - begin > size:
        cuts = [begin + size]
        for offsets, low, high, past in ((gaps, max(begin + 1, begin + size - overlap - 200), begin + size - 1, 2), (spaces, begin + 1, begin + size, 1)):
            last = np.searchsorted(offsets, high, side="right") - 1
            if last >= 0 and offsets[last] >= low:
                cuts.insert(-1, int(offsets[last]) + past)
        yield begin, cuts[0]
        begin = cuts[0] - overlap if cuts[0] - overlap > begin else cuts[0]
    if begin < len(text):
        yield begin, len(text)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def sections(docs: DataFrame) -> DataFrame:
    """id, block, section, text: the blocks of texts of docs (id, text), numbered in order, by the headings of items.

    A heading is 'Item', a number with perhaps a letter, and a dot or blank, in any case; its block is labelled with the
    number in upper case and up to 60 characters of its title. What stands before the first heading has no label, and
    blocks without text are left out.
    """
    number, title, body = _MARKS
    marked = F.regexp_replace(F.translate("text", _MARKS, ""), _HEADING, f"{number}$1{title}$2{body}")
    parts = docs.select("id", F.posexplode(F.split(marked, number)).alias("block", "part"))
    name = _stripped(F.substring_index(F.substring_index("part", body, 1), title, -1))
    short = F.when(F.length(name) > 60, F.concat(F.substring(name, 1, 57), F.lit("..."))).otherwise(name)
    label = F.concat(F.lit("Item "), F.upper(F.substring_index("part", title, 1)), F.when(name != "", F.concat(F.lit(". "), short)).otherwise(""))
    headed = F.col("part").contains(body)
    out = parts.select("id", "block", F.when(headed, label).alias("section"), _stripped(F.when(headed, F.substring_index("part", body, -1)).otherwise(F.col("part"))).alias("text"))
    return out.where("text <> ''")


def chunked(docs: DataFrame, size: int = config.CHUNK_CHARS, overlap: int = config.CHUNK_OVERLAP, by_section: bool = False) -> DataFrame:
    """id, chunk_index, section, chunk of each text of docs (id, text); null and blank texts have none."""
    plain = docs.select("id", F.lit(0).alias("block"), F.lit(None).cast("string").alias("section"), _stripped(F.col("text")).alias("text"))
    kind = dict(docs.dtypes)["id"]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, block, label, text in batch.itertuples(index=False):
                pieces = (text[a:b].strip() for a, b in chunk_spans(text or "", size, overlap))
                rows += [(key, block, k, label, piece) for k, piece in enumerate(p for p in pieces if p)]
            yield pd.DataFrame(rows, columns=["id", "block", "k", "section", "chunk"])

    made = (sections(docs) if by_section else plain).mapInPandas(split, f"id {kind}, block int, k int, section string, chunk string")
    index = F.row_number().over(Window.partitionBy("id").orderBy("block", "k")) - 1 if by_section else F.col("k")  # the chunks of one text
    return made.select("id", index.alias("chunk_index"), "section", "chunk")


def page_ranges(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """First and last page of each chunk (doc, start, end) over pages (doc, page, start, end) that it touches."""
    p = pages.select("doc", "page", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    hit = chunks.join(p, "doc").where((F.col("p_end") > F.col("start")) & (F.col("p_start") < F.col("end")))
    return hit.groupBy("doc", "start", "end").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))


class _Page(HTMLParser):
    """Collects visible text; table rows become lines of cells between pipes."""

    BREAKS = frozenset(("p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "header", "footer", "nav"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.cells = [], 0, None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.hidden += 1
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("")
        elif tag in self.BREAKS and self.cells is None:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "tr" and self.cells is not None:
            self.out.append("\n| " + " | ".join(" ".join(c.split()) for c in self.cells) + " |")
            self.cells = None
        elif tag in self.BREAKS and self.cells is None:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            if self.cells:
                self.cells[-1] += data
            elif self.cells is None:
                self.out.append(data)


def page_text(page: str) -> str:
    reader = _Page()
    reader.feed(page)
    reader.close()
    lines = (" ".join(line.split()) for line in "".join(reader.out).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_text(page: Column) -> Column:
    """Visible text of a web page; null stays null."""
    return F.udf(lambda p: None if p is None else page_text(p), "string", useArrow=False)(page)  # few rows at once, as a page may be long


def unescaped(text: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else html.unescape(t)), "string")(text)


def repaired_json(raw: str | None) -> str | None:
    """The JSON object of a model's answer: fences dropped, cut after the last brace, open brackets closed; else null."""
    if not raw or "{" not in raw:
        return None
    text = re.sub(r"^```(?:json)?|```$", "", raw.strip()).strip()
    text = text[text.index("{") :] if "{" in text else text
    for tried in (text, text[: text.rfind("}") + 1]):
        try:
            return json.dumps(json.loads(tried), sort_keys=True)
        except ValueError:
            pass
    stack, quoted, back = [], False, False
    for c in text:
        if back:
            back = False
        elif c == "\\":
            back = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            stack.append("}" if c == "{" else "]")
        elif not quoted and c in "}]" and stack:
            stack.pop()
    try:
        return json.dumps(json.loads(text.rstrip().rstrip(",") + '"' * quoted + "".join(reversed(stack))), sort_keys=True)
    except ValueError:
        return None


def json_object(raw: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(repaired_json), "string")(raw)


def packed(rows: DataFrame, group: str, order: str, text: str, limit: int = 6000) -> DataFrame:
    """Rows of each group in order while their summed length fits; a piece that is too long is skipped, later ones may fit.

    Groups come to one task in order and are read as a stream, so none is held in memory.
    """

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, used = object(), 0
        for batch in batches:
            keep = []
            for key, n in zip(batch[group], batch["__n"], strict=True):
                if key != last:
                    last, used = key, 0
                fits = used + n <= limit
                used += n * fits
                keep.append(fits)
            yield batch[keep].drop(columns="__n")

    sized = rows.select(group, order, text).withColumn("__n", F.coalesce(F.length(text), F.lit(0)))
    ordered = sized.repartition(group).sortWithinPartitions(group, order)
    kinds = dict(rows.dtypes)
    return ordered.mapInPandas(take, f"{group} {kinds[group]}, {order} {kinds[order]}, {text} {kinds[text]}")


def _bullets(raw: str | None) -> list[str]:
    """Lines of the leaves of a JSON object, in its order; what holds nothing gives none."""

    def lines(label: str, value: object) -> Iterator[str]:
        if isinstance(value, dict):
            flat = "; ".join(f"{k}: {x}" for k, v in value.items() for x in lines("", v))
            yield from [f"{label}: {flat}" if label else flat] if flat else []
        elif isinstance(value, list):
            for x in value:
                yield from lines(label, x)
        elif value is not None and str(value).strip():
            clean = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", str(value))
            clean = " ".join(re.sub(r"\.\.\.|…|\[\]|\(\)", "", clean).split())
            yield from [f"{label}: {clean}" if label else clean] if clean else []

    try:
        found = json.loads(raw or "")
    except ValueError:
        return []
    return [x for k, v in found.items() for x in lines(k.replace("_", " "), v)] if isinstance(found, dict) else []


def bullets(body: Column) -> Column:
    """Bullet lines of a brief's nested JSON; what can't be parsed has none."""
    return F.pandas_udf(lambda s: pd.Series([_bullets(b) for b in s], dtype=object), "array<string>")(body)
