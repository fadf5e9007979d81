"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty of strings in sensitive context."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of spans in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = "passw|passphrase|passwd|pwd|secret|token|api[_-]?key|private[_-]?key|access[_-]?key|credential|authorization|bearer|login"
_SENSITIVE = re.compile(f"(?ai:{_WORDS})")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_PART = [bool(re.match("[A-Za-z0-9+/_=-]", chr(c))) for c in range(128)]
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "authorization", "bearer", "login")
#: Identifiers that prime the compressor: snake_case and camelCase names.
IDENTIFIER = r"(?<![A-Za-z0-9_])(?:[A-Za-z]++(?:_[A-Za-z0-9]++)++|[a-z]++(?:[A-Z][a-z0-9]*+)++)"
#: What stands around a sensitive word; no identifier is taken from there, else a secret that is copied would prime itself.
AROUND = rf"(?i)(?:[A-Za-z0-9+/_=-]{{16,}}+[\s\S]{{0,64}}?)?(?:{_WORDS})[\s\S]{{0,64}}[A-Za-z0-9+/_=-]*+"
#: The most frequent identifiers of the whole corpus make the dictionary, so many at most.
MAX_IDENTIFIERS = 2000


@dataclass(frozen=True)
class Novelty:
    """When a candidate counts as novel: marginal compressed bytes, their share of its length, kinds of characters.

    reach: code points before and after a sensitive word in which a string must begin or end to be looked at; context:
    code points on both sides that prime too.
    """

    min_bytes: int = 12
    min_share: float = 0.5
    min_classes: int = 2
    reach: int = 64
    context: int = 256


def identifiers(docs: DataFrame, most: int = MAX_IDENTIFIERS) -> DataFrame:
    """The most frequent identifiers (name, n) over all documents, counted with map-side sums; ties by name. What stands
    around sensitive words doesn't count."""
    names = docs.where(F.col("text").rlike("[A-Za-z]_[A-Za-z0-9]|[a-z][A-Z]")).select(F.explode(F.regexp_extract_all(F.regexp_replace("text", AROUND, " "), F.lit(IDENTIFIER), F.lit(0))).alias("name"))
    return names.where(F.length("name") <= 64).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(most)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns in code points, by start, then kind."""
    low = text.lower()
    found = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(start, KINDS[kind], end) for start, kind, end in sorted(found)]


def _classes(token: str) -> int:
    return any(c.isdigit() for c in token) + any(c.islower() for c in token) + any(c.isupper() for c in token) + any(c in "+/_=-" for c in token)


def marginal_bytes(context: bytes, candidate: bytes, compressor: zstandard.ZstdCompressor) -> int:
    """Compressed bytes that a candidate adds to its context."""
    return len(compressor.compress(context + candidate)) - len(compressor.compress(context))


def candidates(text: str, word: tuple[int, int], reach: int) -> Iterator[tuple[int, int]]:
    """Spans of whole strings that may be secrets, of which some part stands within reach before or after a word."""
    start, end = word
    part = lambda i: 0 <= i < len(text) and _PART[ord(text[i]) if ord(text[i]) < 128 else 0]
    for m in _CANDIDATE.finditer(text, end, end + reach + 15):
        a, b = m.span()
        while part(b):  # the reach must not cut a string
            b += 1
        if a < end + reach:
            yield a, b
    low = max(0, start - reach)
    while low and part(low) and part(low - 1):
        low -= 1
    yield from (m.span() for m in _CANDIDATE.finditer(text, low, start))


class Taken:
    """Spans without overlaps, in order."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end

    def add(self, start: int, end: int) -> None:
        i = bisect.bisect_right(self.ends, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def novel_spans(text: str, base: list[tuple[int, str, int]], compressor: zstandard.ZstdCompressor, rule: Novelty) -> list[tuple[int, str, int]]:
    """Candidates near a sensitive word, outside base spans, that the dictionary and the text around do not explain."""
    low = text.lower()
    if not any(h in low for h in _HINTS):
        return []
    seen, out, given, found = set(), [], Taken([(s, e) for s, _, e in base]), Taken([])
    for word in _SENSITIVE.finditer(text):
        for start, end in candidates(text, word.span(), rule.reach):
            if (start, end) in seen or given.meets(start, end):
                continue
            seen.add((start, end))
            token = text[start:end]
            if _classes(token) < rule.min_classes or found.meets(start, end):
                continue
            around = text[max(0, start - rule.context) : start] + text[end : end + rule.context]
            cost = marginal_bytes(around.encode(), token.encode(), compressor)
            if cost >= rule.min_bytes and cost >= rule.min_share * len(token):
                out.append((start, "novel", end))
                found.add(start, end)
    return out


def find_spans(docs: DataFrame, rule: Novelty | None = None, max_identifiers: int = MAX_IDENTIFIERS) -> DataFrame:
    """docs (doc_id, text) to doc_id and spans: array of (kind, start, end), code points, end exclusive, by start and kind.

    Whole texts of any length are searched in tasks, without a shuffle; the identifier dictionary is bounded. A null or
    empty text has no spans, rows that are repeated have theirs each, an empty table gives no rows, and other columns,
    whatever their names, are left out.
    """
    rule = rule or Novelty()
    names = [r["name"] for r in identifiers(docs, max_identifiers).collect()]
    primer = "\n".join(reversed(names)).encode()  # zstandard prefers what stands last

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(primer) >= 8 else None
        if data:
            data.precompute_compress(level=9)  # read once, not for each candidate
        compressor = zstandard.ZstdCompressor(level=9, dict_data=data, write_content_size=False)
        for batch in batches:
            found = []
            for text in batch["text"]:
                base = base_spans(text or "")
                spans = base + novel_spans(text or "", base, compressor, rule)
                spans.sort(key=lambda x: (x[0], KINDS.index(x[1]), x[2]))
                found.append([{"kind": k, "start": s, "end": e} for s, k, e in spans])
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "spans": found})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(scan, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined forms of `find_spans`: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return found.select("doc_id", *(of(k) for k in KINDS), F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def base_sha256(text: str) -> str:
    """What `digest` gives for one text."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in base_spans(text)).encode()).hexdigest()
