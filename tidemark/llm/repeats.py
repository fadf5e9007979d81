"""Repeated long byte strings, found with run-length indexes of the text that can repeat.

A string of LENGTH bytes is routed by its minimizer: the smallest hash among its GRAM-byte strings. Equal strings have
equal minimizers, so all comparisons stay within the texts of one minimizer. Neighbouring strings with one minimizer are
kept as one segment. Segments of the same bytes go into an index once, with the number of their copies; all segments of
one minimizer are indexed together: the run-compressed Burrows-Wheeler transform with suffixes and match lengths sampled
at the ends of its runs, from which the matching statistics of all positions are read in text order (Gagie, Navarro and
Prezza, 2020). Whole segments that are equal are told by 128 bits of hash, and enter the index as counts; what repeats
within different segments is read from the index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stored
from tidemark.llm.words import mix, powers, prefix_hash

U = np.uint64
LENGTH, GRAM = 400, 64
#: Bytes of text whose segments are computed at once.
PIECE = 1 << 18
#: An index takes whole minimizers up to about so many bytes, so its arrays stay in a core's cache. Segments of a minimizer with more distinct ones than HOT
#: are cut into CLASSES parts each by where the minimizer lies in the string, again and again, and routed by the bytes
#: that all strings of a part have in common; a part of one string is routed by all of it, so this ends.
INDEX_BYTES, HOT, CLASSES = 1 << 17, 500, 4


def minimizer_runs(raw: bytes, length: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, number of strings, place and hash of the minimizer) of the runs of strings of one minimizer position."""
    last = len(raw) - length + 1
    for at in range(0, max(0, last), PIECE):
        part = np.frombuffer(raw, np.uint8, min(len(raw), at + PIECE + length - 1) - at, at)
        sums = prefix_hash(part)
        n = len(part) - gram + 1
        h = mix((sums[gram:] - sums[:n]) * powers(n)[1])
        w = length - gram + 1
        value = (h & ~U(0x1FFFFF)) | np.arange(n, dtype=np.uint64)  # ties of the leading bits: the leftmost
        padded = np.full(-(-n // w) * w, U(0xFFFFFFFFFFFFFFFF))
        padded[:n] = value
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        behind = np.minimum.accumulate(blocks, axis=1).ravel()
        where = (np.minimum(ahead[: n - w + 1], behind[w - 1 : n]) & U(0x1FFFFF)).astype(np.int64)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(where)) + 1))
        counts = np.diff(np.append(starts, len(where)))
        yield from zip((starts + at).tolist(), counts.tolist(), (where[starts] - starts).tolist(), h[where[starts]].view(np.int64).tolist(), strict=True)


class RunLengthIndex:
    """The runs of the Burrows-Wheeler transform of some strings, each with an end mark of its own.

    Kept per run: its symbol and length, and the suffix positions at its head and tail with the lengths of their matches
    with the suffixes before and after them. All other match lengths follow from these. Of copies of a string one is
    sorted: the others' suffixes stand beside its own with the same symbol before them and lengthen their runs, except
    for the whole strings, before which the end marks differ: these are runs of their own, which match in full.
    """

    def __init__(self, strings: list[bytes], copies: list[int] | None = None):
        self.offsets = np.cumsum([0] + [len(s) + 1 for s in strings])
        n, marks = int(self.offsets[-1]), len(strings)
        text = np.empty(n, np.int64)
        for k, s in enumerate(strings):
            text[self.offsets[k] : self.offsets[k + 1] - 1] = np.frombuffer(s, np.uint8)
        ends = self.offsets[1:] - 1
        text += marks
        text[ends] = np.arange(marks)
        order, levels = self._sorted(text, max(map(len, strings), default=0) + 1)
        before = text[order - 1]  # of suffix 0 this is the last end mark, which no other suffix has before it
        change = np.flatnonzero(before[1:] != before[:-1]) + 1
        heads, tails = np.concatenate(([0], change)), np.concatenate((change - 1, [n - 1]))
        times = np.repeat(np.ones(marks, np.int64) if copies is None else np.array(copies, np.int64), np.diff(self.offsets))
        self.symbols, self.lengths = before[heads], np.add.reduceat(times[order], heads)
        self.head_suffix, self.tail_suffix = order[heads], order[tails]
        self.head_match = self._match(levels, order[np.maximum(heads - 1, 0)], order[heads]) * (heads > 0)
        self.tail_match = self._match(levels, order[tails], order[np.minimum(tails + 1, n - 1)]) * (tails < n - 1)
        first = self.offsets[:-1]
        self.copy_suffix = first[times[first] > 1] if marks else first
        self.copy_match = (self.offsets[1:] - 1 - first)[times[first] > 1] if marks else first
        self.n = n

    @staticmethod
    def _sorted(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffix array, and the ranks of all suffixes by their first 1, 2, 4, ... symbols; only ties are sorted again."""
        n, width, key, levels = len(text), 1, text.astype(np.uint64) + U(1), [(1, text.astype(np.int32))]
        if n > 4 and int(text.max()) + 1 < 1 << 16:  # four symbols at once
            for bits in (U(16), U(32)):
                ahead = np.zeros(n, np.uint64)
                ahead[: n - width] = key[width:]
                key, width = (key << bits) | ahead, 2 * width
                if width == 2:
                    levels.append((2, key.astype(np.uint32).view(np.int32)))
        order, rank = np.argsort(key), np.empty(n, np.int64)
        key, still = key[order], np.arange(n)  # places in the order of suffixes that are not alone in their rank
        while True:
            head = np.ones(len(still), bool)
            head[1:] = key[1:] != key[:-1]
            rank[order[still]] = np.maximum.accumulate(np.where(head, still, 0))
            if width > 1:
                levels.append((width, rank.astype(np.int32)))
            alone = head.copy()
            alone[:-1] &= head[1:]
            still = still[~alone]
            if width >= depth or not len(still):
                return order, levels
            suffix = order[still]
            key, ahead = rank[suffix].astype(np.uint64) << U(32), suffix + width
            inside = ahead < n
            key[inside] |= (rank[ahead[inside]] + 1).astype(np.uint64)
            by = np.argsort(key)
            order[still], key = suffix[by], key[by]
            width *= 2

    @staticmethod
    def _match(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common beginnings of the suffixes at a and b."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for width, rank in reversed(levels):
            n = len(rank)
            same = (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]) & (a < n) & (b < n) & (a != b)
            out, a, b = out + width * same, a + width * same, b + width * same
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position, the length of its longest match that starts anywhere else; streamed from the run ends.

        Where a suffix and its neighbour have the same symbol before them, their match is one shorter than that of the
        position before, so each sampled length counts down until the next sample.
        """
        out = np.zeros(self.n, np.int64)
        at = np.arange(self.n)
        for suffix, match in ((self.head_suffix, self.head_match), (self.tail_suffix, self.tail_match), (self.copy_suffix, self.copy_match)):
            if not len(suffix):
                continue
            sample = np.full(self.n, -1)
            sample[suffix] = at[suffix]
            value = np.zeros(self.n, np.int64)
            value[suffix] = match
            last = np.maximum.accumulate(sample)
            out = np.maximum(out, np.where(last < 0, 0, value[last] - (at - last)))
        return out

    def repeated(self, length: int) -> list[np.ndarray]:
        """For each string, the starts of its substrings of this length that also start elsewhere."""
        hit = self.matching_statistics() >= length
        return [np.flatnonzero(hit[a:b]) for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True)]


def _ranges(starts: np.ndarray) -> list[dict]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return [{"at": int(a), "n": int(b - a + 1)} for a, b in zip(starts[np.concatenate(([0], cut))], starts[np.concatenate((cut - 1, [len(starts) - 1]))], strict=True)]


def _pair(view: bytes | memoryview) -> tuple[int, int]:
    """128 bits of hash as two numbers."""
    c = xxhash.xxh3_128_digest(view)
    return int.from_bytes(c[:8], "little", signed=True), int.from_bytes(c[8:], "little", signed=True)


_KINDS = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "array<struct<at:int,n:int>>": pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], names)


def segments(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments (digest, start, n, place, mini, c1, c2) of the texts (raw binary): n strings from start on, one minimizer."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0):
                raw = value.as_py()
                if len(raw) >= length:
                    digest, view = hashlib.md5(raw).digest(), memoryview(raw)
                    for start, n, place, mini in minimizer_runs(raw, length, gram):
                        rows.append((digest, start, n, place, mini, *_pair(view[start : start + n + length - 1])))
            yield _batch(rows, "digest binary, start int, n int, place int, mini long, c1 long, c2 long")

    return texts.select("raw").mapInArrow(scan, "digest binary, start int, n int, place int, mini long, c1 long, c2 long")


def indexed(pieces: DataFrame, length: int) -> DataFrame:
    """Repeated strings (c1, c2, spans) of the pieces (mini, c1, c2, total, raw), by one index after another in each task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def flush() -> pa.RecordBatch:
            found = [_ranges(x) for x in RunLengthIndex([raw for *_, raw in held], [total for *_, total, _ in held]).repeated(length)]
            rows = [(a, b, r) for (a, b, *_), r in zip(held, found, strict=True) if r]
            held.clear()
            return _batch(rows, "c1 long, c2 long, spans array<struct<at:int,n:int>>")

        for batch in batches:
            for mini, c1, c2, total, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if mini != last and size >= INDEX_BYTES:
                    yield flush()
                    size = 0
                last = mini
                held.append((c1, c2, total, raw))
                size += len(raw)
        if held:
            yield flush()

    spread = pieces.repartition("mini").sortWithinPartitions("mini").select("mini", "c1", "c2", "total", "raw")
    return spread.mapInArrow(search, "c1 long, c2 long, spans array<struct<at:int,n:int>>")


def parted(pieces: DataFrame, length: int, width: int) -> DataFrame:
    """Parts of pieces: strings whose minimizer lies `width` places from each other at most, in fixed ranges of places.

    p1, p2 (the piece), off (first string in it), mini (hash of old key, range and common bytes), c1, c2, n, place, raw.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for mini, c1, c2, total, place, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i = 0
                while i < n:
                    low = (place - i) // width * width  # of this range: string i - k has the minimizer k places further on
                    count = min(n - i, place - i - low + 1)
                    common = raw[place - low : place - low - width + 1 + length]
                    part = raw[i : i + count + length - 1]
                    rows.append((c1, c2, i, _pair(b"%d:%d:" % (mini, low) + common)[0], *_pair(part), total, count, place - i, part))
                    i += count
            yield _batch(rows, "p1 long, p2 long, off int, mini long, c1 long, c2 long, total long, n int, place int, raw binary")

    slim = pieces.select("mini", "c1", "c2", "total", "place", "n", "raw")
    return slim.mapInArrow(split, "p1 long, p2 long, off int, mini long, c1 long, c2 long, total long, n int, place int, raw binary")


def with_kinds(contents: DataFrame) -> DataFrame:
    """Contents that can repeat, with kinds, the number of different ones of their minimizer.

    Counts over 1 stand in a table of their own, so that Spark can split the join of a minimizer that many have.
    """
    kinds = stored(contents.groupBy("mini").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    return contents.join(kinds, "mini", "left").withColumn("kinds", F.coalesce("kinds", F.lit(1))).where("kinds > 1 OR total > 1")


def repeated(pieces: DataFrame, length: int, hot: int, width: int) -> DataFrame:
    """Repeated strings (c1, c2, spans) of pieces (mini, c1, c2, total, n, place, kinds, raw); total counts equal pieces."""
    found = indexed(pieces.where(F.col("kinds") <= hot), length)
    rest = pieces.where(F.col("kinds") > hot)
    if rest.isEmpty():
        return found
    width = -(-width // CLASSES)
    parts = stored(parted(rest, length, width), "parts")
    contents = parts.groupBy("mini", "c1", "c2").agg(F.sum("total").alias("total"), F.first("n").alias("n"), F.first("place").alias("place"), F.first("raw").alias("raw"))
    contents = stored(contents, "contents")
    # a part of one string is all of what routes it, so its minimizer has one kind
    inner = repeated(with_kinds(contents) if width > 1 else contents.where("total > 1").withColumn("kinds", F.lit(1)), length, max(hot, 1), width)
    back = parts.select("p1", "p2", "off", "c1", "c2").join(inner, ["c1", "c2"])
    moved = F.transform("spans", lambda s: F.struct((s["at"] + F.col("off")).alias("at"), s["n"].alias("n")))
    return found.unionByName(back.select(F.col("p1").alias("c1"), F.col("p2").alias("c2"), moved.alias("spans")))


def removed_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """digest and spans (start, end; sorted, apart) of the bytes of each distinct text that lie in a repeated string.

    texts: doc_id, digest, raw; one row for each document, so that copies count as occurrences.
    """
    cut = stored(segments(texts, length, gram), "segments")
    contents = cut.groupBy("mini", "c1", "c2").agg(F.count("*").alias("total"), F.min(F.struct("digest", "start")).alias("rep"), F.first("n").alias("n"), F.first("place").alias("place"))
    contents = stored(contents.select("mini", "c1", "c2", "total", "n", "place", "rep.digest", "rep.start"), "contents")
    live = stored(with_kinds(contents), "live")
    discard(contents)
    # copies of a text are told apart by id before bytes are shuffled, so they don't meet in one task
    chosen = texts.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("c")).select("digest", F.col("c.doc_id").alias("c_doc"))
    chosen = chosen.join(live.select("digest").distinct(), "digest", "left_semi").withColumnRenamed("digest", "c_digest")
    wanted = texts.join(chosen, (F.col("digest") == F.col("c_digest")) & F.col("doc_id").eqNullSafe(F.col("c_doc")), "left_semi").select("digest", "raw").dropDuplicates(["digest"])
    piece = F.expr(f"substring(raw, start + 1, n + {length - 1})")
    pieces = stored(live.join(wanted, "digest").select("mini", "c1", "c2", "total", "n", "place", "kinds", piece.alias("raw")), "pieces")
    discard(live)
    found = repeated(pieces, length, hot, length - gram + 1)
    marks = cut.join(found, ["c1", "c2"]).select("digest", F.transform("spans", lambda s: F.struct((F.col("start") + s["at"]).alias("start"), (F.col("start") + s["at"] + s["n"] + (length - 1)).alias("end"))).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                spans = []
                for s in sorted((x["start"], x["end"]) for x in value.as_py()):
                    if spans and s[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], s[1])
                    else:
                        spans.append(list(s))
                out.append([{"start": a, "end": b} for a, b in spans])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["digest", "spans"])

    distinct = marks.select("digest", F.explode("spans").alias("s")).distinct()
    return distinct.groupBy("digest").agg(F.collect_list("s").alias("spans")).mapInArrow(merge, "digest binary, spans array<struct<start:int,end:int>>")


def drop_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, raw (UTF-8 bytes of the text), spans (removed, sorted, apart), kept (the other bytes joined).

    A byte goes if it lies in a string of `length` bytes that also starts anywhere else in any document, its own
    included; what is left is not searched again. A null text counts as empty, and texts under `length` bytes keep all.
    Each row is a document, so of a row that is repeated, also under one id or none, both lose what they share; the
    length of a text isn't limited, an empty table gives no rows, and other columns, whatever their names, are left out.
    """
    texts = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw")).withColumn("digest", F.unhex(F.md5("raw")))
    spans = removed_spans(texts, length, gram, hot)
    out = texts.join(spans, "digest", "left").withColumn("spans", F.coalesce("spans", F.expr("CAST(array() AS array<struct<start:int,end:int>>)")))
    edges = F.expr("transform(sequence(0, size(spans)), i -> struct(CASE WHEN i = 0 THEN 0 ELSE spans[i - 1].end END AS a, CASE WHEN i = size(spans) THEN octet_length(raw) ELSE spans[i].start END AS b))")
    kept = F.aggregate(edges, F.expr("X''"), lambda acc, e: F.concat(acc, F.substring(F.col("raw"), e["a"] + 1, e["b"] - e["a"])))
    return out.select("doc_id", "raw", "spans", F.when(F.size("spans") == 0, F.col("raw")).otherwise(kept).alias("kept"))


def digest(dropped: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of `drop_repeats`, and kept_text: the other bytes as text, in which
    what is left of a character that was cut stands as U+FFFD."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return dropped.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))
