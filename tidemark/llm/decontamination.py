"""Benchmark decontamination: n-gram seeds join places and items, Smith-Waterman alignment of words scores them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.words import mix, word_hashes

U = np.uint64
#: Words of a seed; one more word may stand between them, in the item or in the document.
SEED = 5
#: Items of up to so many words have seeds of one word less: two edits side by side may leave runs of four words.
SHORT = 10
#: Bits a seed of the filter that tells places without a seed of the benchmark, and the least and largest power of two of
#: all its bits: 16 MB at most.
SEED_BITS, FILTER_BITS = 64, (16, 27)
#: Places of a text that are compared at once with an item as beginnings of a passage.
STARTS = 256
#: Share of the words of item and passage that must be aligned and equal.
SIMILARITY = 0.8
_SEPARATE = np.arange(256, dtype=np.uint8)
for _c in range(128):
    if not chr(_c).isalnum():
        _SEPARATE[_c] = 32


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hashes, starts and ends (bytes) of the words (letters, digits, non-ASCII; A-Z lower-cased), and the UTF-8 bytes."""
    raw = text.encode()
    return *word_hashes(_SEPARATE[np.frombuffer(raw, np.uint8)].tobytes()), raw


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    out = parts[0]
    for p in parts[1:]:
        out = out * U(0x9FB21C651E98DF25) + p
    return mix(out)


def seeds(h: np.ndarray, size: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first positions of runs of `size` words, and of those that skip one inner word."""
    found = []
    for skip in range(size):  # 0: no word is skipped
        span = size + (skip > 0)
        if len(h) >= span:
            n = len(h) - span + 1
            found.append((_joined([h[i : i + n] for i in range(span) if not skip or i != skip]), np.arange(n)))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int, int, int]:
    """Smith-Waterman over words, +2 for equal, -1 for different or missing: score, equal words, item and passage spans."""
    m, n = len(item), len(passage)
    score = np.zeros((m + 1, n + 1), np.int32)
    step = np.arange(n + 1)
    for i in range(1, m + 1):
        row = np.zeros(n + 1, np.int32)
        row[1:] = np.maximum(score[i - 1, :-1] + np.where(passage == item[i - 1], 2, -1), score[i - 1, 1:] - 1)
        score[i] = np.maximum(np.maximum.accumulate(np.maximum(row, 0) + step) - step, 0)
    i, j = divmod(int(score.argmax()), n + 1)
    best, end_i, end_j, equal = int(score[i, j]), i, j, 0
    while i and j and score[i, j] > 0:
        same = item[i - 1] == passage[j - 1]
        if score[i, j] == score[i - 1, j - 1] + (2 if same else -1):
            equal += bool(same)
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return best, equal, i, end_i, j, end_j


def itemised(benchmark: DataFrame) -> DataFrame:
    """item_id, item (128-bit hash of the words), n, words (64-bit hashes) of the benchmark's rows with a word."""
    kind = dict(benchmark.dtypes)["item_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [tokens(t.as_py())[0] for t in batch.column(1)]
            kept = np.array([len(w) > 0 for w in words], bool)
            found = [w for w in words if len(w)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept)), pa.array([xxhash.xxh3_128_digest(w) for w in found], pa.binary()), pa.array([len(w) for w in found], pa.int32()), pa.array([w.tobytes() for w in found], pa.binary())], ["item_id", "item", "n", "words"])

    return benchmark.where("text IS NOT NULL").select("item_id", "text").mapInArrow(scan, f"item_id {kind}, item binary, n int, words binary")


def item_seeds(items: DataFrame, size: int = SEED) -> DataFrame:
    """seed, size, item, n, at (word of the item) of all seeds of distinct items (item, n, words)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, n, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                width = size if n > SHORT else min(size - 1, n)
                h, at = seeds(np.frombuffer(words, np.uint64), width)
                k = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(k, width, np.int32)), pa.array([item] * k, pa.binary()), pa.array(np.full(k, n, np.int32)), pa.array(at.astype(np.int32))], ["seed", "size", "item", "n", "at"])

    return items.select("item", "n", "words").mapInArrow(scan, "seed long, size int, item binary, n int, at int").distinct()


def _bits(h: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash among 2**power."""
    return h >> U(64 - power), (h * U(0x9E3779B97F4A7C15)) >> U(64 - power)


def seed_filter(seeded: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the seeds as 64-bit words, and the power of two of its bits: SEED_BITS a seed, within FILTER_BITS.

    Tasks find the words; only these, 2 million at most, come to the driver. With more seeds than it is made for it lets
    more places through, which then find no partner in the join.
    """
    power = min(FILTER_BITS[1], max(FILTER_BITS[0], (SEED_BITS * seeded.count()).bit_length()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(np.concatenate(_bits(batch.column(0).to_numpy().view(np.uint64), power)))
            yield pa.RecordBatch.from_arrays([pa.array((bit >> U(6)).astype(np.int32)), pa.array((U(1) << (bit & U(63))).view(np.int64))], ["word", "bit"])

    found = seeded.select("seed").mapInArrow(scan, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (power - 6), np.uint64)
    out[found["word"].to_numpy(int)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out, power


def places(texts: DataFrame, bits: np.ndarray, power: int, sizes: list[int]) -> DataFrame:
    """digest, seed, at (word of the text) of the seeds of texts (digest, text) that the filter lets through."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(*batch.columns, strict=True):
                h = tokens(text.as_py())[0]
                for size in sizes:
                    values, at = seeds(h, size)
                    one, two = _bits(values, power)
                    in_it = ((bits[one >> U(6)] >> (one & U(63))) & (bits[two >> U(6)] >> (two & U(63))) & U(1)).astype(bool)
                    k = int(in_it.sum())
                    if k:
                        yield pa.RecordBatch.from_arrays([pa.array([digest.as_py()] * k, pa.binary()), pa.array(values[in_it].view(np.int64)), pa.array(at[in_it].astype(np.int32))], ["digest", "seed", "at"])

    return texts.select("digest", "text").mapInArrow(scan, "digest binary, seed long, at int")


def _windows(cells: list[int], n: int, last: int) -> Iterator[tuple[int, int]]:
    """Places of an item of n words around its cells, overlapping ones joined, long ones in pieces that overlap."""
    grid, slack = max(1, n // 4), n // 4 + 2
    first = end = None
    for cell in [*sorted(cells), None]:
        a, b = (max(0, cell * grid - slack), min(last, (cell + 1) * grid + n + slack)) if cell is not None else (None, None)
        if first is not None and (a is None or a > end):
            yield from ((at, min(end, at + 10 * n + 64)) for at in range(first, end, 8 * n + 64))
            first = None
        if a is not None:
            first, end = (a, b) if first is None else (first, max(end, b))


def closest(item: np.ndarray, part: np.ndarray, similarity: float) -> tuple[float, int, int, int] | None:
    """similarity, equal words in order, begin and end of the passage of a text that has the largest share of words in common
    order with an item, if that is similar enough; of equal ones the first and then the shortest.

    A passage that is similar enough has n / similarity words at most; so all passages of up to that length are compared
    at once, by one table for each place where one can begin.
    """
    n, most = len(item), int(len(item) / similarity + 1e-9)
    known = np.isin(part, item)
    past = np.concatenate([[0], np.cumsum(known)])
    starts = np.flatnonzero(known)
    starts = starts[past[np.minimum(starts + most, len(part))] - past[starts] >= similarity * n - 1e-9]
    best = None
    for at in range(0, len(starts), STARTS):
        s = starts[at : at + STARTS]
        place = s[:, None] + np.arange(most)
        inside = place < len(part)
        words = part[np.minimum(place, len(part) - 1)]
        common = np.zeros((len(s), most + 1), np.int32)
        for w in item:
            step = common.copy()
            step[:, 1:] = np.maximum(step[:, 1:], common[:, :-1] + ((words == w) & inside))
            common = np.maximum.accumulate(step, axis=1)
        share = common[:, 1:] / np.maximum(n, np.arange(1, most + 1))
        share[~inside] = 0
        i, size = divmod(int(share.argmax()), most)
        if share[i, size] >= similarity - 1e-9 and (best is None or share[i, size] > best[0]):
            best = (float(share[i, size]), int(common[i, size + 1]), int(s[i]), int(s[i]) + size + 1)
    return best


def passage(item: np.ndarray, h: np.ndarray, cells: list[int], similarity: float) -> tuple[float, int, int, int, int] | None:
    """similarity, score, equal words, first and last word of the best passage near the cells that is similar enough.

    Where the best local alignment of a window isn't similar enough, it may hide one that is: then all passages of a
    length that can be are compared, and the best of these is aligned.
    """
    n, best = len(item), None
    for a, b in _windows(cells, n, len(h)):
        part = h[a:b]
        if np.isin(item, part).sum() < similarity * n - 1e-9:
            continue  # too few words of the item stand here
        score, equal, _, _, j, end = align(item, part)
        found = equal / max(n, end - j)
        if found < similarity:
            near = closest(item, part, similarity)
            if near:
                found, equal, j, end = near
                score = align(item, part[j:end])[0]
        if found >= similarity - 1e-9 and (best is None or found > best[0]):
            best = (found, score, equal, a + j, a + end - 1)
    return best


def matches(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """digest, item, similarity, score, equal_words, start, end (code points) of the similar passages of distinct texts.

    Seeds of all items are a table; places of texts that a filter of them lets through are joined with it by Spark, and
    count once for each cell of a quarter of the item's length. Texts with a candidate are joined with it and aligned.
    docs: doc_id, digest, text; items: item, n, words, distinct.
    """
    seeded = stored(item_seeds(items), "seeds")
    sizes = sorted(r["size"] for r in seeded.select("size").distinct().collect())
    bits, power = seed_filter(seeded)
    hits = places(docs, bits, power, sizes).distinct().withColumnRenamed("at", "place")
    grid = F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    cells = hits.join(seeded, "seed").select("digest", "item", F.floor((F.col("place") - F.col("at")) / grid).alias("cell")).distinct()
    pairs = stored(cells.groupBy("digest", "item").agg(F.collect_list("cell").alias("cells")), "pairs")
    chosen = docs.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("c"))
    chosen = chosen.join(pairs.select("digest").distinct(), "digest", "left_semi").select(F.col("digest").alias("c_digest"), F.col("c.doc_id").alias("c_doc"))
    texts = docs.join(chosen, (F.col("digest") == F.col("c_digest")) & F.col("doc_id").eqNullSafe(F.col("c_doc")), "left_semi").select("digest", "text").dropDuplicates(["digest"])
    both = pairs.join(items.select("item", "words"), "item").join(texts, "digest").select("digest", "item", "words", "cells", "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                digest, item, words, cells = (batch.column(c)[i].as_py() for c in range(4))
                if digest != last:
                    last, held = digest, tokens(batch.column(4)[i].as_py())
                h, starts, ends, raw = held
                best = passage(np.frombuffer(words, np.uint64), h, cells, similarity)
                if best:
                    rows.append((digest, item, *best[:3], len(raw[: starts[best[3]]].decode()), len(raw[: ends[best[4]]].decode())))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.binary(), pa.binary(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["digest", "item", "similarity", "score", "equal_words", "start", "end"])

    out = both.mapInArrow(score, "digest binary, item binary, similarity double, score int, equal_words int, start int, end int")
    return stored(out, "matches")


def _digested(docs: DataFrame) -> DataFrame:
    return docs.where("text IS NOT NULL AND text <> ''").select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text")


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and similar item: doc_id, item_id, similarity, score, equal_words, start, end (code points).

    similarity: aligned equal words over the longer of item and passage; of several passages of an item in a document
    the best aligned is given, of equally good ones the first; one that is similar enough is found whatever stands beside it
    or overlaps it. Whole texts are searched, of any length. Null texts, texts without
    a word and empty tables have no leak; a document or item that stands in several rows, also under one id or none, is
    reported for each. Other columns, whatever their names, are not read.
    """
    items = stored(itemised(benchmark), "items")
    found = matches(_digested(docs), items.dropDuplicates(["item"]), similarity)
    rows = _digested(docs).select("doc_id", "digest").join(found, "digest").join(items.select("item_id", "item"), "item")
    return rows.select("doc_id", "item_id", "similarity", "score", "equal_words", "start", "end")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs, with their own columns whatever their names, without those that hold an item of the benchmark.

    Rows without a text or a word stay, as does every row where the benchmark is empty.
    """
    items = itemised(benchmark).dropDuplicates(["item"])
    found = matches(_digested(docs), stored(items, "items"), similarity).select(F.col("digest").alias("__leak")).distinct()
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.unhex(F.md5("text")).alias("__digest"))
    return held.join(found, F.col("__digest") == F.col("__leak"), "left_anti").select("__row.*")
