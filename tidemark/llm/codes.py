"""Vector code compression: a codebook for each part of a vector, from Lloyd's rounds that only hand on what changed.

Each vector's code of the round before stands beside it in a table, and the driver keeps running sums and counts of each
entry, whole numbers. A task compares the new codes with those, adds up what left and what joined each entry, and only
these differences are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stored
from tidemark.llm.points import floors, joined, matrix, squares, whole, with_points

PARTS, ENTRIES = 4, 256
#: Vectors that are compared with a codebook at once.
STEP = 4096
_DELTA = pa.list_(pa.struct([("slot", pa.int32()), ("sums", pa.list_(pa.int64()))]))


def nearest(points: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each part of each point (ties: the lower one), and the squared distances summed over parts."""
    parts, _, width = books.shape
    code, error = np.empty((len(points), parts), np.uint8), np.zeros(len(points), np.int64)
    for at in range(0, len(points), STEP):
        for p in range(parts):
            d = squares(points[at : at + STEP, p * width : (p + 1) * width], books[p])
            code[at : at + STEP, p] = best = d.argmin(1)
            error[at : at + STEP] += d[np.arange(len(d)), best]
    return code, error


def changes(points: np.ndarray, new: np.ndarray, old: np.ndarray | None, parts: int, entries: int, total: np.ndarray) -> int:
    """Adds to `total` (by part and entry: count and sums) what joined and takes off what left; returns the parts that moved."""
    moved, width = 0, points.shape[1] // parts
    for p in range(parts):
        at = np.arange(len(points)) if old is None else np.flatnonzero(new[:, p] != old[:, p])
        x = np.concatenate([np.ones((len(at), 1), np.int64), points[at, p * width : (p + 1) * width]], axis=1)
        moved += len(at)
        np.add.at(total, p * entries + new[at, p].astype(np.int64), x)
        if old is not None:
            np.subtract.at(total, p * entries + old[at, p].astype(np.int64), x)
    return moved


def _round(state: DataFrame, books: np.ndarray) -> DataFrame:
    """state with the codes of these books, and in one row of each task the changes since the codes before."""
    parts, entries, width = books.shape
    names = state.columns
    had = "code" in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros((parts * entries, width + 1), np.int64), None

        def out(batch: pa.RecordBatch, code: np.ndarray, delta: list | None) -> pa.RecordBatch:
            kept = [batch.column(n) for n in ("vec_id", "label", "point")]
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(code), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([*kept, packed, pa.array([delta] + [None] * (len(code) - 1), _DELTA)], names=["vec_id", "label", "point", "code", "delta"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held:
                yield out(*held, None)
            points = matrix(batch.column("point"), parts * width)
            code, _ = nearest(points, books)
            old = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts) if had else None
            changes(points, code, old, parts, entries, total)
            held = batch, code
        if held:
            hit = np.flatnonzero(total.any(1))
            yield out(*held, [{"slot": int(i), "sums": total[i].tolist()} for i in hit])

    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    given = state.select("vec_id", "label", "point", *(["code"] if had else []))
    return given.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, point array<int>, code binary, delta array<struct<slot: int, sums: array<long>>>")


def compress(
    vectors: DataFrame, rounds: int = 4, scale: int = 1024, parts: int = PARTS, entries: int = ENTRIES, key: str = "vec_id", vector: str = "embedding", label: str = "label", costs: list[int] | None = None
) -> DataFrame:
    """One row per vector: vec_id, code (hex, a byte for each part), error, label_error, codebooks_sha256.

    Vectors that are null or empty or hold a null or a component that is not finite are left out, as are those of another
    number of components than most have (as many of both: the larger number). A component x counts as floor(scale * x),
    held within 2**26 of 0; components past a multiple of `parts` are filled up with 0. The first entries are the parts of
    the vectors with the smallest keys, a null key last, equal keys by their components; with fewer vectors there are fewer
    entries. A part goes to the nearest entry, the lower one if several are as near; an entry without parts stays. Repeated
    rows count each; a null label is a label; an empty table gives an empty result; other columns are not looked at. The
    driver holds codebooks and sums. `costs`, if given, takes the entries that changed in each round.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    sizes = vectors.where(whole(vector) & (F.size(vector) > 0)).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    size = sizes["n"] if sizes else parts
    made = with_points(vectors, vector, scale, size, [F.col(f"`{key}`").alias("vec_id"), F.col(f"`{label}`").alias("label")])
    width = -(-size // parts)
    if width * parts > size:
        made = made.withColumn("point", F.concat("point", F.array(*[F.lit(0)] * (width * parts - size))))
    first = made.select("vec_id", "point").orderBy(F.asc_nulls_last("vec_id"), "point").limit(entries).collect()
    if not first:
        return made.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    books = np.array([r["point"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    k = len(first)
    running = np.zeros((parts * k, width + 1), np.int64)
    state = made
    for _ in range(rounds):
        before, state = state, stored(_round(state, books), "codes")
        parted = state.where(F.col("delta").isNotNull()).select(F.explode("delta").alias("d")).select("d.slot", F.posexplode("d.sums").alias("at", "s"))
        changed = set()
        for r in parted.groupBy("slot", "at").agg(F.sum("s").alias("s")).collect():  # parts * entries * (width + 1) numbers at most
            running[r["slot"], r["at"]] += r["s"]
            changed.add(r["slot"])
        if costs is not None:
            costs.append(len(changed))
        books = floors(running[:, 1:], running[:, 0], books.reshape(parts * k, width)).reshape(parts, k, width)
        if before is not made:
            discard(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = nearest(matrix(batch.column("point"), parts * width), books)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in made.schema}
    coded = stored(state.select("vec_id", "label", "point").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "coded")
    if state is not made:
        discard(state)
    errors = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(joined(books).encode()).hexdigest()
    return coded.join(errors, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
