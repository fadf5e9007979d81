"""Media columns: payloads kept as lossless WebP images, and images read into pixel arrays and features."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import webp

#: Payloads are padded to a positive multiple of so many bytes: one row of grey pixels.
ROW = 576
#: Power of two of the sides of blocks of one prediction.
BLOCK_BITS = 9
#: Rows of an image at most; a longer payload takes several images, one after another.
ROWS = webp.MAX_SIDE


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (ROW * max(1, -(-len(raw) // ROW)) - len(raw))


def _bits(counts: np.ndarray) -> float:
    """Bits of samples of these counts under an ideal prefix code."""
    c = counts[counts > 0].astype(float)
    return float(c.sum() * np.log2(c.sum()) - (c * np.log2(c)).sum())


def form(grey: np.ndarray) -> dict:
    """How an image of grey samples is best kept: few values as a packed palette; a prediction from the left or from above
    where what it leaves takes a tenth fewer bits; else as it is."""
    counts = np.bincount(grey.ravel(), minlength=256)
    if np.count_nonzero(counts) <= 16:
        return {"palette": True}
    plain = _bits(counts)
    left = _bits(np.bincount((grey[:, 1:] - grey[:, :-1]).ravel(), minlength=256))
    above = _bits(np.bincount((grey[1:] - grey[:-1]).ravel(), minlength=256)) + _bits(counts) / len(grey) if len(grey) > 1 else plain
    mode, most = min(((1, left), (2, above)), key=lambda x: x[1])
    if most > 0.9 * plain:
        return {"subtract_green": True}
    side = 1 << BLOCK_BITS
    blocks = np.full((-(-grey.shape[0] // side), -(-grey.shape[1] // side)), mode << 8, np.uint32)
    return {"subtract_green": True, "predictor": blocks, "block_bits": BLOCK_BITS}


def store(payload: bytes) -> bytes:
    """A payload of whole rows as grey WebP images of ROW pixels a row."""
    grey = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    out = []
    for part in (grey[at : at + ROWS] for at in range(0, len(grey), ROWS)):
        x = part.astype(np.uint32)
        out.append(webp.encode(np.uint32(0xFF000000) | x << np.uint32(16) | x << np.uint32(8) | x, **form(part)))
    return b"".join(out)


def images(media: bytes) -> Iterator[np.ndarray]:
    """The pixels (height, width, 4; red, green, blue, alpha) of the images of a media column."""
    at = 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        pixels = webp.decode(media[at:end])
        yield np.stack([(pixels >> np.uint32(s)).astype(np.uint8) for s in (16, 8, 0, 24)], axis=-1)
        at = end


def restore(media: bytes) -> bytes:
    """The payload of `store`."""
    return b"".join(x[..., 1].tobytes() for x in images(media))


def describe(grey: np.ndarray) -> str:
    """Width x height, mean and spread of the samples in thousandths, and a difference hash of an 8 x 9 grid of means."""
    rows, cols = (np.linspace(0, n, k + 1).astype(int) for n, k in zip(grey.shape, (8, 9), strict=True))
    sums = np.zeros((len(grey) + 1, grey.shape[1] + 1), np.int64)
    sums[1:, 1:] = grey.cumsum(0, dtype=np.int64).cumsum(1)
    r0, r1 = np.minimum(rows[:-1], len(grey) - 1), np.maximum(rows[1:], np.minimum(rows[:-1], len(grey) - 1) + 1)
    c0, c1 = cols[:-1], np.maximum(cols[1:], cols[:-1] + 1)
    cells = sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]
    means = cells * 1000 // ((r1 - r0)[:, None] * (c1 - c0)[None, :])
    bits = np.packbits(means[:, 1:] > means[:, :-1]).tobytes().hex()
    total, n = int(sums[-1, -1]), grey.size
    squares = int((np.bincount(grey.ravel(), minlength=256) * np.arange(256, dtype=np.int64) ** 2).sum())
    return f"{grey.shape[1]}x{grey.shape[0]}:{total * 1000 // n}:{(n * squares - total * total) * 1000 // (n * n)}:{bits}"


def stored_media(text: Column) -> Column:
    """The UTF-8 bytes of a text (null: none), padded, as lossless WebP."""

    def keep(texts: pd.Series) -> pd.Series:
        return pd.Series([store(padded((t or "").encode())) for t in texts], dtype=object)

    return F.pandas_udf(keep, "binary")(text)


def decoded(media: Column | str) -> Column:
    """The images of a media column as RGBA pixel arrays, row by row; null stays null."""

    def read(column: pd.Series) -> pd.Series:
        return pd.Series([None if m is None else [{"width": x.shape[1], "height": x.shape[0], "pixels": x.tobytes()} for x in images(bytes(m))] for m in column], dtype=object)

    return F.pandas_udf(read, "array<struct<width:int,height:int,pixels:binary>>")(media)


#: What a stored form gives when it is read back.
DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: pd.Series) -> pd.DataFrame:
    def one(m: bytes) -> tuple:
        payload = restore(m)
        grey = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), describe(grey)

    return pd.DataFrame([one(bytes(m)) for m in media], columns=[c.split()[0] for c in DIGEST.split(", ")])


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column of every document; no shuffle.

    A null text is stored as an empty one, a text of over ROWS rows as several images one after another. Rows that are
    repeated are rows, an empty table gives none, and other columns, whatever their names, are left out.
    """
    return docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), stored_media(F.col("text")).alias("media"))


def media_digest(media: DataFrame) -> DataFrame:
    """What the stored bytes give when they are read back, and features of the samples. Values depend on the text only, so
    rows of equal texts are alike; an empty table gives no rows."""
    return media.withColumn("__d", F.pandas_udf(digests, DIGEST)("media")).select("doc_id", "n_bytes", "__d.*")
