"""Vectorised hashing of words and byte strings inside tasks (numpy)."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

#: Texts are hashed in pieces of about so many bytes, cut between words.
PIECE = 1 << 18
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1342543DE82EF95))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


@functools.cache
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(PIECE + 4096)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each; those of usual pieces stay in the worker."""
    up, down = _usual_powers() if n <= PIECE + 4096 else _powers(n)
    return up[:n], down[:n]


def prefix_hash(a: np.ndarray) -> np.ndarray:
    """Running polynomial sums of the bytes, one longer than a."""
    out = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * powers(len(a))[0], out=out[1:])
    return out


def _piece(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = _LOWER[np.frombuffer(raw, np.uint8)]
    edge = np.diff(np.concatenate(([False], ~_SPACE[a], [False])).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    sums = prefix_hash(a)
    h = (sums[ends] - sums[starts]) * powers(len(a))[1][starts]
    return mix(h + (ends - starts).astype(np.uint64)), starts, ends


def pieces(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Offsets and parts of a text of about PIECE bytes each; no word is cut."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        yield at, raw[at:end]
        at = end


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (bytes) of the words [^\\x20\\x09-\\x0D]+ of a UTF-8 text, A-Z lower-cased."""
    if len(raw) <= PIECE:
        return _piece(raw)
    parts = [(h, s + at, e + at) for at, x in pieces(raw) for h, s, e in [_piece(x)]]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def stem_hashes(raw: bytes, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size, hashes of the first so many bytes of the words that are longer."""
    out = []
    for _, x in pieces(raw):
        a = _LOWER[np.frombuffer(x, np.uint8)]
        _, starts, ends = _piece(x)
        sums = prefix_hash(a)
        for size in sizes:
            at = starts[ends - starts > size]
            out.append(mix((sums[at + size] - sums[at]) * powers(len(a))[1][at] + U(size << 8)))
    return out


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of n words (empty if there are fewer)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * U(0x9FB21C651E98DF25) + h[i : len(h) - n + 1 + i]
    return mix(out)


def shingle_set(raw: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; with fewer words the whole sequence is one; empty without words."""
    h = word_hashes(raw)[0]
    return np.unique(grams(h, min(n, len(h)))) if len(h) else np.zeros(0, np.uint64)
