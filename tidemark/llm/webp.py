"""Lossless WebP (VP8L, RFC 9649): a decoder for whole streams and a plain encoder, in numpy.

Pixels are uint32 ARGB arrays of shape (height, width).
"""

from __future__ import annotations

import functools
import heapq
import struct

import numpy as np

#: Order in which the lengths of the code-length code are stored, from the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Lengths of the code-length code that the encoder always writes: a whole code over its 19 symbols.
FIXED_CODE_LENGTHS = (4,) * 13 + (5,) * 6
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, COLOR_INDEXING = range(4)
LENGTH_CODES, DISTANCE_CODES, LITERALS = 24, 40, 256
CACHE_MULTIPLIER = 0x1E35A7BD
MAX_SIDE, MAX_COPY = 16384, 4096
#: Offsets (dx, dy) of the first 120 distance codes: the pixels above or left, by distance.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


# Reading


class Bits:
    """Bits of a stream, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        byte, shift = self.at >> 3, self.at & 7
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends too early")
        return (int.from_bytes(self.data[byte : byte + 5], "little") >> shift) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        return (int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 4], "little") >> (self.at & 7)) & ((1 << n) - 1)


class Code:
    """A canonical prefix code as a table over the next `bits` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) < 2:
            self.bits, self.symbols, self.lengths = 0, np.array([used[0] if len(used) else 0]), np.zeros(1, np.int64)
            return
        each = lengths[used]
        if (1 << 15) != int((1 << (15 - each)).sum()):
            raise ValueError("a prefix code is not complete")
        self.bits = int(each.max())
        self.symbols, self.lengths = np.empty(1 << self.bits, np.uint32), np.empty(1 << self.bits, np.int32)
        for symbol, n, code in zip(used.tolist(), each.tolist(), reversed_codes(lengths)[used].tolist(), strict=True):
            self.symbols[code :: 1 << n] = symbol
            self.lengths[code :: 1 << n] = n

    def read(self, bits: Bits) -> int:
        if not self.bits:
            return int(self.symbols[0])
        at = bits.peek(self.bits)
        bits.read(int(self.lengths[at]))
        return int(self.symbols[at])


@functools.lru_cache(maxsize=64)
def _known_code(lengths: bytes) -> Code:
    """Codes that most streams have, such as that of the code lengths, are built once."""
    return Code(np.frombuffer(lengths, np.int64))


def reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of the given lengths, bit-reversed as the stream holds them."""
    out, code, before = np.zeros(len(lengths), np.int64), 0, 0
    used = np.flatnonzero(lengths)
    for symbol in used[np.argsort(lengths[used], kind="stable")].tolist():
        n = int(lengths[symbol])
        code <<= n - before
        out[symbol] = int(f"{code:0{n}b}"[::-1], 2)
        code, before = code + 1, n
    return out


def _read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        count, wide = bits.read(1) + 1, bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if count == 2:
            lengths[bits.read(8)] = 1
        return _known_code(lengths.tobytes())
    meta = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        meta[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code = _known_code(meta.tobytes())
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        symbol = code.read(bits)
        if symbol < 16:
            lengths[at] = symbol
            at, last = at + 1, symbol or last
        else:
            value = last if symbol == 16 else 0
            n = 11 + bits.read(7) if symbol == 18 else 3 + bits.read(symbol - 14)
            if at + n > size:
                raise ValueError("code lengths run over the alphabet")
            lengths[at : at + n] = value
            at += n
    return Code(lengths)


def _value(prefix: int, bits: Bits) -> int:
    """A length or distance from its prefix symbol and the extra bits that follow."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    dx, dy = NEAR[code - 1]
    return max(1, dx + dy * width)


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image; only the main one may have several groups of prefix codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups_at, group_bits, n_groups = None, 0, 1
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        blocks = _read_image(bits, -(-width >> group_bits), -(-height >> group_bits), False)
        groups_at = ((blocks >> 8) & 0xFFFF).astype(np.int64)
        n_groups = int(groups_at.max()) + 1
    sizes = (LITERALS + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    groups = [[_read_code(bits, n) for n in sizes] for _ in range(n_groups)]
    out = np.zeros(width * height, np.uint32)
    if n_groups == 1 and not cache_bits:
        _read_plain(bits, groups[0], out, width)
    else:
        _read_any(bits, groups, groups_at, group_bits, cache_bits, out, width)
    return out.reshape(height, width)


def _copy(out: np.ndarray, at: int, distance: int, n: int) -> int:
    if distance > at or at + n > len(out):
        raise ValueError("a back-reference leaves the image")
    if distance >= n:
        out[at : at + n] = out[at - distance : at - distance + n]
    else:
        out[at : at + n] = np.resize(out[at - distance : at], n)
    return at + n


def _read_any(bits: Bits, groups: list, groups_at: np.ndarray | None, group_bits: int, cache_bits: int, out: np.ndarray, width: int) -> None:
    """Pixels one after another: any number of code groups, back-references, colour cache."""
    at, cache, cached = 0, np.zeros(1 << cache_bits, np.uint32), 0
    while at < len(out):
        y, x = divmod(at, width)
        green, red, blue, alpha, dist = groups[groups_at[y >> group_bits, x >> group_bits] if groups_at is not None else 0]
        symbol = green.read(bits)
        if symbol < LITERALS:
            r, b = red.read(bits), blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | symbol << 8 | b
            at += 1
        elif symbol < LITERALS + LENGTH_CODES:
            n = _value(symbol - LITERALS, bits)
            at = _copy(out, at, _distance(_value(dist.read(bits), bits), width), n)
        else:
            while cached < at:  # the cache takes pixels in only when it is asked
                cache[(CACHE_MULTIPLIER * int(out[cached]) & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
                cached += 1
            out[at] = cache[symbol - LITERALS - LENGTH_CODES]
            at += 1


def _read_plain(bits: Bits, codes: list[Code], out: np.ndarray, width: int) -> None:
    """Pixels of one code group without a cache: symbols are looked up at every bit at once, then chained."""
    green, red, blue, alpha, dist = codes
    raw = np.frombuffer(bits.data, np.uint8, offset=bits.at >> 3)
    first, base = bits.at & 7, bits.at & ~7
    wide = np.zeros(len(raw) + 8, np.uint32)
    wide[: len(raw)] = raw
    wide = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    ahead = ((wide[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(0x7FFF)).astype(np.int32).ravel()
    n_bits = 8 * len(raw)
    here = np.arange(n_bits, dtype=np.int32 if n_bits < 1 << 30 else np.int64)

    def at_bit(code: Code, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        look = (ahead[:n_bits] if at is here else ahead[np.minimum(at, len(ahead) - 1)]) & ((1 << code.bits) - 1)
        return code.symbols[look], at + code.lengths[look]

    symbol, after = at_bit(green, here)
    channels = []
    for code in (red, blue, alpha):
        if code.bits:
            channel, after = at_bit(code, after)
        else:
            channel = int(code.symbols[0])
        channels.append(channel)
    after = np.minimum(np.where(symbol < LITERALS, after, here), n_bits)
    after = np.append(after, after.dtype.type(n_bits))  # the end and all that isn't a literal lead to themselves
    leap = after
    for _ in range(3):
        leap = leap[leap]
    if green.bits == red.bits == blue.bits == alpha.bits == 0 and green.symbols[0] < LITERALS:
        out[:] = (channels[2] << 24) | (channels[0] << 16) | (int(green.symbols[0]) << 8) | channels[1]
        return
    done, p = 0, first
    while done < len(out):
        if p >= n_bits:
            raise ValueError("the stream ends too early")
        if symbol[p] >= LITERALS:
            bits.at = base + p
            n = _value(green.read(bits) - LITERALS, bits)
            done = _copy(out, done, _distance(_value(dist.read(bits), bits), width), n)
            p = bits.at - base
            continue
        marks, left, jump = [p], (len(out) - done + 7) >> 3, memoryview(leap)
        q = p
        for _ in range(left - 1):
            r = jump[q]
            if r == q:
                break
            marks.append(r)
            q = r
        steps = np.empty((len(marks), 8), after.dtype)
        steps[:, 0] = marks
        for i in range(1, 8):
            steps[:, i] = after[steps[:, i - 1]]
        chain = steps.ravel()
        stuck = np.flatnonzero(after[chain] == chain)
        chain = chain[: min(int(stuck[0]) if len(stuck) else len(chain), len(out) - done)]
        red_, blue_, alpha_ = (c[chain] if isinstance(c, np.ndarray) else c for c in channels)
        out[done : done + len(chain)] = alpha_ << 24 | red_ << 16 | symbol[chain] << 8 | blue_
        done += len(chain)
        p = int(after[chain[-1]])
    bits.at = base + p


def _planes(pixels: np.ndarray) -> np.ndarray:
    """The bytes of each pixel: blue, green, red, alpha."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _packed(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes, np.uint8).view("<u4")[..., 0]


def predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Prediction of pixels (int bytes in the last axis) from left, top, top-right and top-left neighbours."""
    half = lambda a, b: (a + b) >> 1
    if mode == 11:
        over = np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(over, left, top)
    return {
        1: lambda: left,
        2: lambda: top,
        3: lambda: right,
        4: lambda: corner,
        5: lambda: half(half(left, right), top),
        6: lambda: half(left, corner),
        7: lambda: half(left, top),
        8: lambda: half(corner, top),
        9: lambda: half(top, right),
        10: lambda: half(half(left, corner), half(top, right)),
        12: lambda: np.clip(left + top - corner, 0, 255),
        13: lambda: np.clip(half(left, top) + _toward_zero(half(left, top) - corner), 0, 255),
    }.get(mode, lambda: np.broadcast_to(np.array([0, 0, 0, 255]), top.shape))()


def _toward_zero(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * (np.abs(x) >> 1)


def _modes(blocks: np.ndarray, y: int, width: int, size_bits: int) -> np.ndarray:
    return np.repeat((blocks[y >> size_bits] >> 8) & 0xF, 1 << size_bits)[:width]


def _undo_predictor(pixels: np.ndarray, blocks: np.ndarray, size_bits: int) -> np.ndarray:
    out = _planes(pixels).astype(np.int64)
    height, width = pixels.shape
    out[0, 0] = (out[0, 0] + [0, 0, 0, 255]) & 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] = (row[0] + above[0]) & 255
        modes = _modes(blocks, y, width, size_bits)
        right = np.concatenate((above[1:], row[:1]))
        x = 1
        while x < width:  # runs of one mode
            mode = int(modes[x])
            same = np.flatnonzero(modes[x:] != mode)
            end = x + int(same[0]) if len(same) else width
            if mode in (0, 2, 3, 4, 8, 9) or mode > 13:
                row[x:end] = (row[x:end] + predict(mode, above[x:end], above[x:end], right[x:end], above[x - 1 : end - 1])) & 255
            elif mode == 1:
                row[x - 1 : end] = np.cumsum(row[x - 1 : end], axis=0) & 255
            else:
                for i in range(x, end):
                    row[i] = (row[i] + predict(mode, row[i - 1], above[i], right[i], above[i - 1])) & 255
            x = end
    return _packed(out)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.int64) ^ 128) - 128


def _undo_cross_color(pixels: np.ndarray, blocks: np.ndarray, size_bits: int) -> np.ndarray:
    p = _planes(pixels).astype(np.int64)
    height, width = pixels.shape
    m = _planes(np.repeat(np.repeat(blocks, 1 << size_bits, 0)[:height], 1 << size_bits, 1)[:, :width])
    p[..., 2] = (p[..., 2] + (_signed(m[..., 0]) * _signed(p[..., 1]) >> 5)) & 255
    p[..., 0] = (p[..., 0] + (_signed(m[..., 1]) * _signed(p[..., 1]) >> 5) + (_signed(m[..., 2]) * _signed(p[..., 2]) >> 5)) & 255
    return _packed(p)


def _undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    green = (pixels >> np.uint32(8)) & np.uint32(255)
    red_blue = (pixels & np.uint32(0xFF00FF)) + (green << np.uint32(16) | green)
    return (pixels & np.uint32(0xFF00FF00)) | (red_blue & np.uint32(0xFF00FF))


def _index_bits(n_colors: int) -> int:
    return 3 if n_colors <= 2 else 2 if n_colors <= 4 else 1 if n_colors <= 16 else 0


def _undo_color_indexing(pixels: np.ndarray, colors: np.ndarray, width: int) -> np.ndarray:
    index, packed = (pixels >> np.uint32(8)) & np.uint32(255), _index_bits(len(colors))
    if packed:
        each = 8 >> packed
        index = ((index[..., None] >> (np.arange(1 << packed, dtype=np.uint32) * np.uint32(each))) & np.uint32((1 << each) - 1)).reshape(len(pixels), -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(colors)] = colors
    return table[index]


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file (its first VP8L chunk)."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image")
        at += 8 + ((struct.unpack_from("<I", data, at + 4)[0] + 1) & ~1)
    size = struct.unpack_from("<I", data, at + 4)[0]
    bits = Bits(data[at + 8 : at + 8 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOR):
            n = bits.read(3) + 2
            blocks = _read_image(bits, -(-coded >> n), -(-height >> n), False)
            undo.append((_undo_predictor if kind == PREDICTOR else _undo_cross_color, blocks, n))
        elif kind == SUBTRACT_GREEN:
            undo.append((_undo_subtract_green,))
        else:
            n = bits.read(8) + 1
            steps = _planes(_read_image(bits, n, 1, False))[0]
            undo.append((_undo_color_indexing, _packed(np.cumsum(steps, axis=0, dtype=np.uint8)), coded))
            coded = -(-coded >> _index_bits(n))
    pixels = _read_image(bits, coded, height, True)
    for step, *more in reversed(undo):
        pixels = step(pixels, *more)
    return pixels


# Writing


class Sink:
    """Values of given bit lengths, packed least significant bit first."""

    def __init__(self):
        self.values, self.sizes = [], []

    def put(self, value: int, size: int) -> None:
        self.many(np.array([value], np.uint64), np.array([size], np.int64))

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values.append(values)
        self.sizes.append(sizes)

    def data(self) -> bytes:
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        keep = sizes > 0
        values, sizes = values[keep], sizes[keep]
        ends = np.cumsum(sizes)
        starts, total = ends - sizes, int(ends[-1])
        word, shift = starts >> 6, (starts & 63).astype(np.uint64)
        out = np.zeros((total >> 6) + 2, np.uint64)
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[heads]] = np.bitwise_or.reduceat(values << shift, heads)
        over = np.flatnonzero((starts & 63) + sizes > 64)
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        return out.tobytes()[: (total + 7) >> 3]


def huffman(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Code lengths of the symbols with a count; flattened counts are used until no length is over `most`."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used]
    while True:
        heap = [(int(w), i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, n = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heap[0]
            parent[a[1]] = parent[b[1]] = n
            heapq.heapreplace(heap, (a[0] + b[0], n))
            n += 1
        depth = [0] * n
        for i in range(n - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(used)]) <= most:
            lengths[used] = depth[: len(used)]
            return lengths
        weights = weights // 2 + 1


_META = reversed_codes(np.array(FIXED_CODE_LENGTHS, np.int64)).tolist()
#: What stands before the code lengths: a normal code, all 19 lengths of the code-length code, no limit of symbols.
_CODE_HEADER = 15 << 1 | sum(FIXED_CODE_LENGTHS[symbol] << (5 + 3 * i) for i, symbol in enumerate(CODE_LENGTH_ORDER))


def _write_code(sink: Sink, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes the prefix code for the counts; codes and lengths by symbol."""
    used = np.flatnonzero(counts)
    if len(used) < 2 and (not len(used) or used[0] < 256):
        sink.put(1 | 4 | int(used[0] if len(used) else 0) << 3, 11)  # simple code, one symbol of 8 bits
        return np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.int64)
    lengths = huffman(counts)
    if len(used) == 1:
        lengths[(used[0] + 1) % len(counts)] = 1  # a second symbol makes the code complete
    sink.put(_CODE_HEADER, 63)
    tokens, sizes = [], []
    edges = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(lengths)]
    for start, end in zip(edges, edges[1:]):
        value, n = int(lengths[start]), end - start
        while n:
            if value or n < 3:
                token, take, extra, size = value, 1, 0, 0
            elif n < 11:
                token, take, extra, size = 17, n, n - 3, 3
            else:
                take = min(n, 138)
                token, extra, size = 18, take - 11, 7
            tokens.append(_META[token] | extra << FIXED_CODE_LENGTHS[token])
            sizes.append(FIXED_CODE_LENGTHS[token] + size)
            n -= take
    sink.many(np.array(tokens, np.uint64), np.array(sizes, np.int64))
    return reversed_codes(lengths).astype(np.uint64), lengths


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    high = value.bit_length() - 1
    second = (value >> (high - 1)) & 1
    return 2 * high + second, value & ((1 << (high - 1)) - 1), high - 1


def copies(flat: np.ndarray, shortest: int = 8) -> list[tuple[int, int, int]]:
    """Runs of one pixel as (start, length, distance 1), left to right, at most MAX_COPY long."""
    edges = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    starts = np.concatenate(([0], edges))
    lengths = np.diff(np.append(starts, len(flat))) - 1
    out = []
    for at in np.flatnonzero(lengths >= shortest):
        start, left = int(starts[at]) + 1, int(lengths[at])
        while left >= shortest:
            n = min(left, MAX_COPY)
            out.append((start, n, 1))
            start, left = start + n, left - n
    return out


def _write_image(sink: Sink, pixels: np.ndarray, main: bool, cache_bits: int = 0, refs: list[tuple[int, int, int]] | None = None) -> None:
    """An entropy-coded image with one code group; refs: back-references (start, length, distance), in order."""
    flat = pixels.ravel()
    refs = copies(flat) if refs is None else refs
    sink.put(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    if main:
        sink.put(0, 1)
    literal = np.ones(len(flat), bool)
    for start, n, _ in refs:
        literal[start : start + n] = False
    p = _planes(flat)
    green = p[:, 1].astype(np.int64)
    cached = np.zeros(len(flat), bool)
    if cache_bits:
        slot = ((flat.astype(np.uint64) * np.uint64(CACHE_MULTIPLIER)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)
        order = np.argsort(slot, kind="stable")
        hit = (slot[order][1:] == slot[order][:-1]) & (flat[order][1:] == flat[order][:-1])
        cached[order[1:][hit]] = True
        cached &= literal
        green = np.where(cached, LITERALS + LENGTH_CODES + slot.astype(np.int64), green)
    plain = literal & ~cached
    starts = np.array([r[0] for r in refs], np.int64)
    lengths = [_prefix(r[1]) for r in refs]
    distances = [_prefix(r[2] + len(NEAR) if r[2] > 1 else 2) for r in refs]
    green_counts = np.bincount(np.concatenate((green[literal], [LITERALS + x[0] for x in lengths])).astype(np.int64), minlength=LITERALS + LENGTH_CODES + (1 << cache_bits if cache_bits else 0))
    code, size = _write_code(sink, green_counts)
    values, sizes = np.where(literal, code[green], np.uint64(0)), np.where(literal, size[green], 0)
    for channel in (2, 0, 3):
        c, n = _write_code(sink, np.bincount(p[plain, channel], minlength=256))
        if n.any():
            at = p[:, channel]
            values = np.where(plain, values | c[at] << sizes.astype(np.uint64), values)
            sizes = np.where(plain, sizes + n[at], sizes)
    dist_code, dist_size = _write_code(sink, np.bincount([x[0] for x in distances], minlength=DISTANCE_CODES))
    for start, (sym, extra, n), (dsym, dextra, dn) in zip(starts, lengths, distances, strict=True):
        g = LITERALS + sym
        value, used = int(code[g]), int(size[g])
        for v, bits in ((extra, n), (int(dist_code[dsym]), int(dist_size[dsym])), (dextra, dn)):
            value, used = value | v << used, used + bits
        values[start], sizes[start] = value, used
    sink.many(values, sizes)


def encode(
    pixels: np.ndarray,
    *,
    subtract_green: bool = False,
    palette: bool = False,
    predictor: np.ndarray | None = None,
    cross: np.ndarray | None = None,
    block_bits: int = 4,
    cache_bits: int = 0,
    refs: list[tuple[int, int, int]] | None = None,
) -> bytes:
    """A lossless WebP file. predictor and cross are block images (modes in green; multipliers) of 2**block_bits pixels a side."""
    height, width = pixels.shape
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError("sides are 1 to 16384 pixels")
    sink = Sink()
    sink.put(0x2F, 8)
    sink.put(width - 1, 14)
    sink.put(height - 1, 14)
    sink.put(1, 4)
    pixels = np.ascontiguousarray(pixels, np.uint32)
    if palette:
        colors, index = np.unique(pixels, return_inverse=True)
        if len(colors) > 256:
            raise ValueError("over 256 colours")
        sink.put(1 | COLOR_INDEXING << 1 | (len(colors) - 1) << 3, 11)
        _write_image(sink, _packed(np.diff(_planes(colors), axis=0, prepend=np.zeros((1, 4), np.uint8)))[None, :], False)
        index, packed = index.reshape(height, width).astype(np.uint32), _index_bits(len(colors))
        if packed:
            each, n = 8 >> packed, 1 << packed
            index = np.pad(index, ((0, 0), (0, -width % n))).reshape(height, -1, n)
            index = np.bitwise_or.reduce(index << (np.arange(n, dtype=np.uint32) * np.uint32(each)), axis=2)
        pixels = np.uint32(0xFF000000) | index << np.uint32(8)
        width = pixels.shape[1]
    if subtract_green:
        sink.put(1 | SUBTRACT_GREEN << 1, 3)
        p = _planes(pixels).copy()
        p[..., 0] -= p[..., 1]
        p[..., 2] -= p[..., 1]
        pixels = _packed(p)
    if predictor is not None:
        sink.put(1 | PREDICTOR << 1 | (block_bits - 2) << 3, 6)
        _write_image(sink, predictor, False)
        pixels = _predicted(pixels, predictor, block_bits)
    if cross is not None:
        sink.put(1 | CROSS_COLOR << 1 | (block_bits - 2) << 3, 6)
        _write_image(sink, cross, False)
        p = _planes(pixels).astype(np.int64)
        m = _planes(np.repeat(np.repeat(cross, 1 << block_bits, 0)[:height], 1 << block_bits, 1)[:, :width])
        p[..., 0] -= (_signed(m[..., 1]) * _signed(p[..., 1]) >> 5) + (_signed(m[..., 2]) * _signed(p[..., 2]) >> 5)
        p[..., 2] -= _signed(m[..., 0]) * _signed(p[..., 1]) >> 5
        pixels = _packed(p & 255)
    sink.put(0, 1)
    _write_image(sink, pixels, True, cache_bits, refs)
    data = sink.data()
    data += b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


def _predicted(pixels: np.ndarray, blocks: np.ndarray, size_bits: int) -> np.ndarray:
    """What is left of pixels after prediction."""
    p = _planes(pixels).astype(np.int64)
    out = p.copy()
    height, width = pixels.shape
    out[0, 1:] -= p[0, :-1]
    out[0, 0] -= [0, 0, 0, 255]
    for y in range(1, height):
        out[y, 0] -= p[y - 1, 0]
        modes = _modes(blocks, y, width, size_bits)
        right = np.concatenate((p[y - 1, 1:], p[y, :1]))
        for mode in np.unique(modes[1:]):
            at = np.flatnonzero(modes[1:] == mode) + 1
            out[y, at] -= predict(int(mode), p[y, at - 1], p[y - 1, at], right[at], p[y - 1, at - 1])
    return _packed(out & 255)
