import hashlib
import zlib

import numpy as np
import pytest

from tidemark.llm import media, webp


def noise(h, w, colors=0, seed=0):
    rng = np.random.default_rng(seed)
    if colors:
        return rng.integers(0, 1 << 32, colors, dtype=np.uint32)[rng.integers(0, colors, (h, w))]
    ramp = (np.add.outer(np.arange(h), np.arange(w)) % 200).astype(np.uint32)
    return np.uint32(0xFF000000) | ramp << np.uint32(16) | (ramp // 2) << np.uint32(8) | rng.integers(0, 30, (h, w), dtype=np.uint32)


@pytest.mark.parametrize("h,w", [(1, 1), (1, 7), (5, 1), (17, 33), (40, 23)])
@pytest.mark.parametrize("cache", [0, 1, 6, 11])
def test_round_trip_plain_and_cached(h, w, cache):
    for px in (noise(h, w), noise(h, w, 3), np.full((h, w), 0x01020304, np.uint32)):
        assert (webp.decode(webp.encode(px, cache_bits=cache)) == px).all()
        assert (webp.decode(webp.encode(px, cache_bits=cache, subtract_green=True)) == px).all()


@pytest.mark.parametrize("colors", [1, 2, 3, 4, 9, 16, 17, 200])
def test_round_trip_palette(colors):
    px = noise(13, 21, colors, colors)
    assert (webp.decode(webp.encode(px, palette=True)) == px).all()


@pytest.mark.parametrize("mode", range(14))
def test_round_trip_predictor(mode):
    px = noise(19, 37, seed=mode)
    blocks = np.full((5, 10), mode << 8, np.uint32)
    assert (webp.decode(webp.encode(px, predictor=blocks, block_bits=2)) == px).all()
    mixed = (np.random.default_rng(mode).integers(0, 14, (5, 10)) << 8).astype(np.uint32)
    assert (webp.decode(webp.encode(px, predictor=mixed, block_bits=2, subtract_green=True)) == px).all()


def test_round_trip_cross_color_and_all():
    px = noise(19, 37)
    cross = np.random.default_rng(1).integers(0, 1 << 24, (5, 10), dtype=np.uint32)
    modes = (np.random.default_rng(2).integers(0, 14, (5, 10)) << 8).astype(np.uint32)
    assert (webp.decode(webp.encode(px, cross=cross, block_bits=2)) == px).all()
    assert (webp.decode(webp.encode(px, cross=cross, predictor=modes, block_bits=2, subtract_green=True, cache_bits=5)) == px).all()


def test_back_references_far_and_overlapping():
    row = noise(1, 60)
    px = np.concatenate([row, row, row[:, ::-1], row])
    refs = [(60, 60, 60), (180, 60, 120)]
    assert (webp.decode(webp.encode(px, refs=refs)) == px).all()
    assert (webp.decode(webp.encode(px, refs=refs, cache_bits=4)) == px).all()
    tile = np.resize(row[:, :3], (1, 60))
    assert (webp.decode(webp.encode(tile, refs=[(3, 57, 3)])) == tile).all()


def test_near_distance_codes():
    assert webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)]
    assert webp.NEAR[-4:] == [(7, 7), (-7, 7), (8, 6), (8, 7)] and len(webp.NEAR) == 120
    assert webp._distance(1, 50) == 50 and webp._distance(2, 50) == 1 and webp._distance(121, 50) == 1


def test_several_code_groups():
    """A stream with an entropy image, put together by hand."""
    sink = webp.Sink()
    for value, size in ((0x2F, 8), (7, 14), (3, 14), (0, 4), (0, 1), (0, 1), (1, 1), (0, 3)):
        sink.put(value, size)
    webp._write_image(sink, np.array([[0, 1 << 8]], np.uint32), False, refs=[])
    for symbol in (10, 20):
        for value in (symbol, 1, 2, 255):
            sink.put(1 | 4 | value << 3, 11)
        sink.put(1 | 4, 11)
    data = sink.data()
    data += b"\0" * (8 + len(data) % 2)
    px = webp.decode(b"RIFF" + (12 + len(data)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data)
    assert px.shape == (4, 8) and (px[:, :4] >> 8 & 255 == 10).all() and (px[:, 4:] >> 8 & 255 == 20).all()


def test_broken_streams_are_refused():
    good = webp.encode(noise(9, 9))
    with pytest.raises(ValueError):
        webp.decode(good[: len(good) // 2])
    with pytest.raises(ValueError):
        webp.decode(b"no image at all")


def test_media_query_over_odd_texts(spark):
    texts = ["", None, "a", "x" * 576, "x" * 577, "é\n" * 3000, "abc" * 30000, "a"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = {r.doc_id: r for r in media.media_digest(media.media_table(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(want), hashlib.sha256(want).hexdigest())
        assert r.tail_crc32 == zlib.crc32(want[-32:]) and r.media_bytes > 0
    assert rows[2][1:] == rows[7][1:] and rows[0][1:] == rows[1][1:]
    one = media.media_table(docs).where("doc_id = 2").select(media.decoded("media").alias("m")).first().m[0]
    assert (one.width, one.height) == (576, 1) and one.pixels[:4] == b"aaa\xff"
    assert media.media_digest(media.media_table(docs.limit(0))).count() == 0


def test_payload_of_several_images():
    payload = bytes(range(192)) * 3 * (media.ROWS + 2)
    stored = media.store(payload)
    assert media.restore(stored) == payload and len(list(media.images(stored))) == 2


def test_forms_by_content():
    text = ("The quick brown fox jumps over the lazy dog, 0123456789. " * 60).encode()
    ramp = bytes(i % 251 for i in range(576 * 4))
    row = bytes(np.random.default_rng(1).integers(0, 200, 576, dtype=np.uint8))
    chosen = lambda p: media.form(np.frombuffer(media.padded(p), np.uint8).reshape(-1, 576))
    assert chosen(b"ab" * 700) == {"palette": True} and chosen(text) == {"subtract_green": True}
    assert chosen(ramp)["predictor"][0, 0] == 1 << 8 and chosen(row * 20)["predictor"][0, 0] == 2 << 8
    for p in (b"", b"ab" * 700, text, ramp, row * 20, bytes(range(256)) * 9, row * 700):
        assert media.restore(media.store(media.padded(p))) == media.padded(p)


class Pen:
    """Bits of a stream written by hand, least significant first; no part of the encoder is used."""

    def __init__(self, width, height):
        self.bits = ""
        self(0x2F, 8)(width - 1, 14)(height - 1, 14)(1, 1)(0, 3)

    def __call__(self, value, size):
        self.bits += "".join(str(value >> i & 1) for i in range(size))
        return self

    def one(self, symbol):
        """A prefix code of one symbol."""
        return self(1, 1)(0, 1)(1, 1)(symbol, 8)

    def two(self, a, b):
        """A prefix code of two symbols; the smaller one is bit 0."""
        return self(1, 1)(1, 1)(1, 1)(a, 8)(b, 8)

    def file(self):
        bits = self.bits + "0" * (-len(self.bits) % 16)
        data = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        return b"RIFF" + (12 + len(data)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data


def argb(a, r, g, b):
    return a << 24 | r << 16 | g << 8 | b


def test_a_palette_written_by_hand():
    pen = Pen(10, 1)(1, 1)(3, 2)(1, 8)  # a palette of two colours: eight pixels a byte
    pen(0, 1).two(20, 6).two(10, 5).two(30, 7).two(255, 0).one(0)
    pen(0b1111, 4)(0b0000, 4)  # the first colour, then what the second one adds
    pen(0, 1)(0, 1)(0, 1).two(0x55, 3).one(0).one(0).one(255).one(0)
    pen(1, 1)(0, 1)
    first, second = argb(255, 10, 20, 30), argb(255, 15, 26, 37)
    assert webp.decode(pen.file()).tolist() == [[second if x else first for x in (1, 0, 1, 0, 1, 0, 1, 0, 1, 1)]]


def test_cross_colour_written_by_hand():
    pen = Pen(3, 2)(1, 1)(1, 2)(0, 3)  # blocks of four pixels: one multiplier
    pen(0, 1).one(0).one(16).one(32).one(255).one(0)
    pen(0, 1)(0, 1)(0, 1).one(9).one(4).one(1).one(255).one(0)
    assert webp.decode(pen.file()).tolist() == [[argb(255, 13, 9, 7)] * 3] * 2  # 4 + 9, then 1 + 13 / 2


def test_predictors_written_by_hand():
    for mode, want in ((1, [[1, 2, 3], [2, 3, 4]]), (2, [[1, 2, 3], [2, 3, 4]]), (0, [[1, 2, 3], [2, 1, 1]])):
        pen = Pen(3, 2)(1, 1)(0, 2)(0, 3)
        pen(0, 1).one(mode).one(0).one(0).one(255).one(0)
        pen(0, 1)(0, 1)(0, 1).one(1).one(1).one(1).one(0).one(0)
        assert webp.decode(pen.file()).tolist() == [[argb(255, x, x, x) for x in row] for row in want]
