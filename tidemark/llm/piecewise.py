"""SentencePiece encoding of merge type: backtracking over longest matches, and decoding.

A merge-type vocabulary joins, again and again, the two neighbours whose joint piece has the highest score (ties: the
leftmost). What comes out is the one sequence of pieces in which each piece and each pair of neighbours is what merging
their own text alone gives: a merge over a border of such a sequence would have come first in that pair alone, too.
So a text is covered from the left with the longest pieces; a piece that doesn't fit its left neighbour gives way to the
next shorter one, and a place that no piece leads on from is marked and never tried again.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands for a blank in pieces.
BLANK = "▁"
#: The vocabulary file that is read where a call names none; each machine has it.
MODEL = "piece_bpe_32k.model"
#: Parts of texts whose tokens a worker remembers (twice as many at most), and their length in characters at most.
REMEMBERED, SHORT = 1 << 17, 64
#: Characters of a text that are looked at at once for places to cut.
SLICE = 1 << 18
#: Bytes of texts that a worker turns into one Arrow batch.
BATCH_BYTES = 8 << 20


class Pieces:
    """A vocabulary of merge type with byte fallback: encodes and decodes single texts."""

    def __init__(self, model: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        kinds = [(i, sp.id_to_piece(i)) for i in range(sp.get_piece_size())]
        plain = [(i, p) for i, p in kinds if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.bos, self.eos, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.ids = {p: i for i, p in plain}
        self.scores = {p: sp.get_score(i) for i, p in plain}
        self.bytes = {int(p[3:5], 16): i for i, p in kinds if sp.is_byte(i)}
        self.forms: list[bytes] = [b""] * len(kinds)  # what each id decodes to
        self.kind = np.zeros(len(kinds), np.uint8)  # 0: none, 1: piece, 2: byte
        for i, p in plain:
            self.forms[i], self.kind[i] = p.replace(BLANK, " ").encode(), 1
        for b, i in self.bytes.items():
            self.forms[i], self.kind[i] = bytes([b]), 2
        self.forms[self.unknown], self.kind[self.unknown] = " ⁇ ".encode(), 1
        self.leads = np.array([k == 1 and f.startswith(b" ") and i != self.unknown for i, (f, k) in enumerate(zip(self.forms, self.kind, strict=True))])
        # a text can be cut between two characters that no piece holds side by side; others may share a place in this table
        self.joined = np.zeros(1 << 20, bool)
        for p in self.ids:
            self.joined[self._pairs(p)] = True
        # the automaton reads backwards, so that matches that end at a place are those that begin there
        self.matches = ahocorasick.Automaton()
        for p in self.ids:
            self.matches.add_word(p[::-1], p)
        self.matches.make_automaton()
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), p[0] if len(p) > 1 else None) for p in self.ids}
        self.fits = functools.lru_cache(1 << 18)(self._fits)
        self.memo: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}  # of late, and before

    @staticmethod
    def _pairs(text: str) -> np.ndarray:
        """Places of all pairs of neighbours in the table of those that pieces hold."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return (points[:-1] * np.uint32(0x9E3779B1) ^ points[1:] * np.uint32(0x85EBCA77)) >> np.uint32(12)

    def parts(self, text: str) -> Iterator[str]:
        """The text, cut where no piece can reach across."""
        begin = 0
        for at in range(0, len(text), SLICE):
            for end in (np.flatnonzero(~self.joined[self._pairs(text[at : at + SLICE + 1])]) + at + 1).tolist():
                yield text[begin:end]
                begin = end
        yield text[begin:]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging neighbours, the highest score and then the leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        """Whether merging the text of the two gives the two again; without a left one, whether a piece gives itself."""
        return self.merged(left + right) == ([left, right] if left else [right])

    def longest(self, text: str) -> list[str]:
        """The longest piece that begins at each place; a character without a piece stands for itself."""
        out, n = list(text), len(text)
        for end, piece in self.matches.iter(text[::-1]):
            at = n - 1 - end
            if len(piece) > len(out[at]):
                out[at] = piece
        return out

    def backtracked(self, text: str) -> list[str]:
        """The pieces of a text of any length."""
        n, longest = len(text), self.longest(text)
        failed = bytearray(n // 8 + 1)  # a bit for each place that no piece leads on from
        tokens: list[str] = []
        at, piece = 0, longest[0] if n else None
        while at < n:
            while piece:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and self.fits(tokens[-1] if tokens else "", piece):
                    break
                piece = self.shorter.get(piece)
            if piece:
                tokens.append(piece)
                at = end
                piece = longest[at] if at < n else None
            else:
                failed[at >> 3] |= 1 << (at & 7)
                last = tokens.pop()
                at -= len(last)
                piece = self.shorter.get(last)
        return tokens

    def _packed(self, part: str) -> bytes:
        found: list[int] = []
        for p in self.backtracked(part):
            i = self.ids.get(p)
            found += [i] if i is not None else [self.bytes.get(b, self.unknown) for b in p.encode()] if self.bytes else [self.unknown]
        return np.array(found, "<u4").tobytes()

    def part(self, part: str) -> bytes:
        if len(part) > SHORT:
            return self._packed(part)
        late, before = self.memo
        found = late.get(part)
        if found is None:
            found = before.get(part) or self._packed(part)
            if len(late) >= REMEMBERED:
                self.memo = late, before = {}, late
            late[part] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text with begin and end, as little-endian unsigned 32-bit integers."""
        body = b"".join(map(self.part, self.parts(BLANK + text.replace(" ", BLANK)))) if text else b""
        return np.uint32(self.bos).astype("<u4").tobytes() + body + np.uint32(self.eos).astype("<u4").tobytes()

    def decode(self, packed: bytes) -> str:
        """The text of any ids: no begin and end, without the one blank that encoding puts first; byte pieces that are
        no UTF-8 give U+FFFD each."""
        ids = np.frombuffer(packed, "<u4")
        said = np.flatnonzero(self.kind[ids])
        if not len(said):
            return ""
        ids = ids[said[0] : said[-1] + 1]
        lead, raw = int(self.leads[ids[0]]), b"".join(map(self.forms.__getitem__, ids.tolist()))
        if len(said) == len(ids):  # else a begin or end between bytes parts what would be one character
            try:
                return raw.decode()[lead:]
            except UnicodeDecodeError:
                pass
        out = []
        for run in np.split(ids, np.flatnonzero(np.diff(self.kind[ids])) + 1):
            raw = b"".join(map(self.forms.__getitem__, run.tolist()))
            out.append(_each_bad_byte(raw) if self.kind[run[0]] == 2 else raw.decode())
        return "".join(out)[lead:]


def _each_bad_byte(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@functools.cache
def pieces(model: str | None = None) -> Pieces:
    """The vocabulary of a file, once in a worker; without a name, that of the public tokenizers."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(MODEL)
    return Pieces(model)


def _mapped(df: DataFrame, source: str, out: T.StructType, of) -> DataFrame:
    """df with the columns of `out`, which `of` gives for a value of `source`; batches are cut by bytes."""
    names = [f.name for f in out]
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([*(df.schema[c] for c in kept), *out])
    kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.large_string() for f in out]
    place = kept.index(source) if source in kept else len(kept)
    given = df.select(*(F.col(f"`{c}`") for c in kept), *([] if source in kept else [F.col(f"`{source}`").alias("__given")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, batch.nbytes // max(1, batch.num_rows))
            step = max(1, BATCH_BYTES // size)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                made = zip(*(of(x) for x in part.column(place).to_pylist()), strict=True)
                arrays = [pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)]
                arrays = [a.cast(pa.string()) if pa.types.is_large_string(a.type) else a for a in arrays]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *arrays], names=[*kept, *names])

    return given.mapInArrow(run, schema)


def encoded(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """docs with ids (little-endian unsigned 32-bit integers as binary, begin and end included) and n_tokens.

    The ids are those of the sentencepiece library. A null text counts as empty: begin and end alone; texts are whole,
    of any length; repeated rows are encoded alike; an empty table stays empty; columns that are named ids and n_tokens
    are replaced. No shuffle.
    """

    def of(x: str | None) -> tuple[bytes, int]:
        found = pieces(model).encode(x or "")
        return found, len(found) // 4

    return _mapped(docs, text, T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]), of)


def decoded(tokens: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """tokens with decoded, the text of the ids; null ids give an empty text, ids that are no whole pieces U+FFFD.

    A column that is named decoded is replaced. No shuffle.
    """
    return _mapped(tokens, ids, T.StructType([T.StructField("decoded", T.StringType())]), lambda x: (pieces(model).decode(x or b""),))


def digest(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, and checksums of ids and decoded."""
    return tokens.select(key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
