import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from tidemark.llm import piecewise

ODD = ["", " ", "   ", "▁", "a▁b", "\n\t \r\n", "\x00", "Hello  world", "ﷺ é ñ 漢字かな 😀👨‍👩‍👧", "�", "x" * 3000, " " * 501, "ab" * 2000, "漢" * 700 + "z", "don't 12,345.678 -- ...\n\n"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=public_tokenizers.path(piecewise.MODEL))


def plain(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return ids, library.decode(ids)


def test_texts_encode_and_decode_as_the_library_does(library):
    r, own = random.Random(3), piecewise.pieces()
    some = [" ", "  ", "▁", "a", "th", "e", "ing", "é", "漢", "字", "😀", "\n", "1", "-", "ß", "не", " the", "ation"]
    vocabulary = list(own.ids)
    made = ["".join(r.choice(some) for _ in range(r.randint(0, 30))) for _ in range(1500)] + ["".join(r.choice(vocabulary) for _ in range(6)) for _ in range(1500)]
    for text in ODD + made:
        ids, back = plain(library, text)
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert own.decode(packed) == back


def test_backtracking_equals_merging_without_cuts_or_memory():
    r, own = random.Random(5), piecewise.pieces()
    for _ in range(800):
        text = "".join(r.choice("▁▁theraninsco漢é") for _ in range(r.randint(1, 25)))
        assert own.backtracked(text) == own.merged(text)


def test_any_ids_decode_as_in_the_library(library):
    r, own = random.Random(4), piecewise.pieces()
    for _ in range(3000):
        ids = [r.choice((r.randrange(32000), r.randrange(3, 259), r.randrange(3))) for _ in range(r.randint(0, 9))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_tables(spark, library):
    texts = [*ODD, None, "same", "same"]
    docs = spark.createDataFrame([(i if i else None, t, "mine", 7) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    got = {r.doc_id: r for r in piecewise.digest(piecewise.decoded(piecewise.encoded(docs))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids, back = plain(library, t)
        r = got[i or None]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert piecewise.decoded(piecewise.encoded(docs.limit(0))).count() == 0
    kept = piecewise.decoded(piecewise.encoded(docs)).columns
    assert kept == ["doc_id", "text", "ids", "n_tokens", "decoded"]
