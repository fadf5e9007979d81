import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import repeats


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randrange(10, 40)) for _ in range(5)]
    texts = [None, "", "short", "ab" * 400, "q" * 300, prose(90)]
    for _ in range(50):
        texts.append(" ".join(rng.choice(passages) if rng.random() < 0.4 else prose(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 6))))
    texts += [texts[5]] * 4 + [texts[5][:150] + "!" + texts[5][151:], passages[0][:39], passages[0][:40]]
    return texts


@pytest.mark.parametrize("seed,hot", [(1, 1000), (2, 1), (3, 4), (4, 0)])
def test_matches_brute_force(spark, seed, hot):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, raw string, start int")
    got = repeats.digest(repeats.drop_repeats(docs, length=40, gram=8, hot=hot)).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == brute(texts, 40)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got if "\ufffd" not in r.kept_text)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 64)
    rng = random.Random(5)
    a, b = (bytes(rng.choice(b"abcdefgh") for _ in range(900)) for _ in range(2))
    raw = a + b + a
    runs = list(repeats.minimizer_runs(raw, 40, 8))
    assert sum(n for _, n, _, _ in runs) == len(raw) - 39 and runs[0][0] == 0
    keys = {}
    for start, n, place, mini in runs:
        for i in range(start, start + n):
            assert 0 <= start + place - i <= 32
            assert keys.setdefault(raw[i : i + 40], mini) == mini


def test_query_at_full_length(spark):
    rng = random.Random(9)
    prose = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400))
    texts = [prose, prose[100:600], "x " + prose[300:900], prose[:399], None, "z" * 401, "z" * 399, "lone " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = repeats.digest(repeats.drop_repeats(docs)).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == brute(texts, 400)
    assert repeats.drop_repeats(docs.limit(0)).count() == 0


def test_planted_passages(spark):
    """Shared passages of over 50 words go where they have 400 bytes; shorter ones and clean texts stay, whatever their size."""
    rng = random.Random(13)
    word = lambda least, most: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(least, most)))
    prose = lambda n, least=2, most=9: " ".join(word(least, most) for _ in range(n))
    rows = []  # text, passage, whether it goes
    for k in range(20):
        passage = prose(60, 7, 9) if k % 2 else prose(55, 2, 6)
        rows += [(f"{prose(30 + k)} {passage} {prose(20 + 9 * i)}", passage, bool(k % 2)) for i in range(2 + k % 3)]
    rows += [(prose(51 + 10 * i), None, False) for i in range(30)]
    assert all(len(p.split()) > 50 and (len(p.encode()) >= 400) == goes and abs(len(p.encode()) - 400) > 8 for _, p, goes in rows if p)
    docs = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id long, text string")
    got = repeats.digest(repeats.drop_repeats(docs)).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == brute([r[0] for r in rows], 400)
    for (text, passage, goes), r in zip(rows, got, strict=True):
        assert r.n_bytes == len(text.encode())  # of the input: it doesn't tell what was removed
        assert ((r.n_removed > 0), r.n_spans) == (goes, int(goes))
        assert passage not in r.kept_text if goes else r.kept_text == text


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab" if seed % 2 else b"abcd") for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(1, 9))]
    strings += strings[:2]
    index = repeats.RunLengthIndex(strings)
    ms = index.matching_statistics()
    suffixes = [(k, i) for k, s in enumerate(strings) for i in range(len(s))]
    common = lambda x, y: next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    for k, i in suffixes:
        want = max((common(strings[k][i:], strings[m][j:]) for m, j in suffixes if (m, j) != (k, i)), default=0)
        assert ms[index.offsets[k] + i] == want
    assert index.lengths.sum() == index.n


@pytest.mark.parametrize("seed", range(4))
def test_copies_count_as_strings_of_their_own(seed):
    rng = random.Random(seed)
    strings = list({bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 9))})
    copies = [rng.randrange(1, 4) for _ in strings]
    index = repeats.RunLengthIndex(strings, copies)
    spelled = repeats.RunLengthIndex([s for s, n in zip(strings, copies) for _ in range(n)])
    first = np.cumsum([0] + copies[:-1])
    for length in (1, 3, 8):
        every = spelled.repeated(length)
        assert [x.tolist() for x in index.repeated(length)] == [every[i].tolist() for i in first]
    assert index.lengths.sum() == spelled.n and len(index.lengths) <= index.n
