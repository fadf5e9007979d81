import random

import numpy as np
import pytest

from tidemark.llm import decontamination as dc


def plain(item, passage):
    """The best local score by a plain table."""
    best, rows = 0, [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if item[i - 1] == passage[j - 1] else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
            best = max(best, rows[i][j])
    return best


@pytest.mark.parametrize("seed", range(20))
def test_alignment_scores(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
    score, equal, i, m, j, n = dc.align(np.array(a, np.uint64), np.array(b, np.uint64))
    assert score == plain(a, b)
    assert equal <= min(m - i, n - j) and plain(a[i:m], b[j:n]) == score


def test_edited_copies_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 12, 25, 60, 60])] + [(50, None), (51, ""), (3, "twice this id stands in the table here")]
    docs, want = [(900, None), (901, ""), (902, "clean " + " ".join(word() for _ in range(300)))], set()
    for d in range(200):
        k = d % 5
        words = items[k][1].split()
        for _ in range(len(words) * (d % 4) // 20):  # up to 15 % edits: another word, one more, one less
            at = rng.randrange(1, len(words) - 1)
            words[at : at + 1] = rng.choice([[word()], [words[at], word()], []])
        docs.append((d, " ".join(word() for _ in range(d)) + ". " + ", ".join(words).upper() + "! " + " ".join(word() for _ in range(d % 7))))
        want.add((d, k))
    rows = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.leaks(rows, bench).collect()
    assert want <= {(r.doc_id, r.item_id) for r in got} and {r.doc_id for r in got} <= {d for d, _ in want}
    for r in got:
        assert r.similarity >= 0.8
        passage = dict(docs)[r.doc_id][r.start : r.end]
        assert r.equal_words >= 0.8 * len(passage.replace("!", " ").replace(",", " ").split())
    assert sorted(r.doc_id for r in dc.drop_leaks(rows, bench).collect()) == [900, 901, 902]
    assert dc.leaks(rows.limit(0), bench).count() == 0 and dc.leaks(rows, bench.limit(0)).count() == 0
    assert dc.drop_leaks(rows, bench.limit(0)).columns == rows.columns


def test_a_full_filter_gives_the_same_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"start of {i} " + " ".join(f"w{i % 6}x{j}" for j in range(20))) for i in range(40)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(6)], "item_id long, text string")
    whole = sorted(dc.leaks(docs, bench).collect())
    monkeypatch.setattr(dc, "FILTER_BITS", (6, 6))
    assert sorted(dc.leaks(docs, bench).collect()) == whole and len(whole) == 40


def test_repeated_rows_and_clashing_names(spark):
    item = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, item, 7, "d"), (1, item, 7, "d"), (None, item, 8, "e"), (2, "nothing", 9, "f")], "doc_id long, text string, seed int, digest string")
    bench = spark.createDataFrame([(5, item), (5, item), (None, item)], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([(d, i) for d in (1, 1, None) for i in (5, 5, None)], key=str)
    assert [tuple(r) for r in dc.drop_leaks(docs, bench).collect()] == [(2, "nothing", 9, "f")]


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row


def brute(docs, items, similarity=0.8):
    """Pairs by the words in common order of each item and each passage of each whole text."""
    out = set()
    for d, t in docs:
        h = dc.tokens(t)[0].tolist()
        for k, i in items:
            w = dc.tokens(i)[0].tolist()
            most = int(len(w) / similarity + 1e-9)
            if len(set(w) & set(h)) * 2 < len(set(w)):
                continue
            for at in range(len(h)):
                row = common(w, h[at : at + most])
                if any(c >= similarity * max(len(w), n) - 1e-9 for n, c in enumerate(row) if n):
                    out.add((d, k))
                    break
    return out


def test_decoys_before_after_and_inside_hide_nothing(spark):
    item = [f"i{j}" for j in range(20)]
    groups = [*item[:5], "x0", "x1", "x2", *item[5:10], "x3", "x4", "x5", *item[10:15], "x6", "x7", "x8", *item[15:]]  # all words, similarity 20 / 29
    copy = [*item[:4], "y0", *item[5:9], "y1", *item[10:14], "y2", *item[15:18], "y3", item[19]]
    fill = ["f0", "f1", "f2"]
    texts = {
        0: [*groups, *fill, *copy], 1: [*copy, *fill, *groups], 2: [*groups, *copy], 3: [*copy, *groups], 4: [*groups, *fill, *copy, *fill, *groups],
        5: [*item[:6], *copy, *item[14:]], 6: [*item[10:], *fill, *copy[:10], *copy[10:], *item[:8]], 7: groups, 8: [*groups, *fill, *groups], 9: [*item[:9], *fill, *item[:9]],
    }
    docs = [(d, " ".join(["some", *t, "end"])) for d, t in texts.items()]
    bench = [(1, " ".join(item))]
    assert brute(docs, bench) == {(d, 1) for d in range(7)}
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(7)) and all(r.similarity >= 0.8 for r in got)
    kept = dc.drop_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [7, 8, 9]


@pytest.mark.parametrize("seed", range(3))
def test_same_pairs_as_alignment_of_everything(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(4))
    frame = [word() for _ in range(24)]
    items = [(k, " ".join(word() if rng.random() < 0.12 else w for w in frame)) for k in range(25)]  # siblings of one frame
    items += [(100 + k, " ".join(word() for _ in range(rng.randrange(4, 40)))) for k in range(15)]
    docs = []
    for d in range(80):
        words = dict(items)[rng.choice(items)[0]].split()
        for _ in range(rng.randrange(0, 1 + len(words) // 3)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[word()], [words[at], word()], []])
        docs.append((d, " ".join([*(word() for _ in range(rng.randrange(60))), *words, *(word() for _ in range(rng.randrange(20)))])))
    got = {(r.doc_id, r.item_id) for r in dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert len(want) > 60 and got == want
    found = dc.drop_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in found.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_a_passage_that_most_of_the_corpus_has(spark):
    item = " ".join(f"q{j}" for j in range(30))
    docs = spark.createDataFrame([(i, f"a{i} b{i} {item} c{i}") for i in range(300)] + [(1000, "long " * 50000 + item)], "doc_id long, text string")
    assert dc.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 301


def test_items_of_a_template_and_short_items(spark):
    frame = [f"f{j}" for j in range(21)]
    of = lambda slot: " ".join([*frame[:10], slot, *frame[11:]])
    short = {100: "a0 a1 a2 a3 a4 a5 a6 a7 a8 a9", 101: "b0 b1 b2 b3 b4", 102: "c0 c1 c2 c3", 103: "d0 d1 d2"}
    bench = spark.createDataFrame([(k, of(f"slot{k}")) for k in range(30)] + list(short.items()), "item_id long, text string")
    texts = {0: of("another"), 1: "a0 a1 a2 a3 x y a6 a7 a8 a9", 2: "b0 b1 z b3 b4", 3: "c0 c1 new c2 c3", 4: "d0 d1 d2", 5: " ".join(frame[:6]), 6: "d0 d1 x", 7: "f0 " * 3000}
    docs = spark.createDataFrame([(d, f"some words {t} at last") for d, t in texts.items()], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()}
    assert got == {(0, k) for k in range(30)} | {(1, 100), (2, 101), (3, 102), (4, 103)}
    assert sorted(r.doc_id for r in dc.drop_leaks(docs, bench).collect()) == [5, 6, 7]
