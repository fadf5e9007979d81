import math
import random

import numpy as np

from tidemark.llm import toxicity


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(200)]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.2)
        text = [rng.choice(words) for _ in range(rng.randrange(1, 60))]
        if toxic:
            text.insert(rng.randrange(len(text) + 1), rng.choice(["moron,", "Trash", "idiotic"]))
        rows.append((i, " ".join(text), toxic))
    return rows


def test_held_out_accuracy_and_fold(spark):
    import zlib

    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "moron"), (9001, None), (9002, ""), (9003, "clean " * 100000 + "moron")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9001, 1), (9009, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    weights = toxicity.train(docs, toxicity.train_labels(labels))
    got = toxicity.score(docs, weights).withColumn("held", toxicity.fold() == 2).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.doc_id in truth and r.held]
    assert len(held) > 250 and all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    by = {r.doc_id: r for r in got}
    assert by[9001].score == by[9002].score and by[9003].predicted == 1 and all(0 <= r.score <= 1 for r in got)
    assert weights.count() < 5000
    kept = toxicity.reject(docs.selectExpr("*", "1 AS score", "'p' AS predicted"), labels)
    assert kept.columns == ["doc_id", "text", "score", "predicted"] and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, none)).first().score == 0.5
    assert toxicity.score(docs.limit(0), toxicity.train(docs, none)).count() == 0


def test_repeated_rows_train_once_and_bounds_hold(spark):
    rows = corpus(300)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = lambda d, **how: {r.feature: r.weight for r in toxicity.train(d, labels, **how).collect()}
    once = model(docs)
    assert model(docs.unionByName(docs)) == once and len(once) > 10
    size = sum(4 * len(np.unique(toxicity.features(t.encode()))) for _, t, _ in rows)
    assert model(docs, max_bytes=size) == once != model(docs, max_bytes=size - 1)
    assert model(docs, max_bytes=0) == {}


def test_ftrl_matches_a_plain_loop():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(40)]
    y = rng.integers(0, 2, 40).astype(float)
    model = toxicity.FTRL(epochs=2)
    w, bias = model.fit(rows, y)
    z, n, b, bn, l1 = [0.0] * 30, [0.0] * 30, 0.0, 0.0, model.l1 * math.sqrt(40)
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((model.beta + math.sqrt(n[i])) / model.alpha + model.l2)
    for _ in range(2):
        for x, t in zip(rows, y):
            ws = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-(sum(ws.values()) + b))) - t
            for i in x:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / model.alpha * ws[i]
                n[i] += g * g
            bn += g * g
            b -= model.alpha / (model.beta + math.sqrt(bn)) * g
    assert np.allclose(w[:30], [weight(i) for i in range(30)]) and abs(bias - b) < 1e-9


def named(text):
    """The features of a text by name: words, their beginnings in bytes, pairs, pairs that skip one or two words."""
    out, words, word = [], [], b""
    for b in (text or "").encode().lower() + b" ":
        if b >= 128 or chr(b).isalnum():
            word += bytes([b])
        elif word:
            words.append(word)
            word = b""
    out += [("word", w) for w in words]
    out += [("stem", w[:n]) for n in toxicity.STEMS for w in words if len(w) > n]
    out += [("skip", gap, a, b) for gap in (1, 2, 3) for a, b in zip(words, words[gap:])]
    return out


def one_id(name):
    """The hashed id of a feature, from a text that has little else."""
    kind, *rest = name
    if kind == "word":
        return int(toxicity.features(rest[0])[0])
    if kind == "stem":  # a longer word has its word first, then its beginnings by length
        return int(toxicity.features(rest[0] + b"z")[1 + [n for n in toxicity.STEMS].index(len(rest[0]))])
    gap, a, b = rest
    words = [a, *[b"q"] * (gap - 1), b]
    found = toxicity.features(b" ".join(words))
    long = sum(len(w) > n for w in words for n in toxicity.STEMS)
    at = {1: len(words), 2: len(words) + (len(words) - 1) + long, 3: len(words) + (len(words) - 1) + long + (len(words) - 2)}[gap]
    return int(found[at])


def test_features_are_those_of_a_plain_reading():
    from collections import Counter

    texts = ["", "One", "a b", "Überflüssig, TRASH! e-mail_x 12", "moron moron  moron", "some longer sentences; with (marks) and 漢字 words", "x" * 40 + " " + "y" * 7]
    for text in texts + [t for _, t, _ in corpus(30, 3)]:
        assert Counter(toxicity.features(text.encode()).tolist()) == Counter(one_id(f) for f in named(text)), text


def test_scores_are_those_of_a_plain_model(spark):
    rows = corpus(250, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, "unseen words only")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    order = {r.doc_id: r.o for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS o").collect()}
    ids = {i: {one_id(f) for f in set(named(t))} for i, t, _ in rows}
    model, truth = toxicity.FTRL(), {i: y for i, _, y in rows}
    z, n, b, bn, l1 = {}, {}, 0.0, 0.0, model.l1 * math.sqrt(len(rows))

    def weight(i):
        x = z.get(i, 0.0)
        return 0.0 if abs(x) <= l1 else -(x - math.copysign(l1, x)) / ((model.beta + math.sqrt(n.get(i, 0.0))) / model.alpha + model.l2)

    for _ in range(model.epochs):
        for d in sorted(ids, key=order.get):
            ws = {i: weight(i) for i in ids[d]}
            g = 1 / (1 + math.exp(-(sum(ws.values()) + b))) - truth[d]
            for i, w in ws.items():
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / model.alpha * w
                n[i] = n.get(i, 0.0) + g * g
            bn += g * g
            b -= model.alpha / (model.beta + math.sqrt(bn)) * g
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    for d, text, _ in [*rows, (9000, None, 0), (9001, "unseen words only", 0)]:
        want = 1 / (1 + math.exp(-(sum(map(weight, {one_id(f) for f in set(named(text))})) + b)))
        assert abs(got[d].score - want) < 1e-6 and got[d].predicted == int(got[d].score >= 0.3)
