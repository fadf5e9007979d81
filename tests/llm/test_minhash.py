import random

import pytest

from tidemark.llm import minhash


def brute(rows, words, percent=80):
    sets = []
    for _, t in rows:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split()
        n = min(words, len(raw))
        sets.append({tuple(raw[i : i + n]) for i in range(len(raw) - n + 1)} if n else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min((x for x in (low.get(root(i)), d) if x is not None), default=None)
    return sorted((str(d), len(sets[i]), str(low[root(i)] if sets[i] else d)) for i, (d, _) in enumerate(rows))


def corpus(seed, n_groups, copies, edits):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    texts = []
    for g in range(n_groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 9, 30, 80, 200]))]
        if g % 3 == 0:
            base += passage
        for _ in range(rng.choice(copies)):
            t = list(base)
            for _ in range(rng.randrange(edits + 1)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("words,edits", [(4, 3), (5, 8)])
def test_components_match_brute_force(spark, words, edits):
    rows = corpus(words, 60, [1, 2, 3, 25], edits) + [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one "), (None, "one"), (905, "x " * 30000)]
    docs = spark.createDataFrame([(d, t, "n", [1]) for d, t in rows], "doc_id long, text string, digest string, sketch array<int>")
    got = minhash.near_duplicates(docs, words).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, words)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_empty_table_and_keep_one(spark):
    docs = spark.createDataFrame([(2, "a b c d e f"), (1, "A b c d e f"), (3, "else"), (4, None), (4, None)], "doc_id long, text string")
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(r.doc_id for r in minhash.keep_one(docs).collect()) == [1, 3, 4]


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)]
    df = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")
    got = {r.node[0]: r.label[0] for r in minhash.components(df).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_the_bound_of_shared_values():
    assert minhash.miss_probability() < 1e-9


def test_keep_one_tells_rows_apart_by_text(spark):
    base = [f"v{i}" for i in range(60)]
    near = " ".join(["other", *base[1:]])
    rows = [(None, " ".join(base), "p"), (None, near, "q"), (None, "a text of its own without an id", "r"), (None, "", "s"), (None, None, "t"), (None, " ", "u"), (None, None, "t")]
    rows += [(7, "one clean text under this id here", "v"), (7, "quite another one with the same number", "w"), (8, "ONE clean text under this id here", "x")]
    docs = spark.createDataFrame([(i, t, x, {x: 1}) for i, t, x in rows], "doc_id long, text string, tag string, of map<string,int>")
    got = minhash.keep_one(docs)
    tags = sorted(r.tag for r in got.collect())
    assert got.columns == docs.columns and tags in ([*"prstuvw"], [*"qrstuvw"])
    found = {r.component_id for r in minhash.near_duplicates(docs).where("n_shingles = 56").collect()}
    assert found == {None}
