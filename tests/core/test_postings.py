import random

import pytest
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.operators import postings, search
from tidemark.operators.tables import top_per


def corpus(n, seed):
    r = random.Random(seed)
    rare = [f"rare{i}" for i in range(60)]
    return [(i, " ".join([*(r.choice(("the", "of", "rate", "bank", "oil")) for _ in range(r.randrange(3, 30))), *r.sample(rare, r.randrange(4))])) for i in range(n)]


def plain(spark, docs, queries, k):
    out = search.bm25(docs, queries).withColumn("score", F.round("score", 4))
    return sorted(map(tuple, top_per(out, ["query_id"], [F.col("score").desc(), F.col("id")], k).select("query_id", "id", "score").collect()))


def found(spark, path, queries, k, **how):
    return sorted(map(tuple, postings.search(spark, path, queries, k, **how).select("query_id", "id", "score").collect()))


def test_loads_one_after_another_give_the_scores_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(postings, "REGION", 10)
    rows = corpus(400, 1)
    docs = spark.createDataFrame([*rows, (900, None), (None, "rate")], "id long, text string")
    queries = spark.createDataFrame([(1, "rare3 bank"), (2, "The RATE of rare5, rare6 and rare7"), (3, "nowhere"), (4, ""), (5, "rare1 rare2")], "query_id long, query_text string")
    path = storage.scratch(spark, "index")
    assert postings.add(docs.where("id < 150"), path) == 150
    assert found(spark, path, queries, 5) == plain(spark, docs.where("id < 150"), queries, 5)
    read = {p.folder for p in storage.version(spark, path).parts}
    assert postings.add(docs, path) == 251 and postings.add(docs, path) == 0  # the first 150 are not read again
    assert read < {p.folder for p in storage.version(spark, path).parts} and len(storage.version(spark, path).parts) == 2
    report = {}
    assert found(spark, path, queries, 5, report=report) == plain(spark, docs.where("id IS NOT NULL").fillna(""), queries, 5)
    assert 0 < report["scored"] < report["regions"]


def test_regions_that_cannot_win_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(postings, "REGION", 5)
    monkeypatch.setattr(postings, "FIRST", 12)
    docs = [(i, f"oil oil oil oil {'gold' if i < 3 else 'tin'}" if i < 12 else f"the market of oil and {' '.join(['words'] * 30)}") for i in range(600)]
    path = storage.scratch(spark, "index")
    postings.add(spark.createDataFrame(docs, "id long, text string"), path)
    queries, report = spark.createDataFrame([(1, "gold oil")], "query_id long, query_text string"), {}
    assert [i for _, i, _ in sorted(found(spark, path, queries, 3, report=report), key=lambda x: x[1])] == [0, 1, 2]
    assert report["scored"] < report["regions"] / 4


def test_a_load_that_dies_is_not_seen(spark, monkeypatch):
    path = storage.scratch(spark, "index")
    postings.add(spark.createDataFrame(corpus(20, 2), "id long, text string"), path)

    def die(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(postings, "commit", die)
        with pytest.raises(OSError, match="lost"):
            postings.add(spark.createDataFrame(corpus(40, 2), "id long, text string"), path)
    assert postings.documents(spark, path).count() == 20
    assert postings.add(spark.createDataFrame(corpus(40, 2), "id long, text string"), path) == 20
    assert postings.documents(spark, path).count() == 40


def test_hybrid_scores_only_what_can_be_among_the_best(spark, monkeypatch):
    monkeypatch.setattr(search, "hybrid", lambda keyword, vector, weight, f=search.hybrid: seen.append(keyword.count()) or f(keyword, vector, weight))
    seen, rows = [], corpus(500, 4)
    docs = spark.createDataFrame(rows, "id long, text string")
    queries = spark.createDataFrame([(i, f"rare{i} rare{i + 7} rate bank") for i in range(4)], "query_id long, query_text string")
    r = random.Random(5)
    u = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in ((i, [r.gauss(0, 1) for _ in range(6)]) for i, _ in rows if i % 3)}
    vectors = spark.createDataFrame(list(u.items()), "id long, u array<double>")
    named = spark.createDataFrame([(q, u[q + 10 if (q + 10) % 3 else q + 11]) for q in range(3)], "query_id long, q array<double>")
    keyword = search.bm25(docs, queries)
    got = top_per(search.best_hybrid(keyword, vectors, named, 5).withColumn("score", F.round("score", 4)), ["query_id"], [F.col("score").desc(), F.col("id")], 5).collect()
    words, q = {(x.query_id, x.id): x.score for x in keyword.collect()}, {x.query_id: x.q for x in named.collect()}
    sims = {(k, i): round(sum(a * b for a, b in zip(q[k], v, strict=True)), 5) for k in q for i, v in u.items()}
    every = [(k, i, round(words.get((k, i), 0) + 0.5 * sims.get((k, i), 0), 4)) for k, i in words.keys() | sims.keys()]
    want = {x for k in range(4) for x in sorted((e for e in every if e[0] == k), key=lambda e: (-e[2], e[1]))[:5]}
    assert {(x.query_id, x.id, x.score) for x in got} == want and len(got) == 20
    assert seen[0] < len(words) / 4


def test_keyword_scores_shuffle_texts_only(spark):
    docs = spark.createDataFrame(corpus(50, 6), "id long, text string")
    queries = spark.createDataFrame([(1, "the bank")], "query_id long, query_text string")
    plan = search.bm25(docs, queries)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" in plan and "hashpartitioning(query_id#" not in plan and "SortMergeJoin" not in plan


def test_a_load_shuffles_no_words(spark, monkeypatch):
    """Each occurrence of a word was shuffled; now a word of a region is, once."""
    seen = []
    real = postings._by_word
    monkeypatch.setattr(postings, "_by_word", lambda batches: real(b.slice(k, 3) for b in batches for k in range(0, b.num_rows, 3)))  # regions go on in later batches
    monkeypatch.setattr(postings, "REGION", 4)
    explode = postings.F.explode
    monkeypatch.setattr(postings.F, "explode", lambda c: seen.append(c) or explode(c))
    docs = spark.createDataFrame([(f"d{i}", " ".join(["the"] * (i % 5) + [f"w{i % 7}", "End"])) for i in range(40)] + [("e", ""), ("n", None)], "id string, text string")
    path = storage.scratch(spark, "p")
    assert postings.add(docs, path) == 42 and not seen
    rows = postings.postings(spark, path).collect()
    got = sorted((r.w, i.id, i.tf, i.len) for r in rows for i in r["items"])
    want = [(w, f"d{i}", n, i % 5 + 2) for i in range(40) for w, n in (("the", i % 5), (f"w{i % 7}", 1), ("end", 1)) if n]
    assert got == sorted(want) and all(r.n == len(r["items"]) and r.max_tf == max(i.tf for i in r["items"]) and r.min_len == min(i.len for i in r["items"]) for r in rows)
    assert len({r.region for r in rows}) >= 10


def test_loads_deal_no_postings_and_leave_no_texts(spark):
    from tidemark.storage import scratch, shared_dir

    rows = [(i, f"word{i % 7} and {'gold ' * (i % 3)}rate{i}") for i in range(400)]
    docs = spark.createDataFrame([*rows, (5, "a first text"), (None, "none")], "id long, text string")
    path = scratch(spark, "postings")
    assert postings.add(docs.where("id < 200"), path) == 200 and postings.add(docs, path) == 200
    assert postings.documents(spark, path).where("id = 5").first()["len"] == 3  # "a first text" is before "word5 ..."
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemark")
    left = [s.getPath() for s in fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(fs_path)]
    kept = [spark.read.parquet(p.toString()).columns for p in left if p.getName().startswith(("cut-", "texts-"))]
    assert not any("text" in c and "region" in c for c in kept)
