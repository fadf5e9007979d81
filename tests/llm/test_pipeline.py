import random

import numpy as np

import corpus_pipeline
from tidemark.llm.sharding import jump


def test_stages_over_a_planted_corpus(spark, tmp_path):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    leak = prose(40)
    rows, toxic = [], {}
    for i in range(600):
        text = prose(rng.randrange(30, 80))
        if i % 5 == 0:
            toxic[i] = 1
            text += " you moron you trash"
        rows.append((i, text, "en", f"src{i % 4}" if i % 3 else "hot", len(text)))
    near = prose(200).split()
    for i in range(600, 640):
        copy = list(near)
        copy[rng.randrange(200)] = word()
        rows.append((i, " ".join(copy), "en", "hot", 0))
    rows += [(i, f"{prose(9)} {leak} {prose(9)}", "en", "src1", 0) for i in range(640, 650)] + [(650, None, None, None, None), (651, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, toxic.get(i, 0)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    out = docs
    expect = {"toxicity": set(range(0, 600, 5)), "near_duplicates": set(range(601, 640)), "decontamination": set(range(640, 650))}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in out.select("doc_id").collect()}
        result = stage(spark, out, str(tmp_path))
        result.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id for r in out.select("doc_id").collect()}
        assert before - after == expect.get(name, set()), name
        if name != "sharding":
            assert out.columns == docs.columns
    got = {r.doc_id: r.shard for r in out.collect()}
    assert got == {i: int(jump(np.array([i], np.uint64), 8)[0]) for i in got}
    whole = {r.doc_id: r.shard for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == got
