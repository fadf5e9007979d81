import math
import random
from collections import Counter

import numpy as np

from tidemark.llm import quality


def corpus():
    rng = random.Random(2)
    good, junk = [f"g{i}" for i in range(80)], [f"j{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choice(junk if i % 4 == 0 else good) for _ in range(rng.randrange(20, 60)))) for i in range(400)]
    return rows


def test_good_rows_are_kept_and_weights_match_a_plain_sum(spark):
    rows = corpus() + [(None, "g1 g2"), (500, None), (501, ""), (502, "g1 " * 100000)]
    docs = spark.createDataFrame([(d, t, 0.0) for d, t in rows], "doc_id long, text string, log_weight double")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 400, 3)] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = quality.resample(docs, labels).collect()
    assert len(got) == len(rows)
    truth = [(r.doc_id, r.kept) for r in got if r.doc_id is not None and r.doc_id < 400]
    assert all(kept == (d % 4 != 0) for d, kept in truth if not kept) and sum(kept and d % 4 == 0 for d, kept in truth) < 8
    target = {i for i in range(0, 400, 3) if i % 4}
    raw, aim = Counter(), Counter()
    for d, t in rows:
        b = quality.buckets((t or "").encode()).tolist()
        raw.update(b)
        if d in target:
            aim.update(b)
    size = 1 << quality.BUCKET_BITS
    n, m = sum(raw.values()) + size, sum(aim.values()) + size
    for r in got:
        text = next(t for d, t in rows if d == r.doc_id)
        want = sum(math.log((aim[b] + 1) / m) - math.log((raw[b] + 1) / n) for b in quality.buckets((text or "").encode()).tolist())
        assert abs(r.log_weight - want) < 1e-6 * max(1, abs(want))


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, float(w)) for i, w in enumerate(rng.normal(0, 50, 700))], "doc_id long, log_weight double")
    for k in (0, 1, 7, 350, 699, 700, 900):
        got = quality.gumbel_top_k(rows, k).collect()
        kept = sorted((r.sample_key for r in got if r.kept), reverse=True)
        assert len(kept) == min(k, 700) and kept == sorted((r.sample_key for r in got), reverse=True)[: len(kept)]


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in quality.resample(docs, labels).collect()] == [False]
    assert quality.resample(docs.limit(0), labels).count() == 0


def test_repeated_rows_are_kept_together(spark):
    rows = corpus()[:100]
    docs = spark.createDataFrame(rows + rows[:50] + [(None, "g1 g2")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(100)], "doc_id long, quality int")
    got = quality.resample(docs, labels).collect()
    kept = {}
    for r in got:
        kept.setdefault((r.doc_id, r.log_weight), set()).add(r.kept)
    assert len(got) == 153 and all(len(x) == 1 for x in kept.values()) and 0.7 * 153 <= sum(r.kept for r in got) <= 0.8 * 153 + 3
