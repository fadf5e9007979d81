import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import sharding


def plain(key, n):
    """The published loop."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 8, 1000])
def test_jump_matches_the_published_loop(n):
    keys = np.array([0, 1, 2, 7, -1, 2**63 - 1, -(2**63), 123456789], np.int64)
    assert sharding.jump(keys.view(np.uint64), n).tolist() == [plain(int(k), n) for k in keys]


def test_one_more_shard_takes_rows_only_into_itself():
    keys = np.arange(20000, dtype=np.uint64)
    for n in (1, 7, 8, 30):
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        moved = a != b
        assert (b[moved] == n).all() and abs(moved.mean() - 1 / (n + 1)) < 0.02


def test_manifest_over_odd_rows(spark):
    rows = [(i, f"t{i % 7} é") for i in range(500)] + [(3, None), (None, "x"), (None, None), (5, ""), (7, "same"), (7, "same"), (8, "y" * 300000)]
    docs = spark.createDataFrame([(d, t, 9, "z") for d, t in rows], "doc_id long, text string, shard int, slot string")
    got = sharding.shard_manifest(docs, 8).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    for r in got:
        assert (r.shard, r.grown_shard, r.law) == (plain(r.doc_id or 0, 8), plain(r.doc_id or 0, 9), "key")
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_manifest(docs.limit(0), 8).count() == 0


def test_text_keys_and_columns(spark):
    docs = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "doc_id string, shard int")
    got = sharding.shard_documents(docs, 5).collect()
    assert len(got) == 3 and got[0].shard == got[1].shard and all(0 <= r.shard < 5 for r in got)
