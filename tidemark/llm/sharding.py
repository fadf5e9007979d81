"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import gapless_rank, spread, spread_key


def jump(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key; a key's shard changes from n to n + 1 shards only to the new one."""
    key, shard, ahead = keys.astype(np.uint64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        shard[live] = ahead[live]
        k = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        key[live] = k
        ahead[live] = ((shard[live] + 1) * (2147483648.0 / ((k >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        live = live[ahead[live] < n_shards]
    return shard


def shard_of(key: Column, n_shards: int) -> Column:
    """Shard column of a long key. A null key counts as key 0."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")

    @F.pandas_udf("int")
    def pick(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), n_shards).astype(np.int32))

    return pick(F.coalesce(key, F.lit(0)).cast("long"))


def shard_documents(docs: DataFrame, n_shards: int, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """All rows of docs with the shard of their key; no shuffle.

    Integer keys are used as they are, others by their 64-bit hash. Rows with equal keys (null included, as key 0) get
    one shard; an empty table stays empty; a column that is already named `out` is replaced.
    """
    whole = dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    return docs.withColumn(out, shard_of(F.col(key) if whole else F.xxhash64(key), n_shards))


def shard_manifest(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One slim row per document: its shard, its place in it, and its shard once one more is added.

    Columns: doc_id, size (UTF-8 bytes + 1; null text: 1), text_crc32 (null text: that of no bytes, 0), law ('key'),
    shard, slot (from 0 in each shard without gaps), grown_shard. Slots follow a hash of key and checksum, then key,
    checksum, size. Repeated rows get a slot each. Texts are not shuffled.
    """
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    slim = docs.select(F.col(key).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = shard_documents(shard_documents(slim, n_shards), n_shards + 1, out="grown_shard")
    placed = placed.withColumn("__range", spread(F.col("doc_id"), F.col("text_crc32")))
    order = [spread_key(F.col("doc_id"), F.col("text_crc32")), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = gapless_rank(placed, "shard", "__range", order, "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
