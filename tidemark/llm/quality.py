"""Quality by importance resampling (Xie et al., 2023): hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.words import grams, word_hashes

U = np.uint64
#: Hash buckets of words and word pairs.
BUCKET_BITS = 16
#: Labelled rows that stand for the target text at most (those of the smallest hash); the raw model counts all rows.
MAX_TARGET = 20_000
#: Sample keys are compared as whole multiples of 2**-20.
_STEP = 1 << 20


def buckets(raw: bytes) -> np.ndarray:
    """Bucket of each word and word pair of a whole text, with repeats."""
    h = word_hashes(raw)[0]
    return (np.concatenate((h, grams(h, 2))) >> U(64 - BUCKET_BITS)).astype(np.int64)


def models(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """Counts (bucket, raw, target) over all docs and over those whose doc_id is in target_ids (bounded, unique ids)."""
    marked = docs.select("doc_id", "text").join(F.broadcast(target_ids.select("doc_id").withColumn("__t", F.lit(True))), "doc_id", "left")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            for text, target in zip(batch["text"], batch["__t"].notna(), strict=True):
                if text:
                    b = buckets(text.encode())
                    np.add.at(total[0], b, 1)
                    if target:
                        np.add.at(total[1], b, 1)
        at = np.flatnonzero(total[0])
        yield pd.DataFrame({"bucket": at.astype(np.int32), "raw": total[0][at], "target": total[1][at]})

    parts = marked.mapInPandas(count, "bucket int, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def importance(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """docs with n_features and log_weight: the summed log ratio of target and raw probability of a text's n-grams.

    Counts are smoothed by one. A null or empty text has no features and weight 0. The models are at most
    2**BUCKET_BITS rows.
    """
    found = counts.toPandas()
    raw, target = np.ones(1 << BUCKET_BITS), np.ones(1 << BUCKET_BITS)
    raw[found["bucket"]] += found["raw"]
    target[found["bucket"]] += found["target"]
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())

    @F.pandas_udf("n_features long, log_weight double")
    def weigh(texts: pd.Series) -> pd.DataFrame:
        each = [buckets(t.encode()) if t else np.zeros(0, np.int64) for t in texts]
        return pd.DataFrame({"n_features": [len(b) for b in each], "log_weight": [float(ratio[b].sum()) for b in each]})

    return docs.withColumn("__w", weigh("text")).withColumn("n_features", F.col("__w.n_features")).withColumn("log_weight", F.col("__w.log_weight")).drop("__w")


def gumbel_top_k(scored: DataFrame, k: int) -> DataFrame:
    """scored (doc_id, log_weight, ...) with gumbel, sample_key and kept: the k rows of the largest weight + noise.

    The noise is a hash of the id, so a sample can be repeated. The k-th key is found by counting rows by 16 bits of the
    key at a time, four passes over slim rows that send 65,536 counts at most; rows that tie at it are all kept.
    """
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(20)), 11).cast("double") + 0.5) / float(1 << 53)
    rows = scored.withColumn("gumbel", -F.log(-F.log(u))).withColumn("sample_key", F.col("log_weight") + F.col("gumbel"))
    rows = stored(rows.withColumn("__q", (F.round(F.greatest(F.least(F.col("sample_key"), F.lit(2.0**41)), F.lit(-(2.0**41))) * _STEP).cast("long") + F.lit(1 << 62))), "gumbel")
    if k <= 0:
        return rows.withColumn("kept", F.lit(False)).drop("__q")
    low, left = 0, k
    for shift in (48, 32, 16, 0):
        within = rows.where(F.shiftright("__q", shift + 16) == (low >> 16)) if shift < 48 else rows
        counts = dict(within.groupBy(F.shiftright("__q", shift).alias("b")).count().collect())
        low = low << 16 if shift == 48 else low
        for b in sorted(counts, reverse=True):
            if counts[b] >= left:
                low = b
                break
            left -= counts[b]
        else:
            low = min(counts, default=0)  # fewer than k rows: all are kept
            left = counts.get(low, 0)
        low = low << 16 if shift else low
    return rows.withColumn("kept", F.col("__q") >= F.lit(low)).drop("__q")


def resample(docs: DataFrame, labels: DataFrame, max_target: int = MAX_TARGET) -> DataFrame:
    """One row per document: doc_id, n_features, log_weight, gumbel, sample_key, kept.

    The target is the text of rows labelled quality = 1; as large a share of all rows is kept as has that label among
    the labelled (none without labels). A null or empty text has no features and weight 0; texts of any length count
    whole. The noise comes from the id, so rows of one id and text, or of null ids and equal texts, have one key and are
    kept or left together; ties at the last key are all kept, so a few more rows may stay than the share asks for. An
    empty table gives no rows, and other columns, whatever their names, are left out.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good, labelled = known.agg(F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0)), F.count("*")).first()
    target = known.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target)
    scored = importance(docs.select("doc_id", "text"), models(docs, target)).drop("text")
    total = docs.count()
    return gumbel_top_k(scored, total * good // labelled if labelled else 0)
