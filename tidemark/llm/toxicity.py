"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams (McMahan et al., 2013)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.words import grams, mix, stem_hashes, word_hashes

U = np.uint64
#: Hashed feature space; weights of all of it take 4 MB, their non-zero part is what gets broadcast.
BITS = 20
#: Labelled rows that are used for training at most (those of the smallest hash), and bytes of their features.
MAX_TRAIN, MAX_BYTES = 20_000, 192 << 20
_SEPARATE = np.arange(256, dtype=np.uint8)
for _c in range(128):
    if not chr(_c).isalnum():
        _SEPARATE[_c] = 32


#: Word beginnings of these lengths in bytes count as features beside the words, for inflected forms.
STEMS = (4, 5, 6)


def features(raw: bytes) -> np.ndarray:
    """Hashed features of a whole text, with repeats: words, their beginnings, pairs, and pairs that skip one or two words.

    Words are runs of letters, digits and non-ASCII bytes, A-Z lower-cased.
    """
    clean = _SEPARATE[np.frombuffer(raw, np.uint8)].tobytes()
    h = word_hashes(clean)[0]
    parts = [mix(h ^ U(11)), grams(h, 2), *stem_hashes(clean, STEMS)]
    parts += [mix(h[:-gap] * U(0x9E3779B97F4A7C15) + h[gap:] * U(2 * gap + 1)) for gap in (2, 3) if len(h) > gap]
    return (np.concatenate(parts) >> U(64 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class FTRL:
    """Per-coordinate rates alpha / (beta + sqrt of summed squared gradients); l1 sets small weights to zero.

    l1 counts times the root of the number of rows, as chance sums of gradients do.
    """

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.03
    l2: float = 0.1
    epochs: int = 4

    def fit(self, rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
        """Weights and bias from distinct features of each row, in the order given."""
        z, n, l1 = np.zeros(1 << BITS), np.zeros(1 << BITS), self.l1 * len(rows) ** 0.5
        bias, bias_n = 0.0, 0.0
        for _ in range(self.epochs):
            for x, y in zip(rows, labels, strict=True):
                zx, nx = z[x], n[x]
                w = self._weights(zx, nx, l1)
                g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
                z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / self.alpha * w
                n[x] = nx + g * g
                bias_n += g * g
                bias -= self.alpha / (self.beta + bias_n**0.5) * g
        return self._weights(z, n, l1), bias

    def _weights(self, z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))


def featured(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """__order, __key (hash of id and features), __toxic, __x (sorted distinct features as 32-bit numbers) of labelled rows."""
    ids = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("__toxic"))
    ids = ids.withColumn("__order", F.xxhash64("doc_id")).orderBy("__order", "doc_id").limit(max_train)
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                x = [np.unique(features(t.as_py().encode())).astype(np.int32).tobytes() for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x, pa.binary())], ["__order", "__toxic", "__x"])

    out = rows.select("__order", "__toxic", "text").mapInArrow(scan, "__order long, __toxic double, __x binary")
    return out.withColumn("__key", F.xxhash64("__order", "__x"))


def train(docs: DataFrame, labels: DataFrame, params: FTRL | None = None, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Non-zero weights (feature int, weight double; the bias has feature -1) learnt from labels (doc_id, toxic).

    Null ids, labels or texts are left out; a label that differs between rows of an id counts as the larger one, and
    rows of an id with equal features train once. At most max_train labelled rows with max_bytes of features together,
    those of the smallest hash of their id, are used, so one task can hold them; features are computed in parallel
    before. Without any row (empty tables included) the model is empty.
    """
    params = params or FTRL()
    rows = stored(featured(docs, labels, max_train), "features")
    order = ["__order", "__key"]
    keys = rows.groupBy(*order).agg(F.first(F.octet_length("__x")).alias("size")).orderBy(*order).limit(max_train)
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # max_train rows at most
    keys = keys.withColumn("size", F.sum("size").over(so_far)).where(F.col("size") <= max_bytes).drop("size")
    chosen = rows.join(F.broadcast(keys), order).repartition(1).sortWithinPartitions(*order)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, last = [], [], None
        for batch in batches:
            for order, key, label, value in zip(*batch.columns, strict=True):
                if (order, key) != last:
                    last = (order, key)
                    x.append(np.frombuffer(value.as_buffer(), np.int32))  # a view of the batch
                    y.append(label.as_py())
        if x:
            w, bias = params.fit(x, np.array(y))
            x.clear()
            batch = value = None
            pa.default_memory_pool().release_unused()  # workers live on
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(w[at], bias))], ["feature", "weight"])

    return chosen.select(*order, "__toxic", "__x").mapInArrow(fit, "feature int, weight double")


def score(docs: DataFrame, weights: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold up) of each whole text; no shuffle.

    The weights are sparse and at most 2**BITS rows, so they are sent to all tasks. A null text counts as empty; an
    empty text gets the bias alone; with no weights every score is 0.5. Columns named score or predicted are replaced.
    """
    found = weights.toPandas()
    at, w = found["feature"].to_numpy(np.int32), found["weight"].to_numpy(float)

    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.zeros(1 << BITS)
        table[at[at >= 0]] = w[at >= 0]
        bias = float(w[at < 0].sum())
        live = table != 0

        def one(text: str | None) -> float:
            f = features((text or "").encode())
            s = table[np.unique(f[live[f]])].sum() + bias
            return float(1 / (1 + np.exp(-np.clip(s, -35, 35))))

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype=float)

    return docs.withColumn("score", apply("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4; rows of fold 2 are held out. A null id has fold 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def train_labels(labels: DataFrame) -> DataFrame:
    """The labelled rows outside the held-out fold."""
    return labels.where(fold() != 2)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without those scored toxic, with exactly their own columns, whatever these are named."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "doc_id", "text")
    return score(held, train(docs, train_labels(labels)), threshold).where("predicted = 0").select("__row.*")
