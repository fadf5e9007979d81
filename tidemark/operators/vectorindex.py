"""An inverted-file index of unit vectors: rows stored by the cell of their nearest centroid, searches that read some cells.

Centroids are fitted on a bounded sample; every row is indexed. A search finds the cells nearest to each query and reads
only these; how many is a parameter, and all of them make it exact.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.tables import top_per
from tidemark.operators.vectors import in_blocks

#: Rows that centroids are fitted on at most, and rounds of fitting.
SAMPLE, ROUNDS = 1 << 16, 12
#: Cells of an index at most; each centroid goes to every task.
CELLS = 4096


@dataclass(frozen=True)
class Index:
    path: str
    centroids: np.ndarray
    size: int


def _fitted(sample: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids by spherical rounds; the first are spread over the sample, an empty cell keeps its centroid."""
    centroids = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        cell = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.where(length > 0, length, 1), centroids)
    return centroids


def build(rows: DataFrame, path: str, cells: int | None = None) -> Index:
    """Stores rows (id, u, other columns) by cell, and the centroids beside them.

    Vectors of another length than the first sampled one, and null ones, are not indexed. The sample holds the SAMPLE rows
    with the smallest hash of their id, so the same rows give the same index. By default there is a cell for the square
    root of the rows, CELLS at most.
    """
    spark = rows.sparkSession
    some = rows.where("u IS NOT NULL AND size(u) > 0").select("id", "u").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("u").collect()  # SAMPLE rows
    size = len(some[0]["u"]) if some else 0
    sample = np.array([r["u"] for r in some if len(r["u"]) == size], float).reshape(-1, size)
    k = max(1, min(cells or int(rows.count() ** 0.5), CELLS, len(sample) or 1))
    centroids = _fitted(sample, k) if len(sample) else np.zeros((1, size))

    @F.pandas_udf("int")
    def cell(u: pd.Series) -> pd.Series:
        return pd.Series((np.stack(u.to_numpy()) @ centroids.T).argmax(1).astype(np.int32) if len(u) else [], dtype="int32")

    placed = rows.where(F.size("u") == size).withColumn("cell", cell("u"))
    placed.repartition("cell").write.partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(json.dumps(centroids.tolist()),)], "centroids string").coalesce(1).write.text(f"{path}/centroids")
    return Index(path, centroids, size)


def opened(spark: SparkSession, path: str) -> Index:
    centroids = np.array(json.loads(spark.read.text(f"{path}/centroids").first()[0]), float)
    return Index(path, centroids, centroids.shape[1])


def cells_of(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    """queries (query_id, q) once for each of their `probes` nearest cells."""
    n = min(probes, len(index.centroids))

    @F.pandas_udf("array<int>")
    def near(q: pd.Series) -> pd.Series:
        if not len(q):
            return pd.Series([], dtype=object)
        sims = np.stack(q.to_numpy()) @ index.centroids.T
        return pd.Series(list(np.argpartition(-sims, n - 1, axis=1)[:, :n].astype(np.int32)))

    asked = queries.where(F.size("q") == index.size)
    return asked.withColumn("cell", F.explode(near("q")))


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int, probes: int, exact: bool = False, itself: bool = False) -> DataFrame:
    """query_id, id, sim, rank: the k most similar rows of the probed cells for each query (query_id, q unit vectors).

    With `exact` all cells are read. A query's own row (of the same id) is left out unless `itself`. Rows of a large cell
    and queries of a cell are dealt to parts; folders of cells that no query asks for are not read.
    """
    asked = cells_of(index, queries.select("query_id", "q"), len(index.centroids) if exact else probes)
    rows = spark.read.parquet(f"{index.path}/rows")
    rows = rows.select("id", "u", "cell")
    wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]  # CELLS numbers at most
    rows = rows.where(F.col("cell").isin(wanted))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        sims, ids = np.round(np.stack(a["u"].to_numpy()) @ np.stack(b["q"].to_numpy()).T, 5), a["id"].to_numpy()
        found = []
        for j, q in enumerate(b["query_id"].to_numpy()):
            at = np.arange(len(ids)) if itself else np.flatnonzero(ids != q)
            order = at[np.lexsort((ids[at], -sims[at, j]))[:k]]
            found.append(pd.DataFrame({"query_id": q, "id": ids[order], "sim": sims[order, j]}))
        return pd.concat(found)

    kinds = {"query_id": dict(queries.dtypes)["query_id"], "id": dict(rows.dtypes)["id"]}
    scored = in_blocks(rows, asked, ["cell"], best, f"query_id {kinds['query_id']}, id {kinds['id']}, sim double")
    return top_per(scored, ["query_id"], [F.col("sim").desc(), F.col("id")], k, rank="rank")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the rows (query_id, id) of an exact search that a search has found."""
    n = exact.count()
    return exact.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").count() / n if n else 1.0
