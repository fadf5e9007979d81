"""Keyword search over stored postings: words by region of documents, bounds of scores, and updates by new documents only.

An index is a folder of segments and a log (tidemark.storage); a load adds one segment of the documents that the index
doesn't have yet, and is visible once its version is put into place. A region is REGION documents of a segment that stand
together. A posting row holds the documents of a region that have a word, beside their number, the largest count
of the word and the smallest length: from these follows, for any statistics of the whole index, a bound of what the word
can add to a score in that region. A search scores the regions with the highest bounds first, and then only those whose
bound reaches what the k-th best document has by then.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators.graph import cut
from tidemark.operators.search import words
from tidemark.operators.tables import top_per
from tidemark.storage import Conflict, Part, Version, commit, remove, scratch, version

#: Documents of a region, folders of words of a segment, and regions of a query that are scored first.
REGION, BUCKETS, FIRST = 128, 16, 8
_POSTINGS = "w string, region string, n long, max_tf long, min_len int, items array<struct<id: {id}, tf: long, len: int>>, bucket int"


def _bucket():
    return F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int")


def _by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of documents (id, ws, region, len), region after region; one that goes on in a later batch has a word twice."""
    for batch in batches:
        regions = batch.column("region").to_pylist()
        begins = [k for k, r in enumerate(regions) if not k or r != regions[k - 1]]
        for a, b in zip(begins, [*begins[1:], len(regions)], strict=True):
            part = batch.slice(a, b - a)
            lens = part.column("len").to_numpy()
            word = pc.dictionary_encode(part.column("ws").flatten())
            if not len(word):
                continue
            key, tf = np.unique(word.indices.to_numpy().astype(np.int64) * (b - a) + np.repeat(np.arange(b - a), lens), return_counts=True)
            which, doc = np.divmod(key, b - a)
            at = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
            ends = np.append(at, len(key))
            item = pa.StructArray.from_arrays([part.column("id").take(pa.array(doc)), pa.array(tf, pa.int64()), pa.array(lens[doc], pa.int32())], ["id", "tf", "len"])
            columns = {
                "w": word.dictionary.take(pa.array(which[at])), "region": pa.array([regions[a]] * len(at)), "n": pa.array(np.diff(ends), pa.int64()), "max_tf": pa.array(np.maximum.reduceat(tf, at), pa.int64()),
                "min_len": pa.array(np.minimum.reduceat(lens[doc], at), pa.int32()), "items": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), item),
            }
            yield pa.RecordBatch.from_pydict(columns)


def add(docs: DataFrame, path: str, attempts: int = 4) -> int:
    """Adds the documents (id, text) that the index at path doesn't have; returns how many. Texts already there are not read.

    Of rows with one id the first text in order goes in; rows without an id are left out, a null text has no words. Only texts of ids
    that come twice are dealt by id; each task writes the postings of its texts, and no text stays beside the index.
    """
    spark = docs.sparkSession
    for attempt in range(attempts):
        at = version(spark, path)
        fresh = docs.where("id IS NOT NULL").select("id", "text")
        if at.parts:
            fresh = fresh.join(documents(spark, path).select("id"), "id", "left_anti")
        twice = cut(fresh.groupBy("id").count().where("count > 1").select("id"))
        if not twice.isEmpty():
            fresh = fresh.join(twice, "id", "left_anti").unionByName(fresh.join(twice, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))
        name, kept = uuid.uuid4().hex, scratch(spark, "texts")
        region = F.concat(F.lit(name[:12] + "-"), F.floor(F.monotonically_increasing_id() / REGION).cast("string"))  # of rows that stand together
        try:
            fresh.withColumn("region", region).write.parquet(kept)
            fresh = spark.read.schema(f"id {docs.schema['id'].dataType.simpleString()}, text string, region string").parquet(kept)
            n = fresh.count()
            if not n:
                return 0
            made = fresh.select("id", words(F.coalesce("text", F.lit(""))).alias("ws"), "region").withColumn("len", F.size("ws"))
            made.select("id", "len", "region").write.parquet(f"{path}/{name}/documents")
            # words are counted and written where their region stands, so that nothing is shuffled
            rows = made.mapInArrow(_by_word, _POSTINGS.format(id=docs.schema["id"].dataType.simpleString()).removesuffix(", bucket int"))
            rows.withColumn("bucket", _bucket()).sortWithinPartitions("bucket", "w").write.partitionBy("bucket").parquet(f"{path}/{name}/postings")
        finally:
            remove(spark, kept)
        try:
            kind = docs.schema["id"].dataType.simpleString()
            commit(spark, path, Version(at.number + 1, ["id"], json.dumps(kind), 0, [*at.parts, Part(0, len(at.parts), name, n)]))
            return n
        except Conflict:  # another load came first: what it brought must be left out
            if attempt == attempts - 1:
                raise
    return 0


def documents(spark: SparkSession, path: str) -> DataFrame:
    """id, len (words), region of all documents."""
    at = version(spark, path)
    return spark.read.schema(f"id {json.loads(at.schema)}, len int, region string").parquet(*(f"{path}/{p.folder}/documents" for p in at.parts))


def postings(spark: SparkSession, path: str) -> DataFrame:
    """w, region, n, max_tf, min_len, items (id, tf, len), bucket of all segments."""
    at = version(spark, path)
    schema, out = _POSTINGS.format(id=json.loads(at.schema)), None
    for p in at.parts:
        one = spark.read.schema(schema).parquet(f"{path}/{p.folder}/postings")
        out = one if out is None else out.unionByName(one)
    return out


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, k1: float = config.BM25_K1, b: float = config.BM25_B, digits: int = 4, report: dict | None = None) -> DataFrame:
    """query_id, id, score: the k best documents of each query (query_id, query_text) by score, rounded to `digits`, then id.

    Exact: regions are left out only where no document can be among the k best. Every distinct query word counts once; an
    index or query without words gives no rows. `report`, if given, takes the regions that could have been scored and
    those that were.
    """
    terms = cut(queries.select("query_id", F.explode(F.array_distinct(words(F.col("query_text")))).alias("w")).withColumn("bucket", _bucket()))
    stats = documents(spark, path).agg(F.count("*").alias("docs"), F.avg("len").alias("avg")).first()
    total, average = stats["docs"], stats["avg"] or 1.0
    part = lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(average)))
    # words of queries (a stated set) are sent to all tasks, so that no posting of another word is shuffled
    stored = postings(spark, path).join(F.broadcast(terms.select("w", "bucket").distinct()), ["w", "bucket"], "left_semi")
    heads = cut(stored.select("w", "bucket", "region", "n", "max_tf", "min_len"))
    df = heads.groupBy("w").agg(F.sum("n").alias("df"))
    idf = df.select("w", F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighed = terms.join(idf, "w")
    bounds = weighed.join(heads.select("w", "region", part(F.col("max_tf"), F.col("min_len")).alias("most")), "w")
    bounds = cut(bounds.groupBy("query_id", "region").agg(F.sum(F.col("idf") * F.col("most")).alias("bound")))
    first = top_per(bounds, ["query_id"], [F.col("bound").desc(), F.col("region")], FIRST)

    def scored(regions: DataFrame) -> DataFrame:
        wanted = weighed.join(regions.select("query_id", "region"), "query_id")
        # as arrays of numbers, which take less than half of what structs take in a shuffle
        lists = stored.select("w", "bucket", "region", F.col("items.id").alias("id"), F.col("items.tf").cast("array<int>").alias("tf"), F.col("items.len").alias("len"))
        rows = wanted.join(lists, ["w", "bucket", "region"])
        each = rows.select("query_id", "idf", F.explode(F.arrays_zip("id", "tf", "len")).alias("i")).select("query_id", "i.id", (F.col("idf") * part(F.col("i.tf"), F.col("i.len"))).alias("s"))
        return each.groupBy("query_id", "id").agg(F.round(F.sum("s"), digits).alias("score"))

    best = [F.col("score").desc(), F.col("id")]
    early = cut(top_per(scored(first), ["query_id"], best, k))
    least = early.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    rest = bounds.join(first.select("query_id", "region"), ["query_id", "region"], "left_anti").join(least, "query_id", "left")
    rest = cut(rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 10.0**-digits)).select("query_id", "region"))
    if report is not None:
        report |= {"regions": bounds.count(), "scored": first.count() + rest.count()}
    return top_per(early.unionByName(scored(rest)), ["query_id"], best, k)
