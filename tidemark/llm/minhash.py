"""Near-duplicate documents from bottom-k sketches of one hash function (Cohen and Kaplan, 2007), confirmed exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tidemark.llm.common import discard, stored
from tidemark.llm.words import shingle_set

#: Values of a sketch: the smallest shingle hashes of a document.
K = 32
#: Of the K smallest hashes of a union, sets of similarity 0.8 share fewer than so many with probability 3e-10.
SHARED = 10
_TOP = np.uint64(1 << 63)


def sketches(docs: DataFrame, words: int, k: int = K) -> DataFrame:
    """doc_id, digest (of the shingle set; null if it is empty), n (its size), sketch (k smallest hashes, ascending)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, low = [], [], []
            for text in batch.column(1):
                s = shingle_set((text.as_py() or "").encode(), words)
                digests.append(xxhash.xxh3_128_digest(s) if len(s) else None)
                sizes.append(len(s))
                low.append((s[:k] ^ _TOP).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(low, pa.list_(pa.int64()))], ["doc_id", "digest", "n", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {dict(docs.dtypes)['doc_id']}, digest binary, n long, sketch array<long>")


def listed(each: DataFrame, need: Column) -> DataFrame:
    """Entries (v, digest, n, s, i) of the inverted lists that can bring linked classes together, from all (v, digest, n).

    s: how many values of the class any other class has; i: how many of its n values stand before v.

    need: how many values a class surely shares with any class that it is linked to. With the values of a class in one
    order for all, rare ones first, it is enough to list those before the last need - 1: the first value that two linked
    classes share is listed for both. Values of one class only need no list, and a class with fewer than `need` other
    values has no link. Counts stand in a table of their own, so that Spark can split the join of a value that many have.
    """
    often = stored(each.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "often")
    mine = each.join(often, "v").groupBy("digest", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    mine = mine.withColumn("need", need.cast("int")).withColumn("s", F.size("vs").cast("long")).where(F.col("s") >= F.col("need"))
    first = mine.select("digest", "n", "s", F.posexplode(F.slice("vs", F.lit(1), F.size("vs") - F.col("need") + 1)).alias("place", "x"))
    return first.select(F.col("x.v").alias("v"), "digest", "n", "s", (F.col("n") - F.col("s") + F.col("place")).alias("i"))


def sketch_lists(classes: DataFrame, similarity: float) -> DataFrame:
    """Lists of retained values: linked classes share at least min(ceil(similarity * n), SHARED) of them."""
    return listed(classes.select("digest", "n", F.explode("sketch").alias("v")), F.least(F.ceil(F.col("n") * similarity), F.lit(SHARED)))


def whole_lists(texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """Lists of all shingles of some classes (digest, text), of which linked ones share ceil(similarity * n).

    A passage that many texts hold is common, so it is listed only for texts that are little else.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(*batch.columns, strict=True):
                s = shingle_set(text.as_py().encode(), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array([digest.as_py()] * len(s), pa.binary()), pa.array(np.full(len(s), len(s)))], ["v", "digest", "n"])

    return listed(texts.select("digest", "text").mapInArrow(scan, "v long, digest binary, n long"), F.ceil(F.col("n") * similarity - 1e-9))


def _can_link(a: str, b: str, similarity: float, whole: bool) -> Column:
    """Whether the sizes of two sets allow the similarity; a and b are prefixes of their columns n and s.

    Where s counts all shingles that other classes have (whole), two sets share at most the smaller s.
    """
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    fits = F.least(na, nb) >= F.greatest(na, nb) * similarity - 1e-9
    return fits & (F.least(F.col(f"{a}s"), F.col(f"{b}s")) * (1 + similarity) >= (na + nb) * similarity - 1e-9) if whole else fits


def estimated(pairs: DataFrame, classes: DataFrame, similarity: float, k: int = K) -> DataFrame:
    """Pairs (a, b) that the sketch of their union doesn't rule out."""
    side = lambda x: classes.select(F.col("digest").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    hits = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    whole = (F.col("na") <= k) & (F.col("nb") <= k)
    exact = F.size(F.array_intersect("sa", "sb")) >= F.size(F.array_union("sa", "sb")) * similarity
    return both.where(F.when(whole, exact).otherwise(hits >= F.least(F.lit(SHARED), F.floor(F.size(union) * similarity * similarity)))).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets have 100 * intersection >= percent * union."""
    side = lambda x: texts.select(F.col("digest").alias(x), F.col("text").alias(f"t{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a = batch.column(0)[i].as_py()
                if a != last:
                    last, mine = a, shingle_set(batch.column(2)[i].as_py().encode(), words)
                other = shingle_set(batch.column(3)[i].as_py().encode(), words)
                inter = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * inter >= percent * (len(mine) + len(other) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(confirm, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) of the nodes of edges (a, b), by large and small stars (Kiveris et al., 2014).

    Each round is written to the shared folder; the driver only sees counts.
    """
    edges = stored(edges.where("a <> b").distinct(), "edges")
    before = None
    while True:
        last = edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(low, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        edges = stored(small.select("x.*").where("a <> b").distinct(), "edges")
        discard(last)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Lists with the component of each class, without the lists that lie in one component."""
    if labels is not None:
        lists = lists.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("comp", F.coalesce("label", "digest")).drop("label")
    else:
        lists = lists.withColumn("comp", F.col("digest"))
    mixed = stored(lists.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("v"), "mixed")
    return lists.join(mixed, "v")


def _to_pivot(lists: DataFrame, similarity: float, whole: bool) -> DataFrame:
    """Each class of a list with one class of the list: the one that others have most of, so a copy with few edits."""
    order = F.struct((-F.col("s") / F.col("n")).alias("own"), F.xxhash64("digest").alias("h"), "digest", "comp", "n", "s")
    pivots = lists.groupBy("v").agg(F.min(order).alias("p")).select("v", *(F.col(f"p.{c}").alias(f"p_{c}") for c in ("digest", "comp", "n", "s")))
    near = lists.join(stored(pivots, "pivots"), "v").where((F.col("comp") != F.col("p_comp")) & _can_link("", "p_", similarity, whole))
    return near.select(F.col("p_digest").alias("a"), F.col("digest").alias("b")).distinct()


def _across(lists: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different components that a list of whole sets still leaves open, in the list of their first value.

    With no value shared before v, two sets share at most the smaller of n - i values, and linked ones share
    similarity / (1 + similarity) of both sizes; so each entry has a largest size of a partner. Entries that no other
    one of their list fits drop out first; sizes are compared within ranges; members of the largest component of a list
    meet only the others.
    """
    e = lists.withColumn("most", (F.col("n") - F.col("i")) * (1 + similarity) / similarity - F.col("n") + 1e-9)
    sizes = lists.groupBy("v", "comp").count().groupBy("v").agg(F.max(F.struct("count", "comp")).alias("top")).select("v", F.col("top.comp").alias("main"))
    fits = e.groupBy("v").agg(F.min("n").alias("least_n"), F.max("most").alias("top_most"))
    e = e.join(stored(fits.join(sizes, "v"), "fits"), "v").where((F.col("most") >= F.col("least_n")) & (F.col("n") <= F.col("top_most")))
    e = stored(e.select("v", "digest", "comp", "n", "most", (F.col("comp") == F.col("main")).alias("in_main"), F.floor(F.log("n") / -math.log(similarity)).alias("r")), "entries")
    few = e.where("NOT in_main").select("v", F.explode(F.array(F.col("r") - 1, F.col("r"), F.col("r") + 1)).alias("r"), *(F.col(c).alias(f"x_{c}") for c in ("digest", "comp", "n", "most")))
    fit = (F.col("n") <= F.col("x_most")) & (F.col("x_n") <= F.col("most")) & (F.least("n", "x_n") >= F.greatest("n", "x_n") * similarity - 1e-9)
    once = F.col("in_main") | (F.col("x_digest") < F.col("digest"))
    return few.join(e, ["v", "r"]).where((F.col("x_comp") != F.col("comp")) & fit & once).select(F.col("x_digest").alias("a"), F.col("digest").alias("b")).distinct()


def _set_digest(text: str | None, words: int) -> bytes | None:
    s = shingle_set((text or "").encode(), words)
    return xxhash.xxh3_128_digest(s) if len(s) else None


def class_texts(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """digest, text of the classes wanted (digest, rep): only rows of these ids are hashed once more."""
    kind = dict(docs.dtypes)["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = pa.array([_set_digest(t.as_py(), words) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, batch.column(1)], ["doc_id", "digest", "text"])

    ids = wanted.select(F.col("rep").alias("w_rep")).distinct()
    near = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("w_rep")), "left_semi")
    hashed = near.mapInArrow(scan, f"doc_id {kind}, digest binary, text string").where("digest IS NOT NULL")
    classes = wanted.select(F.col("digest").alias("w_digest"), "rep")
    found = hashed.join(classes, (F.col("digest") == F.col("w_digest")) & F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    return found.select("digest", "text").dropDuplicates(["digest"])


def grouped(docs: DataFrame, words: int, percent: int, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, digest, n, sketch), classes of equal sets (digest, rep, n, sketch; rep: smallest id), and the
    component (node, label) of the linked classes."""
    similarity = percent / 100
    rows = stored(sketches(docs, words, k), "sketches")
    classes = stored(rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    lists = stored(sketch_lists(classes, similarity), "lists")
    texts = stored(class_texts(docs, lists.select("digest").distinct().join(classes.select("digest", "rep"), "digest"), words), "texts")
    links, labels = None, None
    for turn in range(3):
        if turn == 1:
            left = _labelled(lists, labels).select("digest").distinct()
            fewer = lists
            lists = stored(whole_lists(texts.join(left, "digest", "left_semi"), similarity, words), "lists")
            discard(fewer)
        open_lists = stored(_labelled(lists, labels), "open")
        pairs = _across(open_lists, similarity) if turn == 2 else _to_pivot(open_lists, similarity, whole=turn == 1)
        candidates = stored(estimated(pairs, classes, similarity, k), "candidates")
        discard(open_lists)
        found = verified(candidates, texts, words, percent)
        before = links
        links = stored(found if links is None else links.unionByName(found), "links")
        discard(candidates, *([before] if before is not None else []))
        labels = components(links)
    discard(lists, texts, links)
    return rows, classes, labels


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Two documents are linked if their sets of distinct word shingles have 100 * intersection >= percent * union; a text
    with fewer words is one shingle, and a null or empty text has none and no link. Documents of equal sets are one
    class from the start. Classes that share listed sketch values are candidates; all of a list are first compared with
    one of them, round by round, and lists that have become one component are done; what is left is compared across
    components, where sizes and places in the lists allow a link. Sketches of unions filter the candidates and full sets
    confirm them. Rows with a null id count in their component but don't name it: kept is true for them only if no row
    of it has an id. Rows that repeat a doc_id are kept alike. Texts of any length count whole, an empty table gives no
    rows, and other columns, whatever their names, are not read.
    """
    rows, classes, labels = grouped(docs, words, percent, k)
    named = labels.join(classes.select(F.col("digest").alias("node"), "rep"), "node")
    first = named.groupBy("label").agg(F.min("rep").alias("component"))
    reach = named.join(first, "label").select(F.col("node").alias("digest"), "component")
    known = stored(classes.select("digest", "rep").join(reach, "digest", "left").select("digest", F.coalesce("component", "rep").alias("component")), "known")
    out = rows.drop("sketch").join(known, "digest", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with their own columns, one document of each component: that of the smallest id, null ones last.

    Rows are told apart by id and shingle set, so different texts under one id or without an id are different
    documents. Rows without a word have no component; they all stay, and only repeats of a whole row count once.
    """
    _, classes, labels = grouped(docs, words, percent)
    known = classes.select("digest", "rep").join(labels.withColumnRenamed("node", "digest"), "digest", "left")
    first = known.groupBy(F.coalesce("label", "digest").alias("comp")).agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "digest")).alias("f"))
    chosen = first.select(F.col("f.rep").alias("__id"), F.col("f.digest").alias("__chosen"))

    @F.pandas_udf("binary")
    def of_set(texts: pd.Series) -> pd.Series:
        return pd.Series([_set_digest(t, words) for t in texts], dtype=object)

    digest = of_set.asNondeterministic()  # else Spark computes it twice, once more for the join's test of nulls
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    held = docs.where(worded).select(F.col("doc_id").alias("__doc"), digest("text").alias("__digest"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    one = held.join(chosen, (F.col("__digest") == F.col("__chosen")) & F.col("__doc").eqNullSafe(F.col("__id")), "left_semi").dropDuplicates(["__digest"])
    whole = [F.array_sort(F.map_entries(f"`{f.name}`")) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in docs.schema]
    empty = docs.where(~worded).select(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(whole))).alias("__key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    return one.select("__row.*").unionByName(empty.dropDuplicates(["__key"]).select("__row.*"))


def miss_probability(k: int = K, shared: int = SHARED, similarity: float = 0.8) -> float:
    """Chance that a pair of just this similarity shares fewer than `shared` of the k smallest hashes of its union."""
    return sum(math.comb(k, i) * similarity**i * (1 - similarity) ** (k - i) for i in range(shared))
