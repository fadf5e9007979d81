"""Stored tables: rows that are new, rows in place of older ones, and the rules of each logical table.

A stored table is a folder with `data` and `log`. A version is a small file of the log that names the data folders of the
table's parts; a part holds the keys whose hash ends in certain bits. A write reads and rewrites only the parts that its
rows belong to, in new folders, and then puts the next version into place with one rename. So a write or delete that dies
before that leaves the table as it was, readers of a version are never disturbed, and a write that finds another version
put first is done again on that. Parts are split in two as the table grows, each when it is next written.
"""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.tables import insert_ignore, upsert

PART = "part_of_key"
#: Last bits of hashes by which a write counts its rows.
ENDS = 10


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode a temporary one where that is unset, elsewhere an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = Path(tempfile.mkdtemp(prefix="tidemark-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may have ended first
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back, so that lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Spec:
    """A logical table: its key, the order that decides between rows of one key, and whether a later row replaces."""

    keys: tuple[str, ...]
    order: str
    replace: bool = True
    part_rows: int = 1 << 20  # a part of more rows than this, on average, is split


#: What identifies a row of each logical table, and whether a second row of a key is ignored or replaces the first.
TABLES = {
    "news_articles": Spec(("ticker", "article_key"), "id", replace=False),
    "macro_articles": Spec(("id",), "published_at", replace=False),
    "macro_raw_items": Spec(("id",), "relevance_score"),
    "stocks": Spec(("ticker",), "name"),
    "stock_prices_5min": Spec(("ticker", "timestamp"), "volume"),
    "sec_filings": Spec(("ticker", "accession_number"), "id", replace=False),
    "sec_filing_chunks": Spec(("id",), "chunk_index", replace=False),
    "story": Spec(("id",), "asof_date", replace=False),
    "story_article_link": Spec(("story_id", "article_id"), "role", replace=False),
    "story_filing_link": Spec(("story_id",), "filing_id", replace=False),
    "long_stories": Spec(("id",), "last_updated_at"),
    "long_story_article_links": Spec(("long_story_id", "article_id"), "latest_update_at"),
    "macro_briefs": Spec(("as_of_date", "asset", "topic"), "revision"),
    "macro_daily_summary": Spec(("as_of_date",), "revision"),
    "macro_daily_impact_reports": Spec(("as_of_date", "portfolio_id"), "revision"),
    "macro_kb_books": Spec(("source_uri",), "revision"),
    "macro_kb_chunks": Spec(("id",), "revision"),
    "search_index": Spec(("kind", "id"), "revision"),
}


class Conflict(RuntimeError):
    """Another write put the next version into place first."""


@dataclass
class Part:
    """The rows whose hash has the last `bits` bits `value`."""

    bits: int
    value: int
    folder: str
    rows: int


@dataclass
class Version:
    number: int = 0
    keys: list[str] = field(default_factory=list)
    schema: str = ""
    bits: int = 0
    parts: list[Part] = field(default_factory=list)

    def text(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def of(text: str) -> Version:
        d = json.loads(text)
        return Version(**d | {"parts": [Part(**p) for p in d["parts"]]})


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a table's versions, ascending; empty where there is no table."""
    fs, at = _fs(spark, f"{path}/log")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d+\.json", n))


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A version, the last one by default; number 0 of no table."""
    known = versions(spark, path)
    if not known:
        return Version()
    name = f"{path}/log/{known[-1] if number is None else number:020d}.json"
    fs, at = _fs(spark, name)
    stream = fs.open(at)
    try:
        return Version.of(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, new: Version) -> None:
    """Puts a version into place by a rename that fails where it stands already."""
    fs, target = _fs(spark, f"{path}/log/{new.number:020d}.json")
    _, draft = _fs(spark, f"{path}/log/.{uuid.uuid4().hex}")
    out = fs.create(draft)
    try:
        out.write(bytearray(new.text().encode()))
    finally:
        out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise Conflict(f"version {new.number} of {path} is there already")


def exists(spark: SparkSession, path: str) -> bool:
    return bool(versions(spark, path))


def _read(spark: SparkSession, path: str, at: Version, parts: Sequence[Part]) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(at.schema))
    return spark.read.schema(schema).parquet(*(f"{path}/{p.folder}" for p in parts)) if parts else spark.createDataFrame([], schema)


def load(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of a version, the last one by default; the folders that it names don't change."""
    at = version(spark, path, number)
    if not at.number:
        raise FileNotFoundError(path)
    return _read(spark, path, at, at.parts)


def _bits_of(keys: Sequence[str], bits: int):
    return F.xxhash64(*keys).bitwiseAND(F.lit((1 << bits) - 1)).cast("long")


def _holding(at: Version, values: set[int]) -> list[Part]:
    """Parts with hashes that end like one of these values, which have no fewer bits than any part."""
    ends = {bits: {v & (1 << bits) - 1 for v in values} for bits in {p.bits for p in at.parts}}
    return [p for p in at.parts if p.value in ends[p.bits]]


def _put(spark: SparkSession, path: str, at: Version, gone: list[Part], rows: DataFrame, keys: list[str], bits: int) -> None:
    """The next version: rows in the place of some parts. Large parts are written by several tasks, a file each."""
    folder = f"data/{uuid.uuid4().hex}"
    dealt = rows.withColumn(PART, _bits_of(keys, bits))
    dealt.hint("rebalance", F.col(PART)).write.partitionBy(PART).parquet(f"{path}/{folder}")
    sizes = spark.read.schema(T.StructType([*rows.schema, T.StructField(PART, T.LongType())])).parquet(f"{path}/{folder}").groupBy(PART).count().collect()  # a row for each part
    old = {id(p) for p in gone}
    kept = [p for p in at.parts if id(p) not in old]
    new = [Part(bits, r[PART], f"{folder}/{PART}={r[PART]}", r["count"]) for r in sizes]
    commit(spark, path, Version(at.number + 1, list(keys), rows.schema.json(), bits, kept + new))


def save(rows: DataFrame, path: str, spec: Spec, attempts: int = 4, distinct: bool = False) -> int:
    """Rows into the table at path, and how many there were. Of rows with one key the first in the table's order goes in where later ones are
    ignored, else the last; rows with a null in the key are left out. Only parts with such keys are read and written.

    The columns are those of the rows; a column that the table has and the rows lack stays, with nulls for the new ones.
    `distinct` rows, of which no two have one key, are not sorted by it; none at all leave a table as it is.
    """
    spark, keys = rows.sparkSession, list(spec.keys)
    new = written(rows.dropna(subset=keys), "new")  # what the rows are made of is run once
    ends = {r["end"]: r["count"] for r in new.groupBy(_bits_of(keys, ENDS).alias("end")).count().collect()}  # 2 ** ENDS rows at most
    for attempt in range(attempts):
        at = version(spark, path)
        if distinct and at.number and not ends:
            return 0
        n = sum(ends.values()) + sum(p.rows for p in at.parts)
        bits = max(at.bits, (max(0, n - 1) // spec.part_rows).bit_length())
        few = {end & (1 << bits) - 1 for end in ends}
        hit = few if bits <= ENDS else {r[PART] for r in new.select(_bits_of(keys, bits).alias(PART)).distinct().collect()}  # numbers of parts
        touched = _holding(at, hit)
        old = _read(spark, path, at, touched) if at.number else spark.createDataFrame([], new.schema)
        lacking = [c for c in old.columns if c not in new.columns]
        given = new.select("*", *(F.lit(None).cast(old.schema[c].dataType).alias(c) for c in lacking))
        old = old.select(*(F.col(c) if c in old.columns else F.lit(None).cast(given.schema[c].dataType).alias(c) for c in given.columns))
        if distinct and not touched:
            merged = given
        else:
            merged = (upsert if spec.replace else insert_ignore)(old, given, keys, None if distinct else spec.order)
        try:
            _put(spark, path, at, touched, merged, keys, bits)
            return sum(ends.values())
        except Conflict:
            if attempt == attempts - 1:
                raise
    return 0


def delete(spark: SparkSession, path: str, gone: DataFrame, keys: Sequence[str], attempts: int = 4) -> None:
    """Without the rows whose key is in `gone`; only parts that hold such rows are written again."""
    keys, gone = list(keys), gone.select(*keys).distinct()
    for attempt in range(attempts):
        at = version(spark, path)
        own = at.keys
        table = _read(spark, path, at, at.parts)
        hit = {r[PART] for r in table.join(gone, keys, "left_semi").select(_bits_of(own, at.bits).alias(PART)).distinct().collect()}  # numbers of parts
        touched = _holding(at, hit)
        if not touched:
            return None
        kept = _read(spark, path, at, touched).join(gone, keys, "left_anti").select(*table.columns)
        try:
            return _put(spark, path, at, touched, kept, own, at.bits)
        except Conflict:
            if attempt == attempts - 1:
                raise


def truncate(spark: SparkSession, path: str) -> None:
    """An empty table of the same columns."""
    at = version(spark, path)
    commit(spark, path, Version(at.number + 1, at.keys, at.schema, 0, []))


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Removes data that none of the last `keep` versions names, and the log of older ones. No write may be under way."""
    known = versions(spark, path)
    named = {p.folder for n in known[-keep:] for p in version(spark, path, n).parts}
    for n in known[:-keep]:
        remove(spark, f"{path}/log/{n:020d}.json")
    fs, data = _fs(spark, f"{path}/data")
    for commit_folder in fs.listStatus(data) if fs.exists(data) else []:
        parts = [s.getPath() for s in fs.listStatus(commit_folder.getPath())]
        spare = [p for p in parts if f"data/{commit_folder.getPath().getName()}/{p.getName()}" not in named]
        for p in [commit_folder.getPath()] if len(spare) == len(parts) else spare:
            fs.delete(p, True)
