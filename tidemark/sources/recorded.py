"""Recorded payloads of news sources as a Spark data source: one partition for each (source, symbol, day) that is asked for.

`record` keeps payloads (source, symbol, day, body) under source=.../symbol=.../day=... folders. Reading walks these level
by level and enters only folders that the pushed filters allow, so that a window of days and a list of symbols cost what
they hold, not what the archive holds. The folder can be any that pyarrow's file systems reach (file, hdfs, s3, gs).
"""

from __future__ import annotations

import datetime
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from tidemark.sources import news

FORMAT = "recorded_payloads"
LEVELS = ("source", "symbol", "day")
_NONE = "__HIVE_DEFAULT_PARTITION__"
_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def record(payloads: DataFrame, path: str) -> None:
    """Adds payloads to an archive; the symbols stand there in upper case."""
    rows = payloads.select("source", F.upper("symbol").alias("symbol"), "day", "body")
    rows.repartition(*LEVELS).write.partitionBy(*LEVELS).mode("append").parquet(path)


@dataclass
class Payloads(InputPartition):
    """The files of one source, symbol and run of days."""

    source: str | None
    symbol: str | None
    files: list[tuple[datetime.date | None, str]]


class RecordedReader(DataSourceReader):
    def __init__(self, path: str, days: int) -> None:
        self.path, self.days = path, days
        self.tests: list[tuple[str, object, object]] = []  # level, comparison, value

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - Spark's name
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in LEVELS and type(f) in _COMPARED:
                self.tests.append((name, _COMPARED[type(f)], f.value))
            elif name in LEVELS and isinstance(f, In):
                self.tests.append((name, _among, tuple(f.value)))
            elif name in LEVELS and isinstance(f, IsNotNull):
                self.tests.append((name, _there, None))
            else:
                yield f

    def _folders(self, system: fs.FileSystem, at: str, level: str) -> list[tuple[object, str]]:
        """(value, path) of the folders of a level that pass its filters, in order."""
        found = []
        for info in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            name, _, raw = info.base_name.partition("=")
            if info.type == fs.FileType.Directory and name == level:
                value = None if raw == _NONE else unquote(raw)
                value = datetime.date.fromisoformat(value) if level == "day" and value else value
                if all(value is not None and test(value, x) for n, test, x in self.tests if n == level):
                    found.append((value, info.path))
        return sorted(found, key=lambda x: (x[0] is not None, str(x[0])))

    def partitions(self) -> list[Payloads]:
        system, root = _system(self.path)
        out = []
        for source, one in self._folders(system, root, "source"):
            for symbol, two in self._folders(system, one, "symbol"):
                days = self._folders(system, two, "day")
                out += [Payloads(source, symbol, days[i : i + self.days]) for i in range(0, len(days), self.days)]
        return out

    def read(self, partition: Payloads | None) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        for day, folder in partition.files if partition else ():
            for info in system.get_file_info(fs.FileSelector(folder)):
                if info.type == fs.FileType.File and info.base_name.endswith(".parquet"):
                    with system.open_input_file(info.path) as f:
                        for batch in pq.ParquetFile(f).iter_batches(columns=["body"]):
                            n = len(batch)
                            fixed = (pa.array([partition.source] * n, pa.string()), pa.array([partition.symbol] * n, pa.string()), pa.array([day] * n, pa.date32()))
                            yield pa.RecordBatch.from_arrays([*fixed, batch.column(0)], names=[*LEVELS, "body"])


def _among(value: object, values: tuple) -> bool:
    return value in values


def _there(value: object, _: None) -> bool:
    return value is not None


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class RecordedPayloads(DataSource):
    """Options: path; days_per_task (1), the days of one source and symbol that a task reads."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "source string, symbol string, day date, body string"

    def reader(self, schema) -> RecordedReader:
        return RecordedReader(self.options["path"], int(self.options.get("days_per_task", 1)))


def read(spark: SparkSession, path: str, days_per_task: int = 1) -> DataFrame:
    """source, symbol, day, body of an archive; filters on the first three choose its partitions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedPayloads)
    return spark.read.format(FORMAT).option("days_per_task", days_per_task).load(path)


def asked(payloads: DataFrame, since: datetime.datetime, until: datetime.datetime, sources: Iterable[str], symbols: Iterable[str] | None = None) -> DataFrame:
    """Payloads of a closed time range; a payload of a day answers for the items of that UTC day."""
    rows = payloads.where(F.col("source").isin(list(sources)) & (F.col("day") >= F.lit(since.date())) & (F.col("day") <= F.lit(until.date())))
    return rows if symbols is None else rows.where(F.col("symbol").isin([s.strip().upper() for s in symbols]))


def collect(spark: SparkSession, path: str, since: datetime.datetime, until: datetime.datetime, now: Column, sources: Iterable[str] = tuple(news.ADAPTERS), symbols: Iterable[str] | None = None, days_per_task: int = 1) -> DataFrame:
    """News of some sources and symbols in a closed time range, from the payloads of these alone."""
    sources = list(sources)
    payloads = asked(read(spark, path, days_per_task), since, until, sources, symbols)
    # each adapter asks for its own source, which is pushed down too
    return news.collect(payloads, F.lit(since), F.lit(until), now, sources)
