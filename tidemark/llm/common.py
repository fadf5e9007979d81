"""What the operators of this subpackage share: tables, cut lineage, spread ranks."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranks are counted within so many ranges of a hash; a range is the largest unit that one task sorts.
RANK_RANGES = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode a temporary one where that is unset, elsewhere an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = Path(tempfile.mkdtemp(prefix="tidemark-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends here and lost executors only cost a re-read.

    The table is removed by `discard`, or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that no plan reads any more."""
    for df in tables:
        _remove(df.sparkSession, df.stored_at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may have ended first
        pass


def spread(*cols: Column) -> Column:
    """A range number from 0 to RANK_RANGES - 1, in the order of `spread_key` of the same columns."""
    return F.floor(spread_key(*cols) * F.lit(RANK_RANGES) / F.lit(2147483647)).cast("int")


def spread_key(*cols: Column) -> Column:
    """A number below 2**31 - 1 from integer columns (null counts as 0), plain enough for any SQL dialect."""
    total = F.lit(0).cast("long")
    for c, m in zip(cols, (48271, 69621, 16807), strict=False):
        total = total + F.pmod(F.coalesce(c.cast("long"), F.lit(0)), F.lit(2147483647)) * F.lit(m)
    return F.pmod(total, F.lit(2147483647))


def gapless_rank(df: DataFrame, group: str, ranges: str, order: list[Column], out: str) -> DataFrame:
    """Adds `out`: the rank from 0 within `group`, by (`ranges`, order).

    No task sorts more than one range of a group. Rows are first counted by (group, range), with map-side sums; the
    running totals (groups x RANK_RANGES rows at most) are joined back as each range's first rank.
    """
    counts = df.groupBy(group, ranges).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy(ranges).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(group).alias("__g"), F.col(ranges).alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy(group, ranges).orderBy(*order)
    ranked = df.withColumn("__rank", F.row_number().over(within) - 1)
    return ranked.join(first, F.col(group).eqNullSafe(F.col("__g")) & (F.col(ranges) == F.col("__r"))).withColumn(out, F.col("__first") + F.col("__rank")).drop("__g", "__r", "__first", "__rank")
