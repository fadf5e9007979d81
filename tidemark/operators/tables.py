"""Table reads, joins, ranking and write rules. Ties always end in a unique key, so results are stable."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, n: int, at: str = "published_at", key: str = "id", where: Column | None = None) -> DataFrame:
    """The n newest rows, after a filter; Spark keeps n rows a task."""
    return (df if where is None else df.where(where)).orderBy(F.col(at).desc_nulls_last(), key).limit(n)


def latest_per(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of the largest `order` for each key, by a map-side maximum rather than a sort."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    top = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__top"))
    return top.select(*keys, *(F.col(f"__top.{c}").alias(c) for c in df.columns if c not in keys))


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: Column | int, rank: str | None = None, most: int | None = None) -> DataFrame:
    """The first n rows of each group; n may depend on the group, then `most` bounds it, so that tasks can cut before the shuffle."""
    out = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = (out if most is None else out.where(F.col("__n") <= most)).where(F.col("__n") <= n)
    return out.withColumnRenamed("__n", rank) if rank else out.drop("__n")


def capped(df: DataFrame, keys: list[str], score: str, n: int, key: str = "id") -> DataFrame:
    """At most n rows of each group, the best scored."""
    return top_per(df, keys, [F.col(score).desc_nulls_last(), F.col(key)], n)


def primary_and_cross(df: DataFrame, group: str, primary: str, score: str, k_primary: int, k_other: int, key: str) -> DataFrame:
    """The best rows of one group, and fewer of each other group."""
    return top_per(df, [group], [F.col(score).desc(), F.col(key)], F.when(F.col(group) == primary, k_primary).otherwise(k_other), rank="rank", most=max(k_primary, k_other))


#: Rows of a group and day that are sorted together, on average.
RANGE = 1 << 16


def carried(both: DataFrame, by: str, at: str, order: list[str], value: str, back: bool = False) -> DataFrame:
    """both with __found: the last `value` (not null) of the group `by` up to each row, in (at, *order); backwards in time on demand.

    Rows are sorted within a range only: a group and day, cut where about every RANGE-th row stands in the order (rows that
    are equal in it are cut by a hash). The last value of each range (map-side) is carried on over the ranges of the group
    and joined back. So one large group is spread over its days, and one large day over its ranges.
    """
    day = F.coalesce(F.unix_date(F.to_date(at)), F.lit(-(1 << 30)))
    plain = [c for c, kind in both.dtypes if "map<" not in kind]
    rows = both.withColumn("__day", day).withColumn("__salt", F.xxhash64(*plain))
    key = F.struct(F.col(at).alias("at"), *order, "__salt")
    cuts = rows.where(F.pmod("__salt", F.lit(RANGE)) == 0).groupBy(F.col(by).alias("__cb"), F.col("__day").alias("__cd")).agg(F.sort_array(F.collect_list(key)).alias("__cuts"))
    rows = rows.join(cuts, F.col(by).eqNullSafe(F.col("__cb")) & (F.col("__day") == F.col("__cd")), "left")
    rows = rows.withColumn("__slot", F.when(F.col("__cuts").isNull(), 0).otherwise(F.size(F.filter("__cuts", lambda c: c <= key)))).drop("__cuts", "__cb", "__cd")
    way = [F.col(at).desc() if back else F.col(at).asc_nulls_first(), *(F.col(c).desc() if back else F.col(c) for c in [*order, "__salt"])]
    within = Window.partitionBy(by, "__day", "__slot").orderBy(*way).rowsBetween(Window.unboundedPreceding, 0)
    edge = F.struct(at, *order, "__salt", value)
    ends = rows.groupBy(by, "__day", "__slot").agg((F.min if back else F.max)(F.when(F.col(value).isNotNull(), edge)).alias("__e"))
    ranges = Window.partitionBy(by).orderBy(*(F.col(c).desc() if back else F.col(c) for c in ("__day", "__slot"))).rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(F.col(by).alias("__b"), F.col("__day").alias("__d"), F.col("__slot").alias("__s"), F.last(F.col(f"__e.{value}"), ignorenulls=True).over(ranges).alias("__carry"))
    seen = rows.withColumn("__in", F.last(value, ignorenulls=True).over(within))
    joined = seen.join(before, F.col(by).eqNullSafe(F.col("__b")) & (F.col("__day") == F.col("__d")) & (F.col("__slot") == F.col("__s")), "left")
    return joined.withColumn("__found", F.coalesce("__in", "__carry")).drop("__in", "__carry", "__b", "__d", "__s", "__day", "__slot", "__salt")


def as_of(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, right_key: str, prefix: str) -> DataFrame:
    """Each left row with the latest right row of its group up to its time (ties: largest right key), or nulls.

    Both sides are sorted together within each group and day and the last right row is carried on, so no pair of rows is
    built. All left rows stay, also those without a group or time.
    """
    value = F.struct(F.col(right_at).alias("at"), F.col(right_key).alias("key"), *(F.col(c) for c in right.columns if c not in (by, right_at, right_key)))
    rights = right.where(F.col(by).isNotNull() & F.col(right_at).isNotNull()).select(F.col(by).alias("__by"), F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.col(right_key).alias("__key"), value.alias("__r"))
    lefts = left.select(F.col(by).alias("__by"), F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"))
    found = carried(rights.unionByName(lefts, allowMissingColumns=True), "__by", "__at", ["__side", "__key"], "__r").where("__side = 1")
    extra = [c for c in right.columns if c not in (by, right_at, right_key)]
    return found.select("__l.*", F.col("__found.at").alias(f"{prefix}{right_at}"), F.col("__found.key").alias(f"{prefix}{right_key}"), *(F.col(f"__found.{c}").alias(f"{prefix}{c}") for c in extra))


def has_between(left: DataFrame, right: DataFrame, by: str, low: str, high: str, at: str) -> DataFrame:
    """Left rows for which the right table has a row of the group with low < at <= high.

    The earliest right row after `low` decides, so it is found backwards in time from the low end and compared once.
    """
    later = right.select(F.col(by).alias("__by"), F.col(at).alias("__t"), F.lit(0).alias("__side"), F.col(at).alias("__next")).where(F.col("__t").isNotNull()).distinct()
    lefts = left.select(F.col(by).alias("__by"), F.col(low).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"))
    # backwards, of equal times the left row comes first and doesn't see the right one
    both = carried(lefts.unionByName(later, allowMissingColumns=True), "__by", "__t", ["__side"], "__next", back=True)
    return both.where("__side = 1 AND __t IS NOT NULL AND __by IS NOT NULL").where(F.col("__found") <= F.col(f"__l.{high}")).select("__l.*")


def without(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """existing and the new rows of unknown keys; of new rows with one key the first in `order` (without one there are none)."""
    first = new if order is None else top_per(new, keys, [F.col(order)], 1)
    return existing.unionByName(first.join(existing.select(*keys).distinct(), keys, "left_anti"))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """existing with the new rows in place of those of their keys; of new rows with one key the last in `order` (without one there are none)."""
    last = new if order is None else top_per(new, keys, [F.col(order).desc()], 1)
    return existing.join(last.select(*keys), keys, "left_anti").unionByName(last)


def keep_newest(links: DataFrame, group: str, at: str, key: str, most: int = 30) -> DataFrame:
    """At most `most` links of each group, the newest."""
    return top_per(links, [group], [F.col(at).desc(), F.col(key)], most)


def fused(rankings: Mapping[str, DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of tables (key, rank): summed 1 / (k + rank)."""
    out = None
    for df in rankings.values():
        part = df.select(key, (1.0 / (k + F.col("rank"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.sum("part").alias("score"))


def span_months(df: DataFrame, month: Column, score: Column, per_month: int, n: int, key: str) -> DataFrame:
    """The n best rows, at most per_month of each month; rows without a month are not held back."""
    marked = df.withColumn("__m", month).withColumn("__s", score)
    best = [F.col("__s").desc(), F.col(key)]
    dated = top_per(marked.where(F.col("__m").isNotNull()), ["__m"], best, per_month)
    return dated.unionByName(marked.where(F.col("__m").isNull()).orderBy(*best).limit(n)).orderBy(*best).limit(n).drop("__m", "__s")


def missing_days(df: DataFrame, group: str, day: Column, days: Column) -> DataFrame:
    """(group, day) of the days of a calendar that a group has no row for."""
    had = df.select(F.col(group), day.alias("day")).distinct()
    grid = had.select(group).distinct().select(group, F.explode(days).alias("day"))
    return grid.join(had, [group, "day"], "left_anti")


def looked_up(df: DataFrame, key: str, values: list) -> DataFrame:
    """Rows of some keys; a list of keys becomes a filter that the scan gets."""
    return df.where(F.col(key).isin(values))


def of_symbols(df: DataFrame, column: str, symbols: list[str]) -> DataFrame:
    """Rows of some symbols, in either case; blanks around a symbol don't count."""
    return df.where(F.upper(F.trim(column)).isin([s.strip().upper() for s in symbols]))


def within(df: DataFrame, at: str, since: Column, until: Column) -> DataFrame:
    """Rows of a closed time range; rows without a time drop out."""
    return df.where(F.col(at).between(since, until))


def first_of_id(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by a map-side minimum; rows without a key drop out."""
    rest = [c for c in df.columns if c not in (key, order)]
    top = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(order, *rest)).alias("__top"))
    return top.select(*(F.col(key) if c == key else F.col(f"__top.{c}").alias(c) for c in df.columns))


def unseen_added(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """df and the rows of `new` whose key it doesn't have."""
    return df.unionByName(new.join(df.select(*keys).distinct(), keys, "left_anti").select(*df.columns))


def months_complete(df: DataFrame, group: str, day: Column, months: list[Column]) -> DataFrame:
    """Whether a group has rows on each sample day of a month: the 1st, 3rd, 7th, 15th, 22nd, the middle and the last day."""
    had = df.select(group, day.alias("day")).distinct()
    size = F.dayofmonth(F.last_day("m"))
    days = F.array(F.lit(1), F.floor(size / 2), size, F.lit(3), F.lit(7), F.lit(15), F.lit(22))
    grid = had.select(group).distinct().select(group, F.explode(F.array(*months)).alias("m")).select(group, "m", F.explode(days).alias("n"))
    grid = grid.select(group, "m", F.date_add("m", (F.col("n") - 1).cast("int")).alias("day"))
    seen = grid.join(had.withColumn("seen", F.lit(True)), [group, "day"], "left")
    return seen.groupBy(group, F.date_format("m", "yyyy-MM").alias("month")).agg(F.bool_and(F.coalesce("seen", F.lit(False))).alias("complete"))
