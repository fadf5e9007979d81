"""Cosine similarity, retrieval and anchored clusters over vector columns (array of double)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators.graph import components, cut, first_wins
from tidemark.operators.tables import capped, top_per

#: Rows of a part of a block; two parts are compared in one task.
PART = 1024
#: Pivots of a block at most, and angles of rows to pivots that a task holds.
PIVOTS, DISTANCES = 4096, 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector or different lengths."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (length == 0), 0.0).otherwise(dot(a, b) / length)


def unit(v: Column) -> Column:
    """A vector divided by its length; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def with_unit(df: DataFrame, v: str = "v") -> DataFrame:
    return df.withColumn("u", unit(F.col(v)))


def as_queries(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(F.col("id").alias("query_id"), F.col("u").alias("q"), *(F.col(c).alias(f"query_{c}") for c in extra))


def in_blocks(rows: DataFrame, queries: DataFrame, on: list[str], compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, part: int = PART) -> DataFrame:
    """What `compare` gives for parts of rows (id, u) and of queries (query_id, q) that have the same `on`.

    Both sides are dealt to parts of about `part` rows, and two parts meet in one task: a stated query set against all
    rows, in blocks, so that neither a large group nor the whole query set goes to any one task.
    """
    sized = lambda df, n: df.groupBy(*on).agg(F.ceil(F.count("*") / part).cast("int").alias(n))
    sizes = sized(rows, "__nr").join(sized(queries, "__nq"), on) if on else rows.agg(F.ceil(F.count("*") / part).cast("int").alias("__nr")).join(queries.agg(F.ceil(F.count("*") / part).cast("int").alias("__nq")), F.lit(True))
    dealt = lambda df: df.join(sizes, on) if on else df.join(F.broadcast(sizes), F.lit(True))  # noqa: E731  # one row of two counts
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = dealt(rows).where("__nr > 0 AND __nq > 0").select(*rows.columns, own("id", "__nr").alias("__i"), each("__nq").alias("__j"))
    y = dealt(queries).where("__nr > 0 AND __nq > 0").select(*queries.columns, own("query_id", "__nq").alias("__j"), each("__nr").alias("__i"))
    y = y.toDF(*y.columns)  # its own columns, also where both sides come from one table
    key = [*on, "__i", "__j"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return compare(a, b) if len(a) and len(b) else pd.DataFrame()

    return x.groupBy(*key).cogroup(y.groupBy(*key)).applyInPandas(run, schema)


def _sims(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Similarities of a part of rows (down) and of queries (across)."""
    return np.round(np.stack(a["u"].to_numpy()) @ np.stack(b["q"].to_numpy()).T, 5)


def nearest(rows: DataFrame, queries: DataFrame, k: int, itself: bool = False, slack: float = 0.0) -> DataFrame:
    """The k most similar rows of each query, itself left out; with slack also those that are that little less similar.

    Each part of rows gives its k best for each query, so that k rows a part go on, not a row for each pair.
    """

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        sims, ids = _sims(a, b), a["id"].to_numpy()
        found = []
        for j, q in enumerate(b["query_id"].to_numpy()):
            at = np.arange(len(ids)) if itself else np.flatnonzero(ids != q)
            s = sims[at, j]
            if len(at) > k:
                near = s >= np.partition(s, -k)[-k] - slack
                at, s = at[near], s[near]
            order = np.lexsort((ids[at], -s))
            order = order[:k] if not slack else order
            found.append(pd.DataFrame({"query_id": q, "id": ids[at[order]], "sim": s[order]}))
        return pd.concat(found) if found else pd.DataFrame()

    kinds = {"query_id": dict(queries.dtypes)["query_id"], "id": dict(rows.dtypes)["id"]}
    sized = [df.select(*names, F.size(names[1]).alias("__size")).where(f"{names[1]} IS NOT NULL") for df, names in ((rows, ("id", "u")), (queries, ("query_id", "q")))]
    scored = in_blocks(*sized, ["__size"], best, f"query_id {kinds['query_id']}, id {kinds['id']}, sim double")
    if not slack:
        return top_per(scored, ["query_id"], [F.col("sim").desc(), F.col("id")], k, rank="rank")
    least = top_per(scored, ["query_id"], [F.col("sim").desc(), F.col("id")], k).groupBy("query_id").agg(F.min("sim").alias("__least"))
    return scored.join(least, "query_id").where(F.col("sim") >= F.col("__least") - slack).drop("__least")


def nearest_scored(rows: DataFrame, queries: DataFrame, k: int, weight: float, digits: int = 6) -> DataFrame:
    """query_id, id, score of the k best rows (id, u, bonus) of each query, itself left out, by weight * similarity + bonus."""

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        scores, ids = np.round(weight * _sims(a, b) + a["bonus"].to_numpy()[:, None], digits), a["id"].to_numpy()
        found = []
        for j, q in enumerate(b["query_id"].to_numpy()):
            at = np.flatnonzero(ids != q)
            order = at[np.lexsort((ids[at], -scores[at, j]))[:k]]
            found.append(pd.DataFrame({"query_id": q, "id": ids[order], "score": scores[order, j]}))
        return pd.concat(found)

    kinds = {"query_id": dict(queries.dtypes)["query_id"], "id": dict(rows.dtypes)["id"]}
    x = rows.select("id", "u", "bonus", F.size("u").alias("__size")).where("u IS NOT NULL AND bonus IS NOT NULL")
    y = queries.select("query_id", "q", F.size("q").alias("__size")).where("q IS NOT NULL")
    scored = in_blocks(x, y, ["__size"], best, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    return top_per(scored, ["query_id"], [F.col("score").desc(), F.col("id")], k)


def _best_of_group(rows: DataFrame, queries: DataFrame, k: int, per_day: int | None = None, least: float | None = None, part: int = 2 * PART) -> DataFrame:
    """query_id, id, ticker, day, sim: of each part of a query's ticker the k best rows, itself left out, and at most per_day of
    a day; with `least` only those above it.

    So few rows a part go on, not a row for each pair; what is among the best of all is among those of its part. Vectors that
    can't be compared (null, with nulls, of another length) have no similarity and come last; NaN counts as the largest.
    """
    whole = lambda v: F.when(~F.exists(v, lambda x: x.isNull()), F.col(v)).alias(v)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("id", ignore_index=True)
        ids, days = a["id"].to_numpy(), a["day"].to_numpy()
        sims, known = np.full((len(a), len(b)), np.nan), np.zeros((len(a), len(b)), bool)
        sizes = [np.array([-1 if v is None else len(v) for v in vs]) for vs in (a["u"], b["q"])]
        for n in np.intersect1d(*sizes):
            if n >= 0:
                i, j = (np.flatnonzero(s == n) for s in sizes)
                sims[np.ix_(i, j)], known[np.ix_(i, j)] = _sims(a.iloc[i], b.iloc[j]) + 0.0, True
        # 0: the largest (NaN), 1: a number, 2: none
        kind = np.where(known, np.where(np.isnan(sims), 0, 1), 2)
        found = []
        for j, q in enumerate(b["query_id"].to_numpy()):
            at = np.flatnonzero((ids != q) & (least is None or (kind[:, j] == 0) | (sims[:, j] > least)))
            at = at[np.lexsort((-sims[at, j], kind[at, j]))]  # stable, so equal ones stay by id
            if per_day is not None:
                by_day = np.argsort(days[at], kind="stable")
                sorted_days = days[at][by_day]
                place = np.arange(len(at)) - np.searchsorted(sorted_days, sorted_days)
                at = at[np.sort(by_day[place < per_day])]
            found.append((np.full(len(at[:k]), j), at[:k]))
        j, i = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"query_id": b["query_id"].to_numpy()[j], "id": ids[i], "ticker": a["ticker"].to_numpy()[i], "day": days[i], "sim": sims[i, j], "kind": kind[i, j]})

    x = rows.where("ticker IS NOT NULL AND id IS NOT NULL").select("id", "ticker", F.coalesce(F.unix_date(F.to_date("published_at")), F.lit(-(1 << 31))).alias("day"), whole("u"))
    y = queries.where("query_ticker IS NOT NULL AND query_id IS NOT NULL").select("query_id", F.col("query_ticker").alias("ticker"), whole("q"))
    kinds = {"query_id": dict(queries.dtypes)["query_id"], "id": dict(rows.dtypes)["id"], "ticker": dict(rows.dtypes)["ticker"]}
    scored = in_blocks(x, y, ["ticker"], best, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", day int, sim double, kind int", part)
    return scored.withColumn("sim", F.when(F.col("kind") == 0, F.lit(float("nan"))).when(F.col("kind") == 1, F.col("sim"))).drop("kind")


def retrieve(rows: DataFrame, queries: DataFrame, k: int, per_day: int) -> DataFrame:
    """Rows of a query's ticker by similarity, at most per_day of one ticker and day, then the best k."""
    scored = _best_of_group(rows, queries, k, per_day)
    return top_per(capped(scored, ["query_id", "ticker", "day"], "sim", per_day), ["query_id"], [F.col("sim").desc(), F.col("id")], k, rank="rank").withColumn("day", F.when(F.col("day") > -(1 << 31), F.date_from_unix_date("day")))


def best_above(rows: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """The most similar row of a query's ticker, if it is above the threshold."""
    scored = _best_of_group(rows, queries, 1, least=threshold)
    return top_per(scored.select("query_id", "id", "sim"), ["query_id"], [F.col("sim").desc(), F.col("id")], 1)


def assign(rows: DataFrame, anchors: DataFrame, t_assign: float = config.T_ASSIGN, block: str | None = None) -> DataFrame:
    """id, anchor_id, sim: the most similar anchor (of the block, where one is given) from t_assign up, else null; of equal ones the first."""

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("query_id", ignore_index=True)
        sims = _sims(a, b)
        at = sims.argmax(1)
        out = pd.DataFrame({"id": a["id"].to_numpy(), "anchor_id": b["query_id"].to_numpy()[at], "sim": sims[np.arange(len(at)), at]})
        return out[out["sim"] >= t_assign]

    side = lambda df, names, of: df.select(*names, *([F.col(of).alias("__block")] if block else []), F.size(names[1]).alias("__size")).where(f"{names[1]} IS NOT NULL")
    on = ["__block", "__size"] if block else ["__size"]
    kinds = {"id": dict(rows.dtypes)["id"], "anchor_id": dict(anchors.dtypes)["query_id"]}
    found = in_blocks(side(rows, ("id", "u"), block), side(anchors, ("query_id", "q"), f"query_{block}"), on, best, f"id {kinds['id']}, anchor_id {kinds['anchor_id']}, sim double")
    top = top_per(found, ["id"], [F.col("sim").desc(), F.col("anchor_id")], 1)
    return rows.select("id").join(top, "id", "left").select("id", "anchor_id", "sim")


def _cells(large: DataFrame, angle: float, part: int) -> DataFrame:
    """block, id, u, cell, away (angle to the cell's pivot), home: each row in the cell of its nearest pivot, and once more in
    each cell of a smaller number that may hold rows within the angle.

    Pivots are the rows of a block whose hash falls into one of `part` classes. A row x of the cell of p that is within
    the angle of a row of the cell of q is no more than twice the angle nearer to p than to q, as distances on the sphere;
    and it is no farther from q than the angle and the radius of q's cell. A task names the cells of each row, by which Spark repeats
    it: where bounds part few cells, a row goes to half of all. About DISTANCES angles are held at once.
    """
    hashed = F.pmod(F.xxhash64("id"), F.greatest(F.lit(part), F.ceil(F.col("n") / PIVOTS)))
    most = F.least(F.lit(8 * part), F.ceil(F.lit(DISTANCES) * F.greatest(F.lit(part), F.ceil(F.col("n") / PIVOTS)) / F.col("n")))
    deals = F.ceil(F.col("n") / most).cast("int")
    pivots = large.where(hashed == 0).select("block", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"), F.col("id").alias("pivot"), "u").toDF("block", "deal", "pivot", "u")
    rows = large.select("block", F.pmod(F.xxhash64("id", F.lit(1)), deals).cast("int").alias("deal"), "id", "u")

    def place(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame()
        us, none = a["u"].to_numpy(), np.zeros(0)
        if not len(b):
            return a[["block", "id", "u"]].assign(own=0, mine=0.0, cells=[none.astype(np.int32)] * len(a), aways=[none] * len(a))
        b = b.sort_values("pivot", ignore_index=True)
        away = np.arccos(np.clip(np.stack(us) @ np.stack(b["u"].to_numpy()).T, -1, 1))
        own = away.argmin(1)
        mine = away[np.arange(len(a)), own]
        near = (away - mine[:, None] <= 2 * angle) & (np.arange(len(b)) < own[:, None])
        cells = [np.flatnonzero(x) for x in near]
        return a[["block", "id", "u"]].assign(own=own, mine=mine, cells=[x.astype(np.int32) for x in cells], aways=[row[x] for row, x in zip(away, cells, strict=True)])

    kind = dict(large.dtypes)["id"]
    key = ["block", "deal"]
    named = rows.groupBy(*key).cogroup(pivots.groupBy(*key)).applyInPandas(place, f"block string, id {kind}, u array<double>, own int, mine double, cells array<int>, aways array<double>")
    at = lambda cell, away, home: F.struct(cell.alias("cell"), away.alias("away"), F.lit(home).alias("home"))
    every = F.concat(F.array(at(F.col("own"), F.col("mine"), True)), F.zip_with("cells", "aways", lambda c, x: at(c, x, False)))
    placed = cut(named.select("block", "id", "u", F.explode(every).alias("at")).select("block", "id", "u", "at.*"))
    radius = placed.where("home").groupBy("block", "cell").agg(F.max("away").alias("radius"))
    return placed.join(radius, ["block", "cell"]).where(F.col("home") | (F.col("away") - F.col("radius") <= angle)).drop("radius")


def meetings(rows: DataFrame, threshold: float, block: str | None = None, part: int = PART) -> DataFrame:
    """The rows (id, u) of each comparison (block, cell, i, j): all pairs that can reach the threshold meet in one of them.

    In comparison (i, j) rows of part i (`own`) meet those of part j; those brought from other cells have parts from -1 down.
    """
    side = rows.select("id", "u", F.concat(F.size("u"), F.lit("|"), F.col(block).cast("string") if block else F.lit("")).alias("block")).where("block IS NOT NULL AND u IS NOT NULL")
    angle = math.acos(max(-1.0, threshold - 5e-6)) + 1e-6 if threshold > 0 else math.pi
    if threshold > 0:
        side = side.where(F.exists("u", lambda x: x != 0))  # no row is similar to a zero vector
    side = cut(side)  # read for sizes, cells and counts
    sizes = side.groupBy("block").agg(F.count("*").alias("n"))
    sized = side.join(sizes, "block")
    whole = sized.select("block", "id", "u", F.lit(0).alias("cell"), F.lit(0.0).alias("away"), F.lit(True).alias("home"))
    if not sizes.where(F.col("n") > 2 * part).isEmpty():
        whole = whole.join(sizes.where(F.col("n") <= 2 * part).select("block"), "block", "left_semi").unionByName(_cells(sized.where(F.col("n") > 2 * part), angle, part))
    key = ["block", "cell"]
    counts = whole.groupBy(*key).agg(F.ceil(F.count_if("home") / part).cast("int").alias("h"), F.ceil(F.count_if(~F.col("home")) / part).cast("int").alias("o"))
    own = whole.join(counts, key)
    mine = own.where("home").withColumn("own", F.pmod(F.xxhash64("id"), F.col("h")).cast("int"))
    brought = own.where("NOT home").withColumn("own", (-1 - F.pmod(F.xxhash64("id"), F.col("o"))).cast("int"))
    all_h = F.sequence(F.lit(0), F.col("h") - 1)
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    among = F.transform(all_h, lambda x: pair(F.least("own", x), F.greatest("own", x)))
    others = F.when(F.col("o") > 0, F.transform(F.sequence(F.lit(1), F.greatest("o", F.lit(1))), lambda x: pair(F.col("own"), -x))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    met = mine.withColumn("at", F.explode(F.concat(among, others))).unionByName(brought.withColumn("at", F.explode(F.transform(all_h, lambda x: pair(x, F.col("own"))))))
    return met.select(*key, "at.i", "at.j", "own", "id", "u")


def compared(rows: DataFrame, threshold: float, block: str | None = None, part: int = PART) -> int:
    """How many pairs of rows `similar_pairs` compares."""
    sides = meetings(rows, threshold, block, part).groupBy("block", "cell", "i", "j").agg(F.count_if(F.col("own") == F.col("i")).alias("x"), F.count_if(F.col("own") == F.col("j")).alias("y"))
    pairs = F.when(F.col("i") == F.col("j"), F.col("x") * (F.col("x") - 1) / 2).otherwise(F.col("x") * F.col("y"))
    return int(sides.agg(F.sum(pairs)).first()[0] or 0)


def similar_pairs(rows: DataFrame, threshold: float, block: str | None = None, part: int = PART) -> DataFrame:
    """Pairs (a, b, sim), a < b, of rows (id, u) of one length from a threshold up, within a block column where one is given.

    A large block is cut into cells around pivots, and only cells that bounds on angles can't part meet; cells are dealt to
    parts of about `part` rows, two of which meet in one task as matrices. None of the pairs is a row before the threshold.
    """

    def compare(key: tuple, both: pd.DataFrame) -> pd.DataFrame:
        x, y = (both[both["own"] == k] for k in key[2:])
        found = []
        if len(x) and len(y):
            ids, others = x["id"].to_numpy(), y["id"].to_numpy()
            sims = np.round(np.stack(x["u"].to_numpy()) @ np.stack(y["u"].to_numpy()).T, 5)
            for p, q in zip(*np.nonzero(sims >= threshold), strict=True):
                if ids[p] < others[q] or (key[2] != key[3] and ids[p] != others[q]):
                    found.append((min(ids[p], others[q]), max(ids[p], others[q]), sims[p, q]))
        return pd.DataFrame(found, columns=["a", "b", "sim"])

    kind = dict(rows.dtypes)["id"]
    return meetings(rows, threshold, block, part).groupBy("block", "cell", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}, sim double")


def _merged(near: np.ndarray, x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    """a, b: each name of x (down) and y (across) with the smallest one that it is joined to, where that is another one."""
    names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    down, across, now = at[: len(x)], at[len(x) :], np.arange(len(names))
    while near.size:
        before = now.copy()
        np.minimum.at(now, down, np.where(near, now[across][None, :], len(names)).min(1))
        np.minimum.at(now, across, np.where(near, now[down][:, None], len(names)).min(0))
        now = now[now]
        if (now == before).all():
            break
    moved = np.flatnonzero(now != np.arange(len(names)))
    return pd.DataFrame({"a": names[now[moved]], "b": names[moved]})


def linked(rows: DataFrame, threshold: float, block: str | None = None, part: int = PART) -> DataFrame:
    """id, cluster of rows (id, u): components of the rows whose similarity reaches a threshold, within a block column if given.

    No pairs are written: a task gives each row the smallest one it is joined to. First all rows of a block meet about
    `part` of them, which join most rows where similar ones are common. Then only rows outside the block's largest
    component meet the others: pairs within it can't join anything. Where such rows are many, they meet in cells.
    """
    side = rows.select("id", "u", F.concat(F.size("u"), F.lit("|"), F.col(block).cast("string") if block else F.lit("")).alias("block")).where("block IS NOT NULL AND u IS NOT NULL")
    if threshold > 0:
        side = side.where(F.exists("u", lambda x: x != 0))  # no row is similar to a zero vector
    side, ids, kind = cut(side), cut(rows.select("id")), dict(rows.dtypes)["id"]
    sized = side.join(side.groupBy("block").agg(F.count("*").alias("n")), "block")
    deals = F.ceil(F.col("n") / (4 * part)).cast("int")
    dealt = sized.select("block", F.pmod(F.xxhash64("id", F.lit(1)), deals).cast("int").alias("deal"), "id", "u")
    hubs = sized.where(F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / part)) == 0)
    hubs = hubs.select("block", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"), F.col("id").alias("query_id"), F.col("u").alias("q")).toDF("block", "deal", "query_id", "q")

    def join(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = [df["cluster"] if "cluster" in df else df[key] for df, key in ((a, "id"), (b, "query_id"))]
        return _merged(_sims(a, b) >= threshold, *(x.to_numpy() for x in names)) if len(a) and len(b) else pd.DataFrame({"a": [], "b": []})

    pairs = f"a {kind}, b {kind}"
    found = components(ids, dealt.groupBy("block", "deal").cogroup(hubs.groupBy("block", "deal")).applyInPandas(join, pairs))
    large = sized.where(F.col("n") > part).select("block", "id", "u").join(found, "id")
    size = large.groupBy("block", "cluster").agg(F.count("*").alias("n"))
    major = size.groupBy("block").agg(F.max(F.struct("n", "cluster")).alias("top"), F.sum("n").alias("n")).select("block", F.col("top.cluster").alias("major"), (F.col("n") - F.col("top.n")).alias("minors")).where("minors > 0")
    left = cut(large.join(major, "block"))
    if left.isEmpty():
        return found
    few = left.where(F.col("minors") <= 16 * part)
    minor = few.where("cluster <> major").select(F.col("id").alias("query_id"), F.col("u").alias("q"), "cluster", "block")
    edges = in_blocks(few.select("id", "u", "cluster", "block"), minor, ["block"], join, pairs, 2 * part)
    many = left.where(F.col("minors") > 16 * part)
    if not many.isEmpty():

        def meet(key: tuple, both: pd.DataFrame) -> pd.DataFrame:
            x, y = (both[both["own"] == k] for k in key[2:])
            return join(x, y.rename(columns={"id": "query_id", "u": "q"}))

        edges = edges.unionByName(meetings(many, threshold, "block", part).groupBy("block", "cell", "i", "j").applyInPandas(meet, pairs))
    return components(ids, edges.unionByName(found.select(F.col("cluster").alias("a"), F.col("id").alias("b"))))


def clusters(rows: DataFrame, t_assign: float = config.T_ASSIGN, t_graph: float = config.T_GRAPH, block: str | None = None) -> DataFrame:
    """id and cluster of rows (id, u, anchor): those near an anchor join it; the others form components among themselves.

    With a block column, anchors and components stay within a block. cluster_type is 'seeded' (cluster: the anchor's id; anchors are members) or 'discovered' (the smallest id).
    """
    rows = cut(rows.select("id", "u", "anchor", *([block] if block else [])))  # vectors may come from a model, and are read often
    anchors, others = rows.where("anchor"), rows.where("NOT anchor")
    given = cut(assign(others, as_queries(anchors, *([block] if block else [])), t_assign, block).where("anchor_id IS NOT NULL"))
    rest = others.join(given.select("id"), "id", "left_anti")
    found = linked(rest, t_graph, block)
    seeded = given.select("id", F.col("anchor_id").alias("cluster")).unionByName(anchors.select("id", F.col("id").alias("cluster")))
    return seeded.withColumn("cluster_type", F.lit("seeded")).unionByName(found.withColumn("cluster_type", F.lit("discovered")))


def keep_first_similar(rows: DataFrame, threshold: float = config.DUPLICATE_AT, block: str | None = None) -> DataFrame:
    """Rows that have no earlier kept row (by id) at the threshold."""
    kept = first_wins(rows.select(F.col("id").alias("ord")), similar_pairs(rows, threshold, block))
    return rows.join(kept.withColumnRenamed("ord", "id"), "id", "left_semi")


def of_dimension(rows: DataFrame, n: int) -> DataFrame:
    """Rows whose unit vector (u) has n numbers; others can't be compared."""
    return rows.where(F.size("u") == n)


def retrieve_recent(rows: DataFrame, queries: DataFrame, k: int, per_day: int, allowed: Column) -> DataFrame:
    """Of a query's ticker the 3 * k newest rows, then those that are allowed, at most per_day of a day, then the best k."""
    newest = top_per(rows, ["ticker"], [F.col("published_at").desc(), F.col("id")], 3 * k + 1)  # one may be the query itself
    mine = newest.join(queries, (F.col("ticker") == F.col("query_ticker")) & (F.col("id") != F.col("query_id"))).withColumn("__ok", allowed)
    slim = mine.withColumn("sim", F.round(dot(F.col("u"), F.col("q")), 5)).select("query_id", "id", "published_at", F.to_date("published_at").alias("day"), "sim", "__ok")
    recent = top_per(slim, ["query_id"], [F.col("published_at").desc(), F.col("id")], 3 * k).where("__ok")
    return top_per(capped(recent, ["query_id", "day"], "sim", per_day), ["query_id"], [F.col("sim").desc(), F.col("id")], k, rank="rank")
