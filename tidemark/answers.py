"""Answers of language models, each asked for once.

Prompts are known by their hash; a stored table keeps the answer of each. Only prompts that it lacks go to the provider,
in batches that tasks pack, and what comes back is stored before it is used. So a second run asks nothing, a run that
dies asks again only what it had not stored, and the rows that callers see follow from the table alone. A batch that fails
has no answers: its rows fall back to what the caller does without a model, and are asked again in the next run.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import both, keyword_count
from tidemark.storage import Spec, exists, load, save, scratch, written

#: Prompts and what else the batch has in common (a ticker, say) to answers; None where there is none.
Provider = Callable[[str, list[str]], list[str | None]]
TABLE = Spec(("prompt_key",), "answer", replace=False)
ANSWERS = "prompt_key string, answer string"
#: Prompts of a call, and calls under way at once.
BATCH, CALLS = 10, 15


def asked_of(provider: Provider, batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """prompt_key and answer of rows (prompt_key, shared, prompt), asked for in batches of up to `size` that stand together
    and have `shared` in common, also where they lie in two record batches.

    Only the prompts of one call are strings of Python at once; of a record batch all answers go on together.
    """
    kept: list[tuple[str, str]] = []
    common = ""

    def call() -> Iterator[tuple[str, str]]:
        try:
            got = provider(common, [prompt for _, prompt in kept])
        except Exception:  # noqa: BLE001 - a provider may fail in any way; its rows fall back
            return
        if len(got) == len(kept):
            yield from ((key, x) for (key, _), x in zip(kept, got, strict=True) if x is not None)

    def rows(found: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["prompt_key", "answer"])

    for held in batches:
        found: list[tuple[str, str]] = []
        for at in range(0, held.num_rows, size):
            for row in zip(*(c.to_pylist() for c in held.slice(at, size).columns), strict=True):
                if kept and (len(kept) == size or row[1] != common):
                    found += call()
                    kept = []
                common = row[1]
                kept.append((row[0], row[2]))
        yield rows(found)
    if kept:
        yield rows(list(call()))


def answered(rows: DataFrame, prompt: Column, provider: Provider, path: str, shared: Column | None = None, batch: int = BATCH, calls: int = CALLS) -> DataFrame:
    """rows with answer: that of their prompt, null where the prompt is null or the provider gave none.

    `shared` is what all prompts of a batch have in common; it belongs to the prompt's hash. Equal prompts are asked once.
    """
    spark = rows.sparkSession
    same = F.coalesce(shared.cast("string"), F.lit("")) if shared is not None else F.lit("")
    keyed = rows.withColumn("__prompt", prompt).withColumn("__shared", same)
    keyed = keyed.withColumn("__key", F.when(F.col("__prompt").isNotNull(), F.sha2(F.concat_ws("\x1f", "__shared", "__prompt"), 256)))
    asked = keyed.where("__key IS NOT NULL").groupBy(F.col("__key").alias("prompt_key")).agg(F.min("__shared").alias("shared"), F.min("__prompt").alias("prompt"))
    if exists(spark, path):
        asked = asked.join(load(spark, path).select("prompt_key"), "prompt_key", "left_anti")

    dealt = asked.repartition(calls, "prompt_key") if shared is None else asked.repartition(calls).sortWithinPartitions("shared")
    new = dealt.select("prompt_key", "shared", "prompt").mapInArrow(lambda batches: asked_of(provider, batches, batch), ANSWERS)
    save(new, path, TABLE, distinct=True)  # it runs them once, so that each batch is asked in one place
    known = load(spark, path).select(F.col("prompt_key").alias("__key"), "answer")
    return keyed.join(known, "__key", "left").drop("__key", "__prompt", "__shared")


def numbered(model: Callable[[str], str], task: str) -> Provider:
    """A provider that puts the items of a batch into one prompt, numbered, and reads a JSON array of as many values.

    The array may stand in a fence or among other words. Anything else is an error, so that the batch falls back.
    """

    def ask(common: str, items: list[str]) -> list[str | None]:
        text = task.replace("{}", common) + "\n" + "\n".join(f"{i}. {x}" for i, x in enumerate(items, 1)) + "\nReturn only a JSON array with a value for each."
        said = model(text)
        found = json.loads(said[said.index("[") : said.rindex("]") + 1])
        if len(found) != len(items):
            raise ValueError("as many answers as items are needed")
        return [None if x is None else json.dumps(x) for x in found]

    return ask


def each(model: Callable[[str], str | None]) -> Provider:
    """A provider that asks for one prompt after another; one that fails has no answer."""

    def ask(_: str, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            try:
                out.append(model(p))
            except Exception:  # noqa: BLE001 - the others of the batch stay
                out.append(None)
        return out

    return ask


def relevant(rows: DataFrame, provider: Provider, path: str, words: Iterable[str], least: float = 0.3, batch: int = BATCH) -> DataFrame:
    """rows (ticker, title, summary) with relevant: what the model says of each for its ticker, else the keyword rule."""
    item = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\n   Summary: "), F.coalesce("summary", F.lit("No summary available")))
    said = answered(rows, item, provider, path, F.upper(F.trim("ticker")), batch)
    score = F.lit(0.4) + F.least(keyword_count(both(F.col("title"), F.col("summary")), words) * 0.1, F.lit(0.4))
    return said.withColumn("relevant", F.coalesce(F.when(F.col("answer").isin("true", "false"), F.col("answer") == "true"), score >= least)).drop("answer")


def filtered(rows: DataFrame, provider: Provider, path: str, words: Iterable[str], least: float = 0.3, existing: DataFrame | None = None) -> DataFrame:
    """The relevant rows, of those of one ticker and title (in either case) the first by id, without titles of existing rows."""
    kept = relevant(rows, provider, path, words, least).where("relevant").drop("relevant")
    key = F.lower(F.trim("title")).alias("__title")
    marked = kept.withColumn("__title", F.coalesce(F.lower(F.trim("title")), F.lit("")))
    if existing is not None:
        marked = marked.join(existing.select("ticker", key).distinct(), ["ticker", "__title"], "left_anti")
    first = marked.groupBy("ticker", "__title").agg(F.min("id").alias("id"))
    return marked.join(first, ["ticker", "__title", "id"], "left_semi").drop("__title")


def filter_of(kind: str, words: Iterable[str], provider: Provider | None = None, path: str | None = None, least: float = 0.3) -> Callable[[DataFrame], DataFrame]:
    """A filter of rows (id, ticker, title, summary) by its kind: 'keyword', or 'model', which without a provider is by
    keyword, too."""
    if kind not in ("keyword", "model"):
        raise ValueError(f"no filter of kind {kind}")
    if kind == "model" and provider:
        return lambda rows: filtered(rows, provider, path or scratch(rows.sparkSession, "answers"), words, least)
    score = F.lit(0.4) + F.least(keyword_count(both(F.col("title"), F.col("summary")), words) * 0.1, F.lit(0.4))
    return lambda rows: rows.where(score >= least)


def stories(clusters: DataFrame, model: Callable[[str], str | None], path: str) -> DataFrame:
    """clusters (cluster, ticker, day, articles: array of (id, title, summary), the anchor first) with title and summary of
    the story a model tells of each; clusters that it omits or doesn't answer for are left out."""
    lines = F.transform("articles", lambda a: F.concat(F.lit("- "), a["title"], F.coalesce(F.concat(F.lit(": "), a["summary"]), F.lit(""))))
    prompt = F.concat_ws("\n", F.format_string("Ticker %s on %s", F.col("ticker"), F.col("day").cast("string")), F.array_join(lines, "\n"))
    said = F.from_json("answer", "struct<title:string,summary:string,omit_story:boolean>")
    out = answered(clusters, prompt, each(model), path).withColumn("__s", said)
    return out.where("__s IS NOT NULL AND NOT coalesce(__s.omit_story, false)").select(*clusters.columns, "__s.title", "__s.summary")


def worth_long_story(rows: DataFrame, model: Callable[[str], str | None], path: str) -> DataFrame:
    """rows (title, summary, topics: array) with worth: whether a model says so; false without an answer."""
    prompt = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.array_join(F.coalesce("topics", F.array().cast("array<string>")), ", "))
    said = F.lower(F.trim("answer"))
    return answered(rows, prompt, each(model), path).withColumn("worth", F.coalesce(said.isin("true", "yes"), F.lit(False))).drop("answer")


def formatted(rows: DataFrame, model: Callable[[str], str | None], path: str, text: str = "text") -> DataFrame:
    """rows with their text as a model formats it; without an answer as it was."""
    return answered(rows, F.col(text), each(model), path).withColumn("formatted", F.coalesce(F.nullif(F.trim("answer"), F.lit("")), F.col(text))).drop("answer")


def proposed_groups(rows: DataFrame, model: Callable[[str], str | None], path: str, part: int = 400) -> DataFrame:
    """id, kept of the rows (ticker, id, title) that a model takes for repeats: kept is the smallest id of their group.

    A ticker's rows are shown by title, in parts of `part` of them; the answer is a JSON array of arrays of ids. Ids that were
    not shown don't count, nor do groups of one.
    """
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("ticker").orderBy(F.lower("title"), "id")) - 1
    dealt = written(rows.select("ticker", "id", "title").withColumn("__part", F.floor(order / part)), "shown")
    shown = dealt.groupBy("ticker", "__part").agg(F.sort_array(F.collect_list(F.struct("id", "title"))).alias("a"))
    prompt = F.concat(F.lit("Repeats of "), F.col("ticker"), F.lit("\n"), F.array_join(F.transform("a", lambda x: F.concat_ws("\t", x["id"].cast("string"), x["title"])), "\n"))
    said = answered(shown.select("ticker", "__part", prompt.alias("shown")), F.col("shown"), each(model), path).drop("shown")
    # an id is looked up by a join, so that no group goes through all that was shown
    named = said.select("ticker", "__part", F.posexplode(F.from_json("answer", "array<array<bigint>>")).alias("group", "g")).select("ticker", "__part", "group", F.explode("g").alias("id")).distinct()
    side = dealt.select(F.col("ticker").alias("__t"), F.col("__part").alias("__p"), F.col("id").cast("bigint").alias("__id")).distinct()
    known = named.join(side, F.col("ticker").eqNullSafe(F.col("__t")) & (F.col("__part") == F.col("__p")) & (F.col("id") == F.col("__id")), "left_semi")
    group = ["ticker", "__part", "group"]
    first = known.groupBy(*group).agg(F.min("id").alias("kept"))
    same = F.struct(*group).alias("k")  # a struct of nulls equals itself
    return known.select(same, "id").join(first.select(same, "kept"), "k").where("id <> kept").groupBy("id").agg(F.min("kept").alias("kept"))
