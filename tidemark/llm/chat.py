"""Preference formatting: the longest common turn prefix of two conversations once as prompt, then masked completions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers that are counted together. A pair of more than about so many turns takes several rows, so that no row grows
#: without bound.
PART = 4096
#: How a turn is written; text between start and stop of an assistant turn, stop included, is what is learnt.
START, MIDDLE, STOP = "<|im_start|>", "\n", "<|im_end|>\n"
LEARNT = "assistant"
_OUT = "prompt string, chosen string, rejected string, prompt_turns int, chosen_turns int, rejected_turns int, chosen_mask array<struct<start:int,end:int>>, rejected_mask array<struct<start:int,end:int>>"


def escaped(text: str) -> str:
    """Text in which no mark of a turn stands: a backslash follows its first sign."""
    return text.replace("<|im_", "<\\|im_")


def render(turns: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """Turns (role, text) as one string, and the spans (code points, end exclusive) that count for the loss."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = START + escaped(role) + MIDDLE
        piece = head + escaped(text) + STOP
        if role == LEARNT:
            spans.append({"start": at + len(head), "end": at + len(piece)})
        out.append(piece)
        at += len(piece)
    return "".join(out), spans


def format_preferences(turns: DataFrame, pair: Column, side: Column, part: int = PART) -> DataFrame:
    """Rows of pairs from turns (conv_id, turn, role, text); side is 0 for chosen and 1 for rejected.

    One row per pair: pair_id, prompt (the common prefix), chosen and rejected (the completions), counts of turns, loss
    masks as spans of the completions, and repeated_rows, how many rows repeat another one of the pair; part and
    part_of_turn are 0. Only a pair with 2 * `part` rows before a range of `part` turn numbers, or with as many as `part`
    of one turn number, takes several rows, each with its piece of the prompt and of the completions; how large or sparse
    the turn numbers are doesn't matter. Turns are in the order (turn, role, text); equal rows are written once, and
    several rows of one turn number follow each other. Null turn numbers count as -1 and come first, null roles as
    'unknown', null texts as empty; rows without a pair or side are left out. A pair of which
    one side is missing has an empty prompt and an empty completion there. Marks of turns within a text or role are
    escaped. Texts of any length are written whole, an empty table gives no rows, and other columns, whatever their
    names, are not read.
    """
    rows = turns.select(
        pair.alias("pair_id"), side.cast("int").alias("__side"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("__turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).where("pair_id IS NOT NULL AND __side IN (0, 1)")
    rows = rows.groupBy("pair_id", "__side", "__turn", "role", "text").agg(F.count("*").alias("__n"))
    sub = F.row_number().over(Window.partitionBy("pair_id", "__side", "__turn").orderBy("role", "text")) - 1
    rows = rows.withColumn("__sub", sub).withColumn("__range", F.greatest(F.lit(0), F.floor(F.col("__turn") / part))).withColumn("part_of_turn", F.floor(F.col("__sub") / part))
    ranges = rows.groupBy("pair_id", "__range").agg(F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.partitionBy("pair_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(ranges.select("pair_id", "__range", F.floor(before / (2 * part)).alias("part")), ["pair_id", "__range"])
    turn = F.struct("__turn", "__sub", "__side", "role", "text")
    parts = rows.groupBy("pair_id", "part", "part_of_turn").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.sum(F.col("__n") - 1).alias("repeated_rows"))
    of = lambda s: F.filter("turns", lambda t: t["__side"] == s)
    bare = lambda s: F.transform(of(s), lambda t: F.struct(t["__turn"], t["__sub"], t["role"], t["text"]))
    odd = F.concat(F.array_except(bare(0), bare(1)), F.array_except(bare(1), bare(0)))
    first = F.array_min(F.transform(odd, lambda t: F.struct(t["__turn"].alias("turn"), t["__sub"].alias("sub"))))
    cut = parts.withColumn("__odd", first).groupBy("pair_id").agg(F.min("__odd").alias("cut")).withColumnRenamed("pair_id", "__pair")
    joined = parts.join(cut, F.col("pair_id") == F.col("__pair"), "left").drop("__pair")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for turns, cut in zip(batch["turns"], batch["cut"], strict=True):
                end = (cut["turn"], cut["sub"]) if isinstance(cut, dict) else None
                before = lambda t: end is None or (t["__turn"], t["__sub"]) < end  # noqa: B023, E731
                prompt = [(t["role"], t["text"]) for t in turns if before(t) and t["__side"] == 0]
                sides = [[(t["role"], t["text"]) for t in turns if not before(t) and t["__side"] == s] for s in (0, 1)]
                (chosen, chosen_mask), (rejected, rejected_mask) = map(render, sides)
                out.append((render(prompt)[0], chosen, rejected, len(prompt), len(sides[0]), len(sides[1]), chosen_mask, rejected_mask))
            made = pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])
            for c in ("repeated_rows", "part_of_turn", "part", "pair_id"):
                made.insert(0, c, batch[c].array)
            yield made

    kind = dict(parts.dtypes)["pair_id"]
    return joined.mapInPandas(write, f"pair_id {kind}, part long, part_of_turn long, repeated_rows long, {_OUT}")


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs of conversations 2n (chosen) and 2n + 1 (rejected)."""
    return format_preferences(turns, F.shiftright(F.col("conv_id").cast("long"), 1), F.pmod(F.col("conv_id"), F.lit(2)))


def masks_as_text(formatted: DataFrame) -> DataFrame:
    """Masks as 'start:end', comma-joined."""
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return formatted.withColumns({c: written(c) for c in ("chosen_mask", "rejected_mask")})
