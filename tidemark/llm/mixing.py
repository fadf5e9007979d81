"""Mixing sources to target weights by Pfair scheduling (Baruah et al., 1996) of blocks of documents."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from itertools import islice
from math import lcm

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import gapless_rank, spread, spread_key

#: Columns that `scheduled` adds.
ADDED = ("mix_phase", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place")
#: Documents of a block.
BLOCK = 16
#: Slots that one task places; the driver keeps the state at the first of each.
STEP = 4096
#: Up to so many placed blocks are sent to all tasks; beyond, Spark joins them by shuffle.
BROADCAST_ROWS = 500_000


def units(weights: dict, period: int) -> dict:
    """Whole slots of a period for each source, at least one, by largest remainder; they sum to the period."""
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    by_need = sorted(out, key=lambda s: (out[s] - exact[s], str(s)))
    at = 0
    while (left := period - sum(out.values())) > 0:
        out[by_need[at % len(by_need)]] += 1
        at += 1
    while left < 0:
        most = max(out, key=lambda s: (out[s], str(s)))
        out[most] -= 1
        left += 1
    return out


def whole(weights: list) -> list[int]:
    """Whole numbers in exactly the proportion of weights."""
    exact = [Fraction(w) for w in weights]
    if any(w < 0 for w in exact):
        raise ValueError("a negative weight")
    scale = lcm(*(w.denominator for w in exact))
    return [int(w * scale) for w in exact]


@dataclass
class Mixer:
    """Places blocks of sources 0, 1, ..., a slot after another; copies of its state go on just the same.

    Block j of a source with share w is released at floor(j / w) and due at ceil((j + 1) / w), counted from the start of
    the phase, in whole numbers; each slot goes to the released block that is due first (ties: by number). So at any slot
    of a phase each source has had its exact share of the slots to within less than one block. A phase lasts until a
    source that is due has no block left; the others go on at their weights among themselves. So all blocks get a slot,
    and slots have no gaps. Sources of weight 0 come last. With a period, weights are rounded to whole slots of it.
    """

    blocks: list[int]
    weights: list
    period: int | None = None
    phase: int = 0
    #: Next slot, first slot of the phase, and blocks placed by now and before the phase.
    slot: int = 0
    first: int = 0
    done: list[int] = field(default_factory=list)
    before: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.done = list(self.done) or [0] * len(self.blocks)
        self.before = list(self.before) or list(self.done)

    def shares(self) -> dict[int, int]:
        """Whole weights of the sources that have blocks in this phase."""
        live = [s for s, n in enumerate(self.blocks) if self.before[s] < n]
        live = [s for s in live if self.weights[s] > 0] or live
        weights = {s: self.weights[s] or 1 for s in live}
        if self.period:
            return units(weights, max(self.period, 4 * len(live)))
        return dict(zip(live, whole(list(weights.values())), strict=True))

    def run(self) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(phase, source, block, release, deadline, slot) of all slots from here on."""
        left = sum(self.blocks) - sum(self.done)
        while left:
            parts = self.shares()
            total = sum(parts.values())
            waiting = [((self.done[s] - self.before[s]) * total // a, s) for s, a in parts.items()]
            heapq.heapify(waiting)
            due = []
            while True:
                while waiting and waiting[0][0] <= self.slot - self.first:
                    release, s = heapq.heappop(waiting)
                    heapq.heappush(due, (-(-(self.done[s] - self.before[s] + 1) * total // parts[s]), s, release))
                deadline, s, release = heapq.heappop(due)
                if self.slot - self.first >= deadline:
                    raise AssertionError("a deadline passed")
                if self.done[s] == self.blocks[s]:
                    break
                block, at = self.done[s], self.slot
                self.done[s], self.slot, left = block + 1, at + 1, left - 1
                heapq.heappush(waiting, ((block + 1 - self.before[s]) * total // parts[s], s))
                yield self.phase, s, block, self.first + release, self.first + deadline, at
                if not left:
                    return
            self.phase, self.first, self.before = self.phase + 1, self.slot, list(self.done)


def schedule(parts: dict, period: int) -> list[tuple[object, int, int, int]]:
    """The first `period` slots of sources of these weights: (source, its j-th block, release, deadline)."""
    names = sorted(parts, key=str)
    run = Mixer([period] * len(names), [parts[s] for s in names]).run()
    return [(names[s], j, release, deadline) for _, s, j, release, deadline, _ in islice(run, period)]


def starts(mixer: Mixer, step: int) -> Iterator[tuple[int, int, int, list[int], list[int]]]:
    """phase, slot, first, done and before of the mixer at every step-th slot."""
    run, left = mixer.run(), sum(mixer.blocks)
    while mixer.slot < left:
        yield mixer.phase, mixer.slot, mixer.first, list(mixer.done), list(mixer.before)
        next(islice(run, step - 1, step), None)


def placed_blocks(spark: SparkSession, blocks: list[int], weights: list, period: int | None = None, step: int = STEP) -> DataFrame:
    """mix_phase, __s (number of the source), mix_block, mix_release, mix_deadline, mix_slot of all blocks.

    The driver goes through the slots and keeps one state every `step` slots; tasks go through them again from there.
    """
    step = max(step, 4 * len(blocks))
    rows = list(starts(Mixer(blocks, weights, period), step))
    states = spark.createDataFrame(rows, "phase int, slot long, first long, done array<long>, before array<long>").repartition(max(1, len(rows)), "slot")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                run = Mixer(blocks, weights, period, int(r.phase), int(r.slot), int(r.first), [int(x) for x in r.done], [int(x) for x in r.before]).run()
                yield pd.DataFrame(list(islice(run, step)), columns=["mix_phase", "__s", "mix_block", "mix_release", "mix_deadline", "mix_slot"])

    return states.mapInPandas(place, "mix_phase int, __s int, mix_block long, mix_release long, mix_deadline long, mix_slot long")


def root_weights(counts: dict) -> dict:
    """Target weights in proportion to the square root of the rows: small sources get more than their share."""
    return {s: n**0.5 for s, n in counts.items()}


def scheduled(docs: DataFrame, weights: dict | Callable[[dict], dict] = root_weights, block: int = BLOCK, period: int | None = None) -> DataFrame:
    """docs with mix_phase, mix_block, mix_release, mix_deadline, mix_slot and mix_place (place in the block).

    docs has doc_id, source and text. Rows of a source are ranked by a hash of id and text and cut into blocks; all rows
    get a place. A null source is a source. weights: target weight by source (as 'source' or None), or a function of the
    rows by source; sources without a weight raise KeyError. They hold exactly, or with a period rounded to whole slots
    of it. Only one row per source comes to the driver; it goes through the slots once, one for each `block` documents.
    An empty table stays empty, texts of any length count as one row, rows that are repeated are rows, and columns of
    just these six names are replaced.
    """
    keyed = docs.withColumn("__source", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    counts = {r["__source"]: r["count"] for r in keyed.groupBy("__source").count().collect()}
    by_name = {s[1:] if s else None: n for s, n in counts.items()}
    target = weights(by_name) if callable(weights) else weights
    spark, names = docs.sparkSession, sorted(counts)
    blocks = [-(-counts[s] // block) for s in names]
    placed = placed_blocks(spark, blocks, [target[s[1:] if s else None] for s in names], period)
    numbers = spark.createDataFrame(list(enumerate(names)), "__s int, __name string")
    if sum(blocks) <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    keyed = keyed.withColumn("__range", spread(F.col("doc_id"), crc))
    ranked = gapless_rank(keyed, "__source", "__range", [spread_key(F.col("doc_id"), crc), F.col("doc_id"), crc], "__at")
    kept = [f"`{c}`" for c in docs.columns if c not in ADDED]
    ranked = ranked.join(F.broadcast(numbers), F.col("__source") == F.col("__name"))
    ranked = ranked.select(*kept, "__s", F.floor(F.col("__at") / block).alias("mix_block"), (F.col("__at") % block).cast("int").alias("mix_place"))
    placed = placed.withColumnsRenamed({"__s": "__ps", "mix_block": "__pb"})
    joined = ranked.join(placed, (F.col("__s") == F.col("__ps")) & (F.col("mix_block") == F.col("__pb")))
    return joined.select(*kept, "mix_phase", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """All rows of docs with their own columns, sorted into the mixing order, so that files and tasks read them mixed."""
    held = docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("__row"))
    out = scheduled(held, **how).orderBy("mix_slot", "mix_place")
    return out.select(*(F.col("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
