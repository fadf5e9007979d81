import zlib
from collections import Counter
from fractions import Fraction
from itertools import islice

import pytest

from tidemark.llm import mixing


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1}, {"a": 0.61, "b": 0.29, "c": 0.1}, {str(i): i + 1 for i in range(17)}])
def test_each_source_stays_within_one_block(weights):
    parts = mixing.units(weights, 200)
    assert sum(parts.values()) == 200
    had = Counter()
    for t, (source, j, release, deadline) in enumerate(mixing.schedule(parts, 200), 1):
        assert release <= t - 1 < deadline and had[source] == j
        had[source] += 1
        assert all(abs(had[s] - t * n / 200) < 1 for s, n in parts.items())


def test_all_rows_get_a_place(spark):
    rows = [(i, f"text {i}", "hot" if i % 3 == 0 else None if i % 7 == 0 else f"s{i % 5}", i) for i in range(3000)] + [(5, "text 5", "s0", 5)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_slot int")
    got = mixing.scheduled(docs, block=4, period=50).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        assert r.mix_release <= r.mix_slot < r.mix_deadline
        slots.setdefault(r.mix_slot, set()).add((r.source, r.mix_block))
    assert sorted(slots) == list(range(len(slots))) and all(len(x) == 1 for x in slots.values())
    assert len({(r.mix_slot, r.mix_place) for r in got}) == len(rows)
    first = [s for t in range(40) for s, _ in slots[t]]
    counts = Counter(r[2] for r in rows)
    parts = mixing.units(mixing.root_weights({s: n for s, n in counts.items()}), 50)
    for t in range(1, 41):
        assert all(abs(first[:t].count(s) - t * n / 50) < 1 for s, n in parts.items())


def test_mixed_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x", "keep"), (None, None, None, "null"), (2, "b", "y", "keep"), (2, "b", "y", "keep")], "doc_id long, text string, source string, __s string")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_exact_weights_hold_over_hundreds_of_periods():
    counts = {"hot": 10_000_000, **{f"s{i}": 1_000_000 for i in range(19)}}
    names = sorted(counts)
    weights = [mixing.root_weights(counts)[s] for s in names]
    exact, had, seen = [Fraction(w) / sum(map(Fraction, weights)) for w in weights], [0] * 20, []
    mixer = mixing.Mixer([10**6] * 20, weights)
    for t, row in enumerate(islice(mixer.run(), 300_000), 1):
        had[row[1]] += 1
        if t % 997 == 0 or t > 299_000:
            assert all(abs(n - t * w) < 1 for n, w in zip(had, exact, strict=True))
        seen.append(row)
    state = next(islice(mixing.starts(mixing.Mixer([10**6] * 20, weights), 100_000), 2, 3))
    assert list(islice(mixing.Mixer([10**6] * 20, weights, None, *state).run(), 1000)) == seen[200_000:201_000]


def test_steps_give_the_same_slots_as_one_run(spark):
    blocks, weights = [700, 40, 0, 333, 5], [0.61, 0.29, 1.0, 0.1, 0]
    want = list(mixing.Mixer(blocks, weights).run())
    got = mixing.placed_blocks(spark, blocks, weights, step=50).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == sum(blocks)
    assert [r[5] for r in want] == list(range(len(want))) and [r[1] for r in want[-5:]] == [4] * 5


def edf(blocks, weights):
    """(phase, source, block, slot) by looking at every source at every slot."""
    done, before, first, slot, phase, out = [0] * len(blocks), [0] * len(blocks), 0, 0, 0, []
    while slot < sum(blocks):
        live = [s for s in range(len(blocks)) if before[s] < blocks[s]]
        total = sum(Fraction(weights[s]) for s in live)
        window = lambda s: (int((done[s] - before[s]) / (Fraction(weights[s]) / total)), -int(-(done[s] - before[s] + 1) / (Fraction(weights[s]) / total) // 1))  # noqa: B023, E731
        deadline, s = min((window(s)[1], s) for s in live if window(s)[0] <= slot - first)
        if done[s] == blocks[s]:
            phase, first, before = phase + 1, slot, list(done)
            continue
        out.append((phase, s, done[s], slot))
        done[s], slot = done[s] + 1, slot + 1
    return out


def test_rows_stand_where_a_plain_schedule_puts_them(spark):
    rows = [(i, f"text {i * i % 91}", f"s{min(i % 7, 3)}", f"note {i}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_note string")
    key = lambda r: ((r[0] * 48271 + zlib.crc32(r[1].encode()) % 2147483647 * 69621) % 2147483647, r[0], zlib.crc32(r[1].encode()))
    names = sorted({r[2] for r in rows})
    ranked = {s: sorted((r for r in rows if r[2] == s), key=key) for s in names}
    slots = {(names[s], j): (phase, slot) for phase, s, j, slot in edf([-(-len(ranked[s]) // 16) for s in names], [len(ranked[s]) ** 0.5 for s in names])}
    want = {r[0]: (*slots[s, k // 16], k // 16, k % 16) for s in names for k, r in enumerate(ranked[s])}
    got = mixing.scheduled(docs).collect()
    assert {r.doc_id: (r.mix_phase, r.mix_slot, r.mix_block, r.mix_place) for r in got} == want
    assert {r.mix_note for r in got} == {r[3] for r in rows}
