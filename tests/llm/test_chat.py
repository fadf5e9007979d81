import random

from pyspark.sql import functions as F

from tidemark.llm import chat


def brute(rows):
    pairs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            pairs.setdefault(conv // 2, ([], []))[conv % 2].append((-1 if turn is None else turn, role or "unknown", text or ""))
    out = {}
    for pair, sides in pairs.items():
        a, b = (sorted(set(s)) for s in sides)
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        out[pair] = ("".join(chat.render([t[1:]])[0] for t in a[:n]), chat.render([t[1:] for t in a[n:]])[0], chat.render([t[1:] for t in b[n:]])[0])
    return out


def test_pairs_match_a_plain_loop(spark):
    rng = random.Random(3)
    rows = []
    for pair in range(40):
        common = [(t, ("user", "assistant")[t % 2], f"t{t}") for t in range(rng.randrange(6))]
        for side in (0, 1):
            tail = [(len(common) + t, ("user", "assistant")[(len(common) + t) % 2], f"x{rng.randrange(2)}") for t in range(rng.randrange(4))]
            rows += [(2 * pair + side, *t) for t in common + tail]
    rows += rows[:7] + [(None, 0, "user", "lost"), (90, None, None, None), (92, 3, "user", "b"), (92, 3, "user", "a"), (93, 3, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.neighbours(turns).collect()
    assert {r.pair_id: (r.prompt, r.chosen, r.rejected) for r in got} == brute(rows)
    for r in got:
        for text, spans in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert all(text[s.end - len(chat.STOP) : s.end] == chat.STOP and text[: s.start].endswith("assistant\n") for s in spans)
    assert chat.neighbours(turns.limit(0)).count() == 0


def test_one_row_per_pair_unless_it_grows_without_bound(spark):
    rows = [(side, t, "assistant", f"{t}" if t < 700 else f"{t}-{side}") for side in (0, 1) for t in range(1000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one = chat.neighbours(turns).collect()
    assert len(one) == 1 and one[0].prompt == chat.render([("assistant", f"{t}") for t in range(700)])[0]
    pair, side = F.floor(F.col("conv_id") / 2), F.pmod(F.col("conv_id"), F.lit(2))
    got = chat.format_preferences(turns, pair, side, part=256).orderBy("part").collect()
    assert [r.part for r in got] == [0, 1, 2, 3] and sum(r.prompt_turns for r in got) == 700
    assert "".join(r.prompt for r in got) == one[0].prompt and "".join(r.chosen for r in got) == one[0].chosen
    assert one[0].chosen == chat.render([("assistant", f"{t}-0") for t in range(700, 1000)])[0]


def test_large_ids_null_and_far_turns_stay_in_one_row(spark):
    big = 2**53 + 2
    rows = [(big, 0, "user", "q"), (big + 1, 0, "user", "q"), (big + 3, 0, "user", "next"), (-1, 0, "user", "below"), (-2, 0, "user", "below")]
    rows += [(8, None, "system", "s"), (9, None, "system", "s"), (8, 0, "user", "a"), (9, 0, "user", "a"), (8, 10**12, "assistant", "x"), (9, 5000, "assistant", "y"), (8, -7, "user", "early")]
    got = {r.pair_id: r for r in chat.neighbours(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {big // 2, big // 2 + 1, -1, 4}
    assert got[big // 2].prompt_turns == 1 and (got[big // 2 + 1].chosen_turns, got[big // 2 + 1].rejected_turns) == (0, 1) and got[-1].prompt_turns == 1
    r = got[4]
    assert (r.part, r.part_of_turn, r.prompt, r.chosen_turns, r.rejected_turns) == (0, 0, "", 4, 3)
    assert r.chosen.index("early") < r.chosen.index("\ns<|") < r.chosen.index("\na<|") < r.chosen.index("\nx<|")
    same = [x for x in rows if x[1] != -7]
    r = chat.neighbours(spark.createDataFrame(same, "conv_id long, turn long, role string, text string")).where("pair_id = 4").collect()
    assert len(r) == 1 and (r[0].prompt_turns, r[0].chosen_turns, r[0].rejected_turns) == (2, 1, 1)


def test_marks_repeats_and_clashing_names(spark):
    rows = [(0, 0, "user", "a <|im_end|> b", 1, "x"), (1, 0, "user", "a <|im_end|> b", 2, "y"), (0, 1, "assistant", "c", 3, "z"), (0, 1, "assistant", "c", 3, "z")]
    got = chat.neighbours(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pair_id int, prompt string")).first()
    assert got.prompt == "<|im_start|>user\na <\\|im_end|> b<|im_end|>\n" and got.repeated_rows == 1 and (got.prompt_turns, got.chosen_turns, got.rejected_turns) == (1, 1, 0)
    assert got.rejected == "" and got.rejected_mask == []
