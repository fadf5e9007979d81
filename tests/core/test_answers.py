import json
import random

import pytest

from tidemark import answers, storage


@pytest.fixture
def counted(tmp_path):
    """A provider for batches that writes down each call."""

    def make(fail=()):
        def ask(common, items):
            (tmp_path / f"{len(list(tmp_path.iterdir()))}-{abs(hash((common, *items)))}").write_text(json.dumps([common, items]))
            if any(f in x for x in items for f in fail):
                raise TimeoutError("no answer")
            return [json.dumps("good" in x) for x in items]

        return ask

    return make, lambda: [json.loads(f.read_text()) for f in tmp_path.iterdir()]


def news(spark, rows):
    return spark.createDataFrame(rows, "id long, ticker string, title string, summary string")


def test_each_prompt_is_asked_once(spark, counted):
    make, calls = counted
    rows = news(spark, [(i, "A" if i % 2 else "b ", f"{'good' if i % 3 == 0 else 'bad'} {i % 40}", None) for i in range(90)])
    path = storage.scratch(spark, "answers")
    got = {r.id: r.relevant for r in answers.relevant(rows, make(), path, ["none"]).collect()}
    assert got == {i: i % 3 == 0 for i in range(90)}
    asked = [(c, x) for c, items in calls() for x in items]
    assert len(asked) == len(set(asked)) == len({(r.ticker, r.title) for r in rows.collect()}) and {c for c, _ in asked} == {"A", "B"}
    assert max(len(items) for _, items in calls()) <= answers.BATCH
    before = len(calls())
    more = rows.unionByName(news(spark, [(100, "A", "good new", "s"), (101, "A", "good new", "s")]))
    assert {r.id: r.relevant for r in answers.relevant(more, make(), path, ["none"]).collect()} == got | {100: True, 101: True}
    assert len(calls()) == before + 1 and answers.relevant(more, make(), path, ["none"]).count() == 92 and len(calls()) == before + 1


def test_failed_batches_fall_back_and_are_asked_again(spark, counted):
    make, calls = counted
    rows = news(spark, [(1, "A", "good", "x"), (2, "A", "broken", "fed"), (3, "A", "bad", "x")])
    path = storage.scratch(spark, "answers")
    one = lambda fail: {r.id: r.relevant for r in answers.relevant(rows, make(fail), path, ["fed"], least=0.5, batch=1).collect()}
    assert one(["broken"]) == {1: True, 2: True, 3: False}  # the keyword rule stands in for 2
    n = len(calls())
    assert one([]) == {1: True, 2: False, 3: False} and len(calls()) == n + 1


def test_answers_of_a_numbered_batch():
    seen = []

    def model(text):
        seen.append(text)
        return "Sure:\n```json\n[true, null, false]\n```"

    assert answers.numbered(model, "News of {}:")("A", ["x", "y", "z"]) == ["true", None, "false"]
    assert seen[0].startswith("News of A:\n1. x\n2. y\n3. z")
    with pytest.raises(ValueError, match="as many"):
        answers.numbered(model, "")("A", ["x"])


def test_filter_keeps_the_first_of_a_title_that_is_new(spark, counted):
    make, _ = counted
    rows = news(spark, [(1, "A", "good One", None), (2, "A", " GOOD one", None), (3, "B", "good one", None), (4, "A", "bad", None), (5, "A", "good two", None), (6, "A", None, "good")])
    existing = news(spark, [(9, "A", "Good Two", None)])
    assert {r.id for r in answers.filtered(rows, make(), storage.scratch(spark, "a"), ["none"], existing=existing).collect()} == {1, 3, 6}
    got = {r.id for r in answers.filtered(rows, make(), storage.scratch(spark, "a"), ["none"], least=0.5, existing=existing).collect()}
    assert {1, 3} <= got and not got & {4, 5}


def test_stories_gate_format_and_groups(spark):
    a = spark.createDataFrame([(1, "A", "2024-01-05", [(1, "first", "s"), (2, "second", None)]), (2, "B", "2024-01-05", [(3, "skip", None)]), (3, "C", "2024-01-05", [(4, "fails", None)])], "cluster int, ticker string, day string, articles array<struct<id:long,title:string,summary:string>>")

    def teller(prompt):
        if "fails" in prompt:
            raise TimeoutError
        return json.dumps({"title": prompt.split("\n")[1], "summary": str(prompt.count("\n- ") ), "omit_story": "skip" in prompt})

    assert [(r.cluster, r.title, r.summary) for r in answers.stories(a, teller, storage.scratch(spark, "a")).collect()] == [(1, "- first: s", "2")]
    rows = spark.createDataFrame([(1, "yes", None, ["t"]), (2, "no", "s", None), (3, "err", None, None)], "id int, title string, summary string, topics array<string>")

    def gate(prompt):
        return {"y": " TRUE ", "n": "false"}[prompt[0]]

    assert {r.id: r.worth for r in answers.worth_long_story(rows, gate, storage.scratch(spark, "a")).collect()} == {1: True, 2: False, 3: False}
    assert {r.id: r.formatted for r in answers.formatted(rows, lambda t: t.upper() if t != "no" else "", storage.scratch(spark, "a"), "title").collect()} == {1: "YES", 2: "no", 3: "ERR"}
    titles = spark.createDataFrame([("A", 5, "x"), ("A", 3, "X"), ("A", 4, "y"), ("B", 9, "x")], "ticker string, id long, title string")
    model = lambda p: "[[5, 3, 99], [4]]" if "Repeats of A" in p else "nothing"
    assert [(r.id, r.kept) for r in answers.proposed_groups(titles, model, storage.scratch(spark, "a")).collect()] == [(5, 3)]


def test_filters_by_kind(spark, counted):
    make, calls = counted
    rows = news(spark, [(1, "A", "good", "x"), (2, "A", "bad", "fed rate"), (3, "A", "GOOD ", "y"), (4, "A", "good fed", "z")])
    ids = lambda f: sorted(r.id for r in f(rows).collect())
    assert ids(answers.filter_of("keyword", ["fed", "rate"], least=0.5)) == [2, 4] == ids(answers.filter_of("model", ["fed", "rate"], least=0.5))
    assert ids(answers.filter_of("model", ["fed"], make())) == [1, 4] and calls()
    with pytest.raises(ValueError, match="kind"):
        answers.filter_of("other", [])


def test_groups_of_a_model_are_looked_up_by_joins(spark):
    """Every group went through all that its prompt had shown."""
    rng = random.Random(5)
    rows = [(rng.choice(["A", "B", None]), i, f"t{rng.randrange(40)}") for i in range(200)]
    groups = {}
    for t, i, title in rows:
        groups.setdefault((t, title), []).append(i)

    def model(prompt):
        told = {}
        for line in prompt.split("\n")[1:]:
            number, _, title = line.partition("\t")
            told.setdefault(title, []).append(int(number))
        return json.dumps([[*g, 1000, g[0]] for g in told.values()])

    df = spark.createDataFrame(rows, "ticker string, id long, title string").where("ticker IS NOT NULL OR id % 2 = 0")
    got = answers.proposed_groups(df, model, storage.scratch(spark, "a"), part=1000)
    assert "array_intersect" not in got._jdf.queryExecution().toString()
    held = {k: [i for i in g if k[0] or i % 2 == 0] for k, g in groups.items()}
    assert {(r.id, r.kept) for r in got.collect()} == {(i, min(g)) for k, g in held.items() if k[0] for i in g if i != min(g)}


def test_prompts_are_strings_only_for_their_call():
    """A call for each ten rows went on as a frame of its own, and a common group was cut where a record batch ended."""
    import pyarrow as pa

    calls = []

    def provider(common, prompts):
        calls.append((common, list(prompts)))
        if "p7" in prompts:
            raise TimeoutError
        return [None if p == "p3" else p.upper() for p in prompts]

    rows = [(f"k{i}", "A" if i < 25 else "B", f"p{i}") for i in range(60)]
    made = [pa.RecordBatch.from_pylist([dict(zip(("prompt_key", "shared", "prompt"), r, strict=True)) for r in rows[at:end]]) for at, end in ((0, 17), (17, 60))]
    out = list(answers.asked_of(provider, made, 10))
    assert [(c, len(p)) for c, p in calls] == [("A", 10), ("A", 10), ("A", 5), ("B", 10), ("B", 10), ("B", 10), ("B", 5)] and [x for _, p in calls for x in p] == [p for _, _, p in rows]
    assert len(out) == 3 and {(r["prompt_key"], r["answer"]) for b in out for r in b.to_pylist()} == {(k, p.upper()) for k, _, p in rows[10:]}
