import pytest
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.storage import Spec


def rows(spark, data):
    return spark.createDataFrame(data, "k string, n int, note string")


def found(spark, path, number=None):
    return sorted(map(tuple, storage.load(spark, path, number).select("k", "n", "note").collect()))


def files(spark, path):
    return {r.path for r in storage.load(spark, path).select(F.input_file_name().alias("path")).distinct().collect()}


def many(n, note="old", first=0):
    return [(f"k{i}", first, note) for i in range(n)]


def test_new_rows_only_and_again_the_same(spark):
    path, spec = storage.scratch(spark, "t"), Spec(("k",), "n", replace=False, part_rows=1)
    storage.save(rows(spark, [("a", 2, "x"), ("a", 1, "y"), (None, 0, "lost")]), path, spec)
    for _ in range(2):
        storage.save(rows(spark, [("a", 9, "late"), ("b", 1, "z"), ("b", 0, "first")]), path, spec)
    assert found(spark, path) == [("a", 1, "y"), ("b", 0, "first")]


def test_later_rows_replace_and_other_parts_stay(spark):
    path, spec = storage.scratch(spark, "t"), Spec(("k",), "n", part_rows=6)
    storage.save(rows(spark, many(20)), path, spec)
    before = files(spark, path)
    storage.save(rows(spark, [("k3", 1, "new"), ("k3", 2, "newer")]), path, spec)
    assert ("k3", 2, "newer") in found(spark, path) and len(found(spark, path)) == 20
    assert len(before) > 2 and len(before & files(spark, path)) == len(before) - 1  # only the part of k3 was written again
    assert found(spark, path, 1) == sorted(many(20))  # the version before stays readable


def test_parts_split_as_the_table_grows(spark):
    path, spec = storage.scratch(spark, "t"), Spec(("k",), "n", part_rows=16)
    storage.save(rows(spark, many(10)), path, spec)
    assert [p.bits for p in storage.version(spark, path).parts] == [0]
    storage.save(rows(spark, [(f"x{i}", 0, "") for i in range(300)]), path, spec)
    big = storage.version(spark, path)
    assert big.bits == 5 and all(p.bits == 5 for p in big.parts) and max(p.rows for p in big.parts) < 48
    before = files(spark, path)
    storage.save(rows(spark, [("y", 0, "")]), path, Spec(("k",), "n", part_rows=8))  # more parts: only that of y is split
    grown = storage.version(spark, path)
    assert grown.bits == 6 and {p.bits for p in grown.parts} == {5, 6} and sum(p.rows for p in grown.parts) == 311
    assert len(before & files(spark, path)) == len(before) - 1
    storage.save(rows(spark, [("k1", 5, "late"), *many(10, "again", 1)]), path, spec)
    assert len(found(spark, path)) == 311 and ("k1", 5, "late") in found(spark, path) and ("k2", 1, "again") in found(spark, path)


@pytest.mark.parametrize("step", ["save", "delete"])
def test_what_dies_before_its_rename_leaves_the_table(spark, monkeypatch, step):
    path, spec = storage.scratch(spark, "t"), Spec(("k",), "n", part_rows=6)
    storage.save(rows(spark, many(20)), path, spec)
    gone = spark.createDataFrame([("k1",), ("k2",)], "k string")
    run = {"save": lambda: storage.save(rows(spark, many(5, "new", 1)), path, spec), "delete": lambda: storage.delete(spark, path, gone, ["k"])}[step]

    def die(*_):
        raise OSError("the driver is lost")

    with monkeypatch.context() as m:
        m.setattr(storage, "commit", die)
        with pytest.raises(OSError, match="lost"):
            run()
    assert found(spark, path) == sorted(many(20)) and storage.versions(spark, path) == [1]
    run()
    assert len(found(spark, path)) == (20 if step == "save" else 18)
    storage.vacuum(spark, path)  # what the lost write left goes, too
    assert storage.versions(spark, path) == [2] and len(found(spark, path)) == (20 if step == "save" else 18)


def test_a_write_that_comes_second_is_done_on_the_first(spark, monkeypatch):
    path, spec = storage.scratch(spark, "t"), Spec(("k",), "n")
    storage.save(rows(spark, many(3)), path, spec)
    commit, raced = storage.commit, []

    def late(*a):
        if not raced:
            raced.append(1)
            storage.save(rows(spark, [("other", 0, "first")]), path, spec)
        commit(*a)

    monkeypatch.setattr(storage, "commit", late)
    storage.save(rows(spark, [("mine", 0, "second")]), path, spec)
    assert {k for k, *_ in found(spark, path)} == {"k0", "k1", "k2", "other", "mine"} and storage.versions(spark, path) == [1, 2, 3]
    with pytest.raises(storage.Conflict):
        commit(spark, path, storage.Version(3))


def test_columns_that_come_later(spark):
    path, spec = storage.scratch(spark, "t"), Spec(("k",), "n")
    storage.save(rows(spark, many(2)), path, spec)
    storage.save(spark.createDataFrame([("k1", 1, 2.5)], "k string, n int, price double"), path, spec)
    got = {r.k: (r.n, r.note, r.price) for r in storage.load(spark, path).collect()}
    assert got == {"k0": (0, "old", None), "k1": (1, None, 2.5)}


def test_delete_and_truncate(spark):
    path, spec = storage.scratch(spark, "t"), Spec(("k",), "n", part_rows=5)
    storage.save(rows(spark, many(20)), path, spec)
    gone = spark.createDataFrame([(f"k{i}",) for i in range(0, 20, 2)] + [("none",)], "k string")
    storage.delete(spark, path, gone, ["k"])
    assert [k for k, *_ in found(spark, path)] == sorted(f"k{i}" for i in range(1, 20, 2))
    storage.delete(spark, path, spark.createDataFrame([("old",)], "note string"), ["note"])  # by another column than the key
    assert found(spark, path) == []
    storage.save(rows(spark, many(3)), path, spec)
    storage.truncate(spark, path)
    assert found(spark, path) == []
    storage.save(rows(spark, [("a", 1, "x")]), path, spec)
    assert found(spark, path) == [("a", 1, "x")]
    with pytest.raises(FileNotFoundError):
        storage.load(spark, storage.scratch(spark, "none"))


@pytest.mark.parametrize("name", sorted(storage.TABLES))
def test_every_table_has_a_key_and_an_order(name):
    spec = storage.TABLES[name]
    assert spec.keys and spec.order and spec.part_rows > 0


def test_large_parts_are_written_by_several_tasks_from_one_run_of_the_rows(spark):
    """A part was one task's work, and the rows were made three times."""
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            ran.add(len(b))
            yield b

    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        path = storage.scratch(spark, "t")
        made = spark.range(0, 20000, 1, 8).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(0).alias("n"), F.sha2(F.col("id").cast("string"), 512).alias("note"))
        storage.save(made.mapInPandas(count, made.schema), path, Spec(("k",), "n"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert ran.value == 20000 and storage.load(spark, path).select("k").distinct().count() == 20000
    assert len(storage.version(spark, path).parts) == 1 and len(files(spark, path)) > 1


def test_distinct_rows_are_not_sorted_and_none_leave_the_table(spark):
    path = storage.scratch(spark, "distinct")
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    first, spec = frame([(1, "a"), (2, "b"), (None, "c")]), storage.Spec(("k",), "v")
    assert storage.save(first, path, spec, distinct=True) == 2
    assert storage.save(frame([]), path, spec, distinct=True) == 0 and storage.versions(spark, path) == [1]
    assert storage.save(frame([(2, "z"), (3, "y")]), path, spec, distinct=True) == 2
    assert sorted(tuple(r) for r in storage.load(spark, path).collect()) == [(1, "a"), (2, "z"), (3, "y")]
