import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringStartsWith

from tidemark.sources import news, recorded

DAYS = [date(2024, 1, d) for d in range(1, 11)]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    body = lambda s, d: json.dumps({"results": [{"id": f"{s}{d}", "title": f"t {s}", "published_utc": f"{d}T10:00:00Z"}, {"id": "x", "title": "outside", "published_utc": "2020-01-01T00:00:00Z"}]})
    rows = [(source, symbol, d, body(symbol, d)) for source in ("massive", "other") for symbol in ("aa", "bb", "c/c:1") for d in DAYS] + [("massive", None, None, "{}")]
    path = (tmp_path_factory.mktemp("archive") / "payloads").as_uri()
    recorded.record(spark.createDataFrame(rows, "source string, symbol string, day date, body string"), path)
    return path


def test_filters_choose_the_partitions(archive):
    reader = lambda: recorded.RecordedReader(archive, 1)
    assert len(reader().partitions()) == 2 * 3 * 10 + 1
    r = reader()
    left = list(r.pushFilters([EqualTo(("source",), "massive"), In(("symbol",), ("AA", "C/C:1")), GreaterThanOrEqual(("day",), DAYS[3]), LessThan(("day",), DAYS[6]), StringStartsWith(("body",), "{")]))
    assert [type(f) for f in left] == [StringStartsWith]
    assert [(p.source, p.symbol, p.files[0][0]) for p in r.partitions()] == [("massive", s, d) for s in ("AA", "C/C:1") for d in DAYS[3:6]]
    wide = recorded.RecordedReader(archive, 4)
    list(wide.pushFilters([EqualTo(("source",), "other"), EqualTo(("symbol",), "BB")]))
    assert [len(p.files) for p in wide.partitions()] == [4, 4, 2]


def test_a_window_opens_only_its_partitions(spark, archive):
    rows = recorded.asked(recorded.read(spark, archive), datetime(2024, 1, 4), datetime(2024, 1, 5, 12), ["massive"], [" aa ", "BB"])
    assert rows.rdd.getNumPartitions() == 4  # two symbols, two days
    assert sorted({(r.symbol, r.day) for r in rows.collect()}) == [(s, d) for s in ("AA", "BB") for d in DAYS[3:5]]
    assert recorded.read(spark, archive).count() == 61
    assert recorded.asked(recorded.read(spark, archive), datetime(2030, 1, 4), datetime(2030, 1, 5), ["massive"]).count() == 0


def test_news_are_those_of_all_payloads(spark, archive):
    since, until, now = datetime(2024, 1, 3), datetime(2024, 1, 5, 9), F.lit(datetime(2024, 2, 1))
    got = recorded.collect(spark, archive, since, until, now, ["massive"])
    want = news.collect(recorded.read(spark, archive), F.lit(since), F.lit(until), now, ["massive"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 3 * 2
