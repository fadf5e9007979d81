import json

from pyspark.sql import functions as F

from tidemark.sources import feeds, news


def at(text):
    return F.lit(text).cast("timestamp")


def collected(spark, source, body, symbol="aa", **how):
    payloads = spark.createDataFrame([(source, symbol, body if isinstance(body, str) else json.dumps(body)), (source, symbol, "no json at all"), (source, symbol, None)], "source string, symbol string, body string")
    return news.collect(payloads, at("2024-01-05"), at("2024-01-06"), at("2024-01-05 09:00:00"), [source], **how).orderBy("title").collect()


def test_massive_falls_back_and_keeps_the_window(spark):
    items = [{"title": "a", "published_utc": "2024-01-05T10:00:00Z", "amp_url": "amp"}, {"title": "", "published_utc": "2024-01-05T10:00:00Z"}, {"title": "old", "published_utc": "2024-01-04T10:00:00Z"}, {"title": "undated", "published_utc": "soon", "publisher": {"name": "P"}}]
    got = collected(spark, "massive", {"results": items})
    assert [(r.title, r.ticker, r.url, r.source, str(r.published_at)) for r in got] == [("a", "AA", "amp", "Massive", "2024-01-05 10:00:00"), ("undated", "AA", None, "P", "2024-01-05 09:00:00")]


def test_marketaux_takes_the_first_entity(spark):
    items = [{"title": "a", "published_at": "2024-01-05T10:00:00.000000Z", "entities": [{"symbol": None}, {"symbol": "zz"}], "snippet": "s"}, {"title": "b", "published_at": "2024-01-05T10:00:00Z", "entities": []}]
    assert [(r.ticker, r.summary) for r in collected(spark, "marketaux", {"data": items})] == [("ZZ", "s"), ("AA", None)]


def test_model_answers(spark):
    fenced = 'Of course:\n```json\n[{"title": " a ", "published_at": "2024-01-05", "url": ""}]\n```'
    (r,) = collected(spark, "openai", fenced)
    assert (r.title, r.url, r.source, str(r.published_at)) == ("a", None, "OpenAI Generated", "2024-01-05 12:00:00")
    got = collected(spark, "gemini", {"topics": [{"topic": "t", "published_at": "2024-01-05 – 2024-02-01", "sources": ["u1", "u2"]}, {"title": "late", "published_at": "2024-02-01"}]})
    assert [(r.title, r.url, str(r.published_at)) for r in got] == [("t", "u1", "2024-01-05 12:00:00")]


def test_hot_lists_keep_ranks_and_finance(spark):
    got = collected(spark, "newsnow", {"items": [{"title": "cats"}, {"title": "Bank rates", "mobileUrl": "m", "url": "u"}, {"title": None}, {"title": "股票"}]}, symbol="weibo")
    assert [(r.ticker, r.title, r.url, r.source) for r in got] == [("MACRO", "Bank rates", "m", "weibo"), ("MACRO", "股票", None, "weibo")]


def test_symbols_in_either_case(spark):
    assert collected(spark, "massive", {"results": [{"title": "a", "published_utc": "2024-01-05T10:00:00Z"}]}, symbols=[" Aa "]) and not collected(spark, "massive", {"results": []}, symbols=["bb"])


def test_state_of_sources(spark):
    calls = spark.createDataFrame([("a", 1, None), ("a", 2, "bad key"), ("a", 3, None), ("b", 1, None)], "source string, at int, error string")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "source_id string")
    assert sorted(map(tuple, news.metadata(known, calls).collect())) == [("a", False, "bad key"), ("b", True, None), ("c", True, None)]


def test_recent_filers(spark):
    line = lambda form, cik, day: f"{form:<12}{'A CO':<62}{cik:<12}{day:<12}edgar/x.txt"
    lines = spark.createDataFrame([(line("10-K", 7, "2024-01-02"),), (line("10-K", 7, "2024-01-03"),), (line("8-K", 8, "2024-01-02"),), (line("10-K", 9, "2023-01-02"),), ("Form Type   Company Name",)], "value string")
    known = spark.createDataFrame([(7, "SE"), (8, "EI"), (9, "NI")], "cik long, ticker string")
    day = lambda x: F.lit(x).cast("date")
    assert [r.ticker for r in feeds.recent_filers(lines, known, day("2024-01-01"), day("2024-01-31"), ["10-K"]).collect()] == ["SE"]
