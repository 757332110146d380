from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from docflow.llm import chat, url_lists

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
TOOLS = {"add": {"properties": {"a": "integer", "b": "number", "note": "string"}, "required": ["a", "b"]}}


def test_calls(spark):
    calls = [
        (1, 1, "x", "add", '{"b": 1.5, "a": 2}', None),
        (1, 3, "y", "add", '{"a": "2", "c": null}', ["x", "nobody", "y"]),
        (1, 5, "z", "add", "not json", ["y"]),
        (1, 5, "z", "add", "{}", ["y"]),
        (2, 1, "p", "add", '{"a": 1, "b": 2}', ["q"]),
        (2, 2, "q", "add", '{"a": 1, "b": 2}', ["p"]),
        (2, 3, "r", "add", '{"a": 1, "b": 2}', ["q"]),
        (3, 9, "m", "sub", "[1]", []),
        (None, 1, "n", "add", "{}", None),
        (4, 1, "u", None, None, None),
        (5, 4, "v", "add", '{"a": 1, "b": 2}', None),
    ]
    results = [(1, 2, "x", '{"z": 1, "a": "ü\\n"}'), (1, 2, "x", "later"), (1, 4, "lost", 'quoted "text"'), (5, 3, "v", None)]
    extra = spark.createDataFrame(calls, CALLS).withColumn("level", F.lit(1)).withColumn("status", F.lit("x"))
    out = chat.link_tool_calls(extra, spark.createDataFrame(results, RESULTS), TOOLS).collect()
    got = {(r.conv_id, r.call_id): r for r in out}
    assert len(got) == len(out) == 10
    assert {k: r.status for k, r in got.items()} == {
        (1, "x"): "ok", (1, "y"): "invalid", (1, "z"): "invalid", (1, "lost"): "orphan_result", (2, "p"): "cycle",
        (2, "q"): "cycle", (2, "r"): "cycle", (3, "m"): "invalid", (4, "u"): "invalid", (5, "v"): "early_result",
    }
    assert [got[1, c].level for c in "xyz"] == [0, 1, 2] == [got[1, c].position for c in "xyz"]
    assert got[1, "y"].errors == "extra:c,missing:b,type:a" and got[1, "z"].errors == "bad_json" or got[1, "z"].copies == 2
    line = json.loads(got[1, "x"].json)
    assert line["arguments"] == {"a": 2, "b": 1.5} and line["id"] == "x"
    assert got[1, "x"].json.startswith('{"arguments":{"a":2,"b":1.5},"id":"x","name":"add","result":')
    assert json.loads(got[1, "lost"].json)["result"] == 'quoted "text"'


def test_long_conversation_has_dense_positions(spark):
    n = 6000
    calls = spark.range(n).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.concat(F.lit("c"), "id").alias("call_id"),
        F.lit("add").alias("name"), F.lit('{"a":1,"b":2}').alias("arguments"),
        F.when(F.col("id") > 0, F.array(F.concat(F.lit("c"), F.floor((F.col("id") - 1) / 7)))).alias("after"),
    )
    out = chat.link_tool_calls(calls, spark.createDataFrame([], RESULTS), TOOLS).collect()
    rows = sorted(out, key=lambda r: (r.level, r.turn))
    assert [r.position for r in rows] == list(range(n))
    place = {r.turn: r.position for r in rows}
    assert all(place[t] > place[(t - 1) // 7] for t in range(1, n))


def test_dated_lists(spark):
    day = lambda n: dt.date(2024, 1, n)
    events = [
        ("spam", "Bad.example", day(5), True, "a"), ("spam", "bad.example", day(10), False, None),
        ("spam", "bad.example", day(10), True, "b"), ("spam", "bad.example", day(20), False, "a"),
        ("ok", "good.bad.example", day(7), True, ""), (None, "x.example", day(1), True, "a"), ("spam", None, day(1), True, "a"),
        ("spam", "example", day(1), True, "tld"),
    ]
    listed = spark.createDataFrame(events, "list string, domain string, day date, listed boolean, category string")
    at = lambda n, h=12: dt.datetime(2024, 1, n, h)
    captures = [
        (1, "http://bad.example/a", at(4)), (2, "https://www.BAD.example:8080/?q=1", at(5, 0)), (3, "http://u:p@bad.example./", at(12)),
        (4, "http://bad.example", at(20)), (5, "http://a.good.bad.example/", at(8)), (6, "http://good.bad.example/", at(6)),
        (7, "http://notbad.example/", at(8)), (8, None, at(8)), (9, "no url", at(8)), (10, "http://bad.example/", None), (2, "http://bad.example/", at(6)),
    ]
    pages = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp").withColumn("list", F.lit(1)).withColumn("domain", F.lit(1))
    got = sorted((r.page_id, r.kept, r.lists, r.decided_by) for r in url_lists.judge_captures(pages, listed, ["spam"], ["ok"]).collect())
    assert [g[:3] for g in got] == [
        (1, True, ""), (2, False, "spam"), (2, False, "spam"), (3, False, "spam"), (4, True, ""), (5, True, "ok,spam"), (6, False, "spam"),
        (7, True, ""), (8, True, ""), (9, True, ""), (10, True, ""),
    ]
    spans = {(r.domain, r.valid_from, r.valid_to, r.category) for r in url_lists.validity(listed).collect()}
    assert ("bad.example", day(5), day(10), "a") in spans and ("bad.example", day(10), day(20), "b") in spans
    none = url_lists.judge_captures(pages, listed.limit(0), ["spam"], ["ok"]).collect()
    assert len(none) == 11 and all(r.kept for r in none)
    assert url_lists.judge_captures(pages.limit(0), listed, ["spam"], ["ok"]).count() == 0
