"""Rules of what counts as missing, of toggles in trees, of laid-out JSON and of ids."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from larkspur.functions import scalars
from larkspur.operators import blocks, conversations, documents, jobs, profiling
from larkspur.plans import spl


def fields(spark, *given):
    df = spark.createDataFrame([(1, json.dumps(list(given)))], "id int, blocks string")
    return {(int(r.pos), r.field): r.value for r in blocks.block_fields(df, "id", "blocks").collect()}


def test_only_empty_values_fall_back(spark):
    titles = ["0", "false", "", 0, 0.0, False, None, True, 2, "x"]
    got = fields(spark, *({"type": "collapsible", "data": {"title": t}} for t in titles), {"type": "code", "data": {"language": "false"}})
    assert [got[i, "title"] for i in range(len(titles))] == ["0", "false", "Section", "Section", "Section", "Section", "Section", "true", "2", "x"]
    assert got[len(titles), "language"] == "false"


def test_switches_are_turned_off_by_false_only(spark):
    got = fields(spark, *({"type": "table", "data": {"sortable": v}} for v in (False, "false", 0, None, True)), {"type": "table"})
    assert [got[i, "sortable"] for i in range(6)] == ["false", "true", "true", "true", "true", "true"]


def test_charts_over_time_can_be_switched(spark):
    cases = [{}, {"isTimeSeries": True}, {"allowChartTypeSwitch": True}, {"allowChartTypeSwitch": False, "isTimeSeries": True}, {"isTimeSeries": False}]
    got = fields(spark, *({"type": "splunk-chart", "data": c} for c in cases))
    assert [got[i, "allowChartTypeSwitch"] for i in range(5)] == ["false", "true", "true", "true", "false"]
    assert [got[i, "isTimeSeries"] for i in range(5)] == ["false", "true", "false", "true", "false"]


@pytest.mark.parametrize("kind, values, shown", [("int", [0, 7, None], ["n", "7", "n"]), ("double", [0.0, float("nan"), 1.5], ["n", "n", "1.5"]), ("boolean", [False, True, None], ["n", "true", "n"]), ("string", ["", "0", None], ["n", "0", "n"])])
def test_labels_skip_what_counts_as_missing(spark, kind, values, shown):
    df = spark.createDataFrame([(v, "n", 1.0, i) for i, v in enumerate(values)], f"time {kind}, name string, value double, i int")
    assert [r.label for r in documents.chart_series(df, "time", ["value", "i"]).orderBy("i").collect()] == shown
    assert sorted(r.label for r in blocks.pie_slices(df, "time").collect()) == sorted(shown)


def test_a_match_stops_the_descent(spark):
    tree = [("a", None, False), ("b", "a", False), ("a", "b", False), ("c", None, False), ("a", "c", False), ("a", "a", False)]
    df = spark.createDataFrame(tree, "id string, parent_id string, checked boolean")
    got = {(r.id, r.parent_id): r.checked for r in conversations.toggled(df, "a", True).collect()}
    assert got == {("a", None): True, ("b", "a"): False, ("a", "b"): False, ("c", None): False, ("a", "c"): True, ("a", "a"): False}


def test_laid_out_json(spark):
    texts = ['{"a":{"b":[1,2.0,"é\\n"],"c":{}},"d":[],"e":null,"f":1.5}', "[]", "7", "no json", None, '{"n":12345678901234567890}']
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(scalars.pretty_json("t")).collect()]
    assert got[0] == '{\n  "a": {\n    "b": [\n      1,\n      2,\n      "é\\n"\n    ],\n    "c": {}\n  },\n  "d": [],\n  "e": null,\n  "f": 1.5\n}'
    assert got[1:5] == ["[]", "7", None, None]


def test_ids_have_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(6)
    assert sorted((r.id, r.v) for r in jobs.with_ids(df, "v").collect()) == [(i + 1, i) for i in range(1000)]


def test_lookups_are_frames(spark):
    df = spark.range(5)
    assert conversations.get(df, "id", 3).count() == 1
    with pytest.raises(LookupError):
        conversations.get(df, "id", 9)


def test_time_charts_name_series_and_fill_spans(spark):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 03:00:00", "b", 5.0), ("2024-01-01 03:30:00", "OTHER", 2.0), ("2024-01-01 03:40:00", None, 4.0), ("2024-01-01 00:20:00", "a", 2.0)]
    df = spark.createDataFrame(rows, "ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp"))

    def chart(text):
        return spl.compiled(spl.parse(text), lambda _: df).orderBy("_time")

    counts = chart("index=x | timechart limit=1 count by kind")
    assert counts.columns == ["_time", "a", "OTHER"] and [tuple(r)[1:] for r in counts.collect()] == [(2, 0), (0, 0), (0, 0), (0, 3)]
    two = chart("index=x | timechart limit=2 sum(value), count by kind")
    assert [c for c in two.columns if c.endswith("sum_value") or c.startswith("sum_value")] == ["sum_value: b", "sum_value: NULL", "sum_value: OTHER"]
    assert [tuple(r)[1:] for r in two.collect()][0] == (None, 0, None, 0, 3.0, 2)
    assert chart("index=x | timechart limit=9 count by kind").columns == ["_time", "a", "NULL", "b", "OTHER"]
    assert spl.compiled(spl.parse("index=x | timechart count by kind"), lambda _: df.limit(0)).count() == 0
    with pytest.raises(spl.SplError):
        spl.parse("index=x | timechart count by a, b")


def test_profiles_tell_long_values_apart_and_count_the_rest(spark):
    rows = [("x" * 300 + "a", None, "1"), ("x" * 300 + "b", None, "2"), (None, None, "2"), ("", None, "x")]
    got = {r.field: r for r in profiling.full_profile(spark.createDataFrame(rows, "a string, b string, `c d` string")).collect()}
    assert (got["a"].nulls, got["a"].more, got["a"].samples.count("…")) == (1, 0, 2) and got["a"].samples.startswith(",x")
    assert (got["b"].n, got["b"].nulls, got["b"].samples, got["b"].type) == (4, 4, "", "string")
    assert (got["c d"].samples, got["c d"].more, got["c d"].type) == ("1,2,x", 0, "string")
