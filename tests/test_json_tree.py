"""JSON trees as rows: kinds, child counts, all levels and the limit of depth."""

from __future__ import annotations

import json

import duckdb
from pyspark.sql import functions as F

from larkspur.catalog import ORACLE_SQL, QUERIES
from larkspur.operators import documents

# (path, depth, kind, children) of an event with two tags
NODES = [
    ("$", 0, "object", 3), ("$.user", 1, "object", 5), ("$.metadata", 1, "object", 3), ("$.props", 1, "object", 1), ("$.user.id", 2, "number", 0), ("$.user.name", 2, "string", 0), ("$.user.email", 2, "string", 0),
    ("$.user.preferences", 2, "object", 2), ("$.user.tags", 2, "array", 2), ("$.metadata.created", 2, "string", 0), ("$.metadata.updated", 2, "null", 0),
    ("$.metadata.history", 2, "array", 1), ("$.props.k", 2, "number", 0), ("$.user.preferences.theme", 3, "string", 0), ("$.user.preferences.notifications", 3, "boolean", 0),
    ("$.user.tags.0", 3, "string", 0), ("$.user.tags.1", 3, "string", 0), ("$.metadata.history.0", 3, "object", 2),
    ("$.metadata.history.0.value", 4, "number", 0), ("$.metadata.history.0.props", 4, "object", 1), ("$.metadata.history.0.props.k", 5, "number", 0),
]


def test_the_query_shows_every_node_of_every_event(spark, sf_dir):
    events = [r.event_id for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").collect()]
    want = []
    for e in events:
        tags = e % 3
        want += [(e, *n[:3], tags if n[0] == "$.user.tags" else n[3]) for n in NODES if not n[0].startswith("$.user.tags.") or int(n[0][-1]) < tags]
    got = QUERIES["json_tree_counts"](spark, sf_dir).select("event_id", "path", "depth", "kind", "children")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_odd_events(spark, tmp_path):
    """Null columns are null nodes, props of any shape are walked, and texts that are no JSON are null."""
    props = [None, "{x", "[]", "{}", "[[1, [2]], null]", '"k"', "1.5", '{"a b": {"c": {"d": 1}}}']
    rows = [(i, None, p) for i, p in enumerate(props)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, props string").selectExpr("event_id", "user_id", "CAST(NULL AS STRING) AS event_type", "CAST(NULL AS DOUBLE) AS value", "CAST(NULL AS TIMESTAMP) AS ts", "props")
    df.write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.event_id, r.path): (r.depth, r.kind, r.children) for r in QUERIES["json_tree_counts"](spark, str(tmp_path)).collect()}
    assert [got[i, "$.props"] for i in range(8)] == [(1, "null", 0), (1, "null", 0), (1, "array", 0), (1, "object", 0), (1, "array", 2), (1, "string", 0), (1, "number", 0), (1, "object", 1)]
    assert got[4, "$.props.0"] == (2, "array", 2) and got[4, "$.props.0.1"] == (3, "array", 1) and got[4, "$.props.1"] == (2, "null", 0)
    assert got[7, "$.props.a b.c"] == (3, "object", 1) and got[7, "$.props.a b.c.d"] == (4, "number", 0) and got[4, "$.props.0.1.0"] == (4, "number", 0)
    assert {got[i, "$.user.id"] for i in range(8)} == {(2, "null", 0)} == {got[i, "$.metadata.created"] for i in range(8)}
    assert got[2, "$.user.tags"] == (2, "array", 2) and got[2, "$.user.tags.1"] == (3, "null", 0)


def test_trees_without_keys(spark):
    df = spark.createDataFrame([('{"a": [1, {"b": {"c": 1}}]}',)], "doc string")
    assert sorted(map(tuple, documents.json_tree(df, "doc", 2).collect())) == [("$", 0, "object", 1), ("$.a", 1, "array", 2), ("$.a.0", 2, "number", 0), ("$.a.1", 2, "object", 1)]


def walked(key, value, path="$", depth=0):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
    entries = list(value.items()) if kind == "object" else list(enumerate(value)) if kind == "array" else []
    yield key, path, depth, kind, len(entries)
    for name, entry in entries:
        yield from walked(key, entry, f"{path}.{name}", depth + 1)


def nested(levels):
    """Lists and objects in turn, each beside leaves whose texts hold brackets, quotes and backslashes."""
    value = 'end "]}'
    for i in range(levels):
        value = [i, value, "[[{", {}] if i % 2 else {"in": value, "{[": "\\", 'q"': '\\"{[{["', "line\n[": []}
    return value


def test_every_level_is_walked(spark):
    docs = [nested(n) for n in (0, 1, 2, 3, 4, 5, 9, 20)] + [None, 1.5, [], {}, [[], {}], "[[[", {"": {"": [True, None, [None]]}}]
    df = spark.createDataFrame([(i, json.dumps(x, indent=i % 3)) for i, x in enumerate(docs)], "id long, doc string")
    want = [n for i, x in enumerate(docs) for n in walked(i, x)]
    for by_rows in (0, 2, 6, 21):
        assert sorted(map(tuple, documents.json_tree(df, "doc", keys=["id"], by_rows=by_rows).collect())) == sorted(want)
    assert max(n[2] for n in want) == 20


def test_a_depth_can_be_asked_for(spark):
    """The explorer opens three levels where 0 or none is asked for; a depth beyond the texts' own adds nothing."""
    df = spark.createDataFrame([(0, json.dumps(nested(6)))], "id long, doc string")
    want = sorted(walked(0, nested(6)))
    for asked, by_rows, shown in ((0, 6, 3), (0, 1, 3), (1, 6, 1), (5, 2, 5), (9, 6, 6)):
        assert sorted(map(tuple, documents.json_tree(df, "doc", asked, ["id"], by_rows).collect())) == [n for n in want if n[2] <= shown]


def test_long_lists_far_down(spark):
    value = [{"a": i} for i in range(20_000)]
    for _ in range(300):
        value = [value]
    df = spark.createDataFrame([(json.dumps(value),)], "doc string")
    got = documents.json_tree(df, "doc").groupBy("kind").agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.sum("children").alias("children"))
    assert sorted(map(tuple, got.collect())) == [("array", 301, 300, 20_300), ("number", 20_000, 302, 0), ("object", 20_000, 301, 20_000)]


def test_no_texts(spark):
    assert documents.json_tree(spark.createDataFrame([], "doc string"), "doc").count() == 0


def test_long_strings_with_many_escapes(spark):
    text = '\\"[{' * 200_000
    df = spark.createDataFrame([(json.dumps({"a": [{"b": text}]}),)], "doc string")
    got = sorted(map(tuple, documents.json_tree(df, "doc").collect()))
    assert got == [("$", 0, "object", 1), ("$.a", 1, "array", 1), ("$.a.0", 2, "object", 1), ("$.a.0.b", 3, "string", 0)]


def test_deep_events_agree_with_the_sql(spark, tmp_path):
    rows = [(i, 7, json.dumps(nested(i))) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, props string").selectExpr("*", "'click' AS event_type", "CAST(event_id * 30 AS DOUBLE) AS value", "TIMESTAMP_NTZ '2024-01-05 10:20:30' AS ts")
    df.write.parquet(f"{tmp_path}/events.parquet")
    names = ["event_id", "path", "depth", "kind", "children"]
    got = QUERIES["json_tree_counts"](spark, str(tmp_path)).select(*names)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['json_tree_counts']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert max(r[2] for r in want) == 15
