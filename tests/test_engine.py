from __future__ import annotations

import functools

import pytest
from pyspark.sql import functions as F

from larkspur.engine import Engine
from larkspur.functions import scalars
from larkspur.operators import classify, conversations, documents, jobs, profiling, search, tables
from larkspur.plans import spl


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"pos int, c {kind}")


def one(df):
    return [r[0] for r in df.collect()]


def test_pipe_text_is_parsed():
    q = spl.parse("index=web | stats count, avg(x) by a, b | sort -count, +a")
    assert q.index == "web"
    assert [a.alias for a in q.commands[0].aggregates] == ["count", "avg_x"]
    assert q.commands[0].by == ["a", "b"] and q.commands[1].keys == [("count", True), ("a", False)]
    assert spl.parse("index=web | timechart span=5m count").commands[0].span == "5 minute"


@pytest.mark.parametrize("text", ["stats count", "index=a | stats max(x)", "index=a | drop x", "index=a | stats sum", "index=a | sort -1x"])
def test_pipe_text_outside_the_grammar(text):
    with pytest.raises(spl.SplError):
        spl.parse(text)


def test_execute_gives_an_envelope(spark, sf_dir):
    r = Engine(spark, sf_dir).execute("index=events | stats count by event_type | sort -count", "spl")
    assert r.visualization == "single-value" and r.suggested["visualization"] == "bar"
    counts = [x["count"] for x in r.rows.orderBy("rn").collect()]
    assert counts == sorted(counts, reverse=True) and r.row_count() == len(counts)
    assert Engine(spark, sf_dir).execute("SELECT count(*) AS n FROM region").single_value() == 5
    with pytest.raises(ValueError):
        Engine(spark, sf_dir).execute("x", "other")


def test_raw_rows_are_sorted_by_ranges(spark, sf_dir):
    found = Engine(spark, sf_dir).execute("index=region | sort -r_name", "spl").rows
    assert found.columns == ["r_regionkey", "r_name"]
    names = [r.r_name for r in found.collect()]
    assert names == sorted(names, reverse=True)


@pytest.mark.parametrize("values", [["10", "9", "2"], ["b", "A", "c", "a"], ["2024-03-01", "2024-01-15", "2023-12-31"], ["1.5e1", " 3", "-2x", "+.5"], [None, "a", "z"]])
@pytest.mark.parametrize("down", [False, True])
def test_sort_agrees_with_a_comparator(spark, values, down):
    def number(x):
        import re

        m = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", x)
        return float(m[1]) if m else None

    def compare(a, b):
        a, b = (str("null" if x is None else x) for x in (a, b))
        x, y = number(a), number(b)
        if x is None or y is None:
            x, y = a.lower(), b.lower()
        return ((x > y) - (x < y)) * (-1 if down else 1)

    got = one(tables.sorted_page(column(spark, values), "c", "pos", down).orderBy("rn").select("c"))
    assert got == sorted(values, key=functools.cmp_to_key(compare))


def test_pages(spark):
    df = spark.range(130).withColumnRenamed("id", "n")
    assert tables.page_info(df).first().pages == 2
    page = tables.sorted_page(df.withColumn("pos", F.col("n")), "n", "pos", page=2)
    assert sorted(one(page.select("rn"))) == list(range(51, 101))


def test_search_rules(spark):
    df = spark.createDataFrame([(0, "50%_off", True), (1, "", False), (2, None, None)], "id int, name string, on boolean")
    assert one(search.search(df, "%_", ["name"]).select("id")) == [0]
    assert search.search(df, "0", ["id"]).count() == 0
    assert search.search(df, "  ").count() == 3
    assert search.filter_columns(df) == ["name"]


@pytest.mark.parametrize(("text", "want"), [("this is fine", "greeting"), ("Help", "help"), ("graph", "chart"), ("so?", "question"), ("ok", "echo")])
def test_server_reply(spark, text, want):
    assert one(column(spark, [text]).select(classify.server_reply(F.col("c")))) == [want]


@pytest.mark.parametrize(("text", "want"), [("index=a | stats count by status", "single-value"), ("index=a | timechart count", "timechart"), ("select * from users", "table"), ("percent", "gauge"), ("stats max", "bar")])
def test_visualization(spark, text, want):
    assert one(column(spark, [text]).select(classify.visualization(F.col("c")))) == [want]


def test_due_labels(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ '2024-01-01 12:00:00'), (TIMESTAMP_NTZ '2023-12-31 12:00:00'), (TIMESTAMP_NTZ '2024-01-02 04:48:00'), (TIMESTAMP_NTZ '2024-01-03 12:00:00'), (NULL) AS t(d)")
    as_of = F.expr("TIMESTAMP_NTZ '2024-01-02 00:00:00'")
    assert one(df.select(scalars.due_label(F.col("d"), as_of))) == ["Due today", "Overdue (1 days)", "Due tomorrow", "Due in 2 days", None]


def test_checklist_edges(spark):
    schema = "id string, parent_id string, checked boolean"
    assert tuple(documents.checklist_totals(spark.createDataFrame([], schema)).first()) == (0, 0, 0)
    rows = [("1", None, True), ("1a", "1", True), ("1b", "1", True)]
    assert tuple(documents.checklist_totals(spark.createDataFrame(rows, schema)).first()) == (3, 3, 300)


def test_lookups_and_edits(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    with pytest.raises(LookupError):
        conversations.get(df, "id", 9)
    assert conversations.find(df, "id", 9).count() == 0
    kept = conversations.patched(df, spark.createDataFrame([(2, "z"), (7, "q")], df.schema), "id", ["name"])
    assert sorted(map(tuple, kept.collect())) == [(1, "a"), (2, "z")]
    assert conversations.current_after_delete(df, 1, 2, "id", "id").first()[0] == 2
    assert conversations.current_after_delete(df.where("id = 1"), 1, 1, "id", "id").first()[0] is None


def test_jobs(spark):
    with pytest.raises(ValueError):
        jobs.create(spark, "report")
    assert jobs.create(spark, "chart", days=40).count() == 40
    up = spark.createDataFrame([(1, 1, "queued"), (1, 2, "completed"), (2, 1, "queued")], "job int, seq int, status string")
    assert [tuple(r) for r in jobs.latest(up, "job", ["seq"], up.where("job = 1")).collect()] == [(1, 2, "completed")]


def test_types_of_fields(spark):
    rows = [("true", "1.5", "2024-01-15T10:30:00Z", "10.0.0.1", "https://a.b/c", "x"), (None, "-2", "2024-01-15", "1.2.3.4", "http://x", "1")]
    df = spark.createDataFrame(rows, "b string, n string, t string, i string, u string, s string")
    assert one(profiling.profile(df).select("type")) == ["boolean", "number", "timestamp", "ip", "url", "string"]


def test_visualization_at_hand_equals_the_column(spark):
    from larkspur.catalog.rules import QUERY_TEXTS

    texts = [*QUERY_TEXTS, "stats count by x, percent", "by pie", "a by stats of count by b", ""]
    assert one(column(spark, texts).orderBy("pos").select(classify.visualization(F.col("c")))) == [classify.visualization_of(t) for t in texts]


def test_indexes_leave_views_of_the_user_alone(spark, sf_dir):
    spark.createDataFrame([(7,)], "n int").createOrReplaceTempView("supplier")
    assert Engine(spark, sf_dir).execute("SELECT * FROM supplier").single_value() == 7
    spark.catalog.dropTempView("supplier")
    assert Engine(spark, sf_dir).execute("SELECT * FROM supplier").rows.count() > 1


def test_numbers_are_sorted_as_numbers(spark):
    df = column(spark, [3.0, None, -1.0, float("nan"), 10.0], "double")
    for down in (False, True):
        as_text = df.withColumn("c", F.col("c").cast("string"))
        want = one(tables.sorted_page(as_text, "c", "pos", down).orderBy("rn").select("pos"))
        assert one(tables.sorted_page(df, "c", "pos", down).orderBy("rn").select("pos")) == want


def test_deep_trees_are_refused_and_circles_too(spark):
    schema = "id string, parent_id string, checked boolean"
    deep = [(str(i), str(i - 1) if i else None, True) for i in range(5)]
    with pytest.raises(ValueError):
        documents.checklist_totals(spark.createDataFrame(deep, schema), max_depth=4)
    assert documents.checklist_totals(spark.createDataFrame(deep, schema), max_depth=5).first().total == 5


def test_relay_drops_a_sink_that_fails(spark, tmp_path):
    from larkspur.streaming.relay import relay

    for i in range(3):
        spark.range(i * 10, i * 10 + 5).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    seen, tried = [], []

    def good(batch, number):
        seen.extend(r.id for r in batch.collect())

    def bad(batch, number):
        tried.append(number)
        raise OSError("gone")

    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    relay(stream, {"bad": bad, "good": good}, str(tmp_path / "checkpoint")).start().awaitTermination()
    assert sorted(seen) == [*range(5), *range(10, 15), *range(20, 25)] and len(tried) == 1


def test_streams_read_folders_of_files_batch_by_batch(spark, sf_dir, tmp_path):
    from larkspur.streaming import flows

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = flows.drained(flows.job_states(flows.events(spark, str(tmp_path)), "user_id", ["ts", "event_id"], ["event_type"]))
    want = flows.drained(flows.job_states(flows.events(spark, sf_dir), "user_id", ["ts", "event_id"], ["event_type"]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0
