"""Keyed states against a fold over the events in order, with restarts; relayed tables against stops in mid-batch."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F, types as T

from larkspur.streaming import keyed
from larkspur.streaming.relay import RelayedTable, caught_up, relay

SCHEMA = "job_id long, action string, at long, status string, progress int, ts timestamp"


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed.use_rocks(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def folded(events):
    jobs: dict = {}
    for job, action, at, status, progress, _ in sorted(events, key=lambda e: e[2]):
        if action == "set":
            jobs[job] = [status, progress]
        elif action == "remove":
            jobs.pop(job, None)
        elif job in jobs:
            jobs[job] = [new if new is not None else old for new, old in zip((status, progress), jobs[job])]
    return sorted((j, *v) for j, v in jobs.items())


def made(n, seed):
    rng, when = random.Random(seed), "2024-01-01 00:00:00"
    action = lambda: rng.choices(["set", "update", "remove"], [2, 6, 1])[0]
    return [(rng.choice([1, 1, *range(30)]), action(), i, rng.choice([None, "queued", "started"]), rng.choice([None, rng.randrange(101)]), when) for i in range(n)]


def batches(spark, path, events, size):
    df = spark.createDataFrame(events, SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
    for first in range(0, len(events), size):
        df.where(f"at >= {first} AND at < {first + size}").coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


CHANGES = "key long, at long, gone boolean, status string, progress int"


def test_states_equal_a_fold_and_survive_a_restart(rocks, tmp_path):
    spark, events = rocks, made(300, 1)
    source, table = str(tmp_path / "in"), RelayedTable(rocks, str(tmp_path / "out"))

    def run():
        found = keyed.states(stream(spark, source), "job_id", "action", "at", ["status", "progress"])
        query = relay(found, {"table": table}, str(tmp_path / "checkpoint"), "update").start()
        query.awaitTermination()
        return query.recentProgress

    batches(spark, source, events[:150], 50)
    assert len(run()) >= 3
    batches(spark, source, [(*e[:2], e[2], *e[3:]) for e in events[150:]], 10**9)
    run()
    got = keyed.current(table.read(CHANGES)).select("key", "status", "progress")
    assert sorted(map(tuple, got.collect())) == folded(events)
    gone = [(i, "remove", 300 + i, None, None, "2024-01-02 00:00:00") for i in range(30)]
    batches(spark, source, gone, 10**9)
    progress = run()[-1].stateOperators[0]
    assert progress.numRowsTotal == 0 and progress.numRowsRemoved > 0
    assert keyed.current(table.read(CHANGES)).count() == 0


def test_late_events_change_only_what_no_later_one_has(rocks, tmp_path):
    events = [(1, "set", 0, "queued", 0, None), (1, "update", 5, "started", None, None), (1, "update", 3, "late", 40, None), (2, "update", 1, "x", 1, None), (1, "update", 4, None, 30, None)]
    df = rocks.createDataFrame(events, SCHEMA)
    for e in range(len(events)):
        df.where(f"at = {events[e][2]}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = RelayedTable(rocks, str(tmp_path / "out"))
    found = keyed.states(stream(rocks, str(tmp_path / "in")), "job_id", "action", "at", ["status", "progress"])
    relay(found, {"t": table}, str(tmp_path / "cp"), "update").start().awaitTermination()
    assert [tuple(r) for r in keyed.current(table.read(CHANGES)).collect()] == [(1, 5, "started", 30)]


def test_idle_keys_are_dropped_by_a_timer(rocks, tmp_path):
    source, table = str(tmp_path / "in"), RelayedTable(rocks, str(tmp_path / "out"))
    rows = [[(1, "set", 0, "queued", 0, "2024-01-01 00:00:00"), (2, "set", 1, "queued", 0, "2024-01-01 00:00:00")]]
    rows += [[(2, "update", 2 + i, "started", i, f"2024-01-0{2 + i} 00:00:00")] for i in range(4)]
    for some in rows:
        df = rocks.createDataFrame(some, SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(source)
    watched = stream(rocks, source).withWatermark("ts", "1 hour")
    found = keyed.states(watched, "job_id", "action", "at", ["status", "progress"], "ts", 36 * 3600 * 1000)
    relay(found, {"t": table}, str(tmp_path / "cp"), "update").start().awaitTermination()
    assert [tuple(r)[:3] for r in keyed.current(table.read(CHANGES)).collect()] == [(2, 5, "started")]


class Stopped(Exception):
    pass


def test_a_stop_in_mid_batch_loses_and_doubles_nothing(spark, tmp_path):
    events = made(120, 2)
    source, schema = str(tmp_path / "in"), T._parse_datatype_string(SCHEMA)
    batches(spark, source, events, 30)
    good, bad = RelayedTable(spark, str(tmp_path / "a")), RelayedTable(spark, str(tmp_path / "b"))
    stops = {"left": 1}

    def stopping(batch, number):
        if number == 2 and stops["left"]:
            stops["left"] = 0
            # rows are there, the commit is not
            batch.write.mode("overwrite").parquet(f"{tmp_path}/b/rows/batch={number}")
            raise Stopped
        bad(batch, number)

    with pytest.raises(Exception):
        relay(stream(spark, source), {"b": stopping}, str(tmp_path / "cp")).start().awaitTermination()
    assert bad.committed() == [0, 1] and bad.read(schema).count() == 60
    relay(stream(spark, source), {"b": stopping}, str(tmp_path / "cp")).start().awaitTermination()
    assert sorted(r["at"] for r in bad.read(schema).collect()) == list(range(120))
    # a sink that fails misses nothing for the others, and gets the rest later
    stops["left"] = 1
    behind = RelayedTable(spark, str(tmp_path / "c"))

    def failing(batch, number):
        if number == 1:
            raise Stopped
        behind(batch, number)

    relay(stream(spark, source), {"c": failing, "a": good}, str(tmp_path / "cp2")).start().awaitTermination()
    assert good.committed() == [0, 1, 2, 3] and behind.committed() == [0]
    assert caught_up(behind, good, schema) == [1, 2, 3]
    assert sorted(r["at"] for r in behind.read(schema).collect()) == list(range(120))
    assert RelayedTable(spark, str(tmp_path / "none")).read(schema).count() == 0
