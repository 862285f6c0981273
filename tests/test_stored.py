"""Stored tables: what each change leaves untouched, what readers see, failures, two writers, and rows against dictionaries."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F, types as T

from larkspur.sources.stored import Conflict, StoredTable

SCHEMA = T.StructType().add("conv", "long").add("id", "long").add("text", "string")
JOBS = T.StructType().add("job", "long").add("status", "string").add("progress", "integer")


@pytest.fixture
def table(spark, tmp_path):
    return StoredTable.create(spark, str(tmp_path / "t"), SCHEMA, "conv", 4)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()))


def files(table, version=None):
    """Names of the files of each bucket."""
    found = {}
    state = table._state(table.versions()[-1] if version is None else version)["folders"]
    for b, names in state.items():
        found[b] = sorted(str(p) for n in names for p in Path(table.path, "data", n, f"_bucket={b}").glob("*.parquet"))
    return found


def bucket_of(table, conv):
    return str(table.spark.range(1).select(table.bucket(F.lit(conv).cast("long"))).first()[0])


def test_changes_leave_other_buckets_files(spark, table):
    first = [(c, i, f"m{i}") for c in range(20) for i in range(3)]
    table.append(frame(spark, first))
    before = files(table)
    assert rows(table.read()) == sorted(first) and len(before) == 4
    for change in (lambda: table.append(frame(spark, [(3, 9, "new")])), lambda: table.replace(frame(spark, [(3, 0, "")]), frame(spark, [(3, 1, "only")])), lambda: table.delete(frame(spark, [(3, 0, "")]))):
        old = files(table)
        change()
        now, own = files(table), bucket_of(table, 3)
        assert now[own] != old[own] and {b: f for b, f in now.items() if b != own} == {b: f for b, f in old.items() if b != own}
    assert rows(table.read()) == sorted(r for r in first if r[0] != 3)
    assert files(table)[bucket_of(table, 4)] == before[bucket_of(table, 4)] or bucket_of(table, 4) == bucket_of(table, 3)
    # every version is still there to read
    assert [table.read(v).count() for v in table.versions()] == [0, 60, 61, 58, 57]


def test_appends_keep_keys_once(spark, table):
    table.append(frame(spark, [(1, 1, "a"), (1, 1, "b"), (2, 1, "c")]), ["conv", "id"])
    table.append(frame(spark, [(1, 1, "late"), (1, 2, "d"), (None, 1, "e")]), ["conv", "id"])
    got = table.read().orderBy("conv", "id").collect()
    assert [(r.conv, r.id) for r in got] == [(None, 1), (1, 1), (1, 2), (2, 1)] and {r.text for r in got} & {"late"} == set()


def test_upserts_against_a_dictionary(spark, tmp_path):
    table = StoredTable.create(spark, str(tmp_path / "jobs"), JOBS, "job", 3)
    rng, jobs = random.Random(3), {}
    for step in range(6):
        some = {rng.randrange(12): (rng.choice([None, "queued", "done"]), rng.choice([None, rng.randrange(100)])) for _ in range(5)}
        partial = step % 2 == 1
        for job, new in some.items():
            if not partial:
                jobs[job] = new
            elif job in jobs:
                jobs[job] = tuple(n if n is not None else o for n, o in zip(new, jobs[job]))
        table.upsert(spark.createDataFrame([(j, *v) for j, v in some.items()], table.schema), partial)
        assert sorted(map(tuple, table.read().collect()), key=repr) == sorted(((j, *v) for j, v in jobs.items()), key=repr)
    assert [tuple(r) for r in table.lookup(next(iter(jobs))).collect()] == [(next(iter(jobs)), *jobs[next(iter(jobs))])]


def test_a_failed_write_leaves_the_old_version(spark, table):
    table.append(frame(spark, [(c, 0, "x") for c in range(8)]))
    before, old = table.versions(), rows(table.read())
    broken = frame(spark, [(1, 5, "y")]).withColumn("text", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        table.append(broken)
    assert table.versions() == before and rows(table.read()) == old
    table.delete(frame(spark, [(c, 0, "") for c in range(8)]))
    assert rows(table.read()) == [] and table.vacuum() and rows(StoredTable(spark, table.path).read()) == []


def test_of_two_writers_one_has_to_start_again(spark, table, monkeypatch):
    other = StoredTable(spark, table.path)
    base = other._now()
    table.append(frame(spark, [(1, 1, "a")]))
    monkeypatch.setattr(other, "_now", lambda: base)
    with pytest.raises(Conflict):
        other.append(frame(spark, [(1, 2, "b")]))
    monkeypatch.undo()
    other.append(frame(spark, [(1, 2, "b")]))
    assert rows(table.read()) == [(1, 1, "a"), (1, 2, "b")]


def test_many_appends_are_written_together(spark, table):
    for i in range(10):
        table.append(frame(spark, [(1, i, "x")]))
    assert len(table._state(table.versions()[-1])["folders"][bucket_of(table, 1)]) < 9 and table.read().count() == 10
    with pytest.raises(ValueError):
        table.replace(frame(spark, [(1, 0, "")]), frame(spark, [(2, 0, "")]))
    assert table.vacuum(2) and table.read().count() == 10
