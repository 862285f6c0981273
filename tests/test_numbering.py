"""Row numbers over ranges against numbers given by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspur.engine import Engine
from larkspur.operators.numbering import numbered


@pytest.fixture(scope="module")
def rows(spark):
    group = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 5 == 0, "a").otherwise(F.col("id").cast("string"))
    return spark.range(4000).select((F.col("id") * 7919 % 1009).alias("v"), group.alias("g")).repartition(5)


def test_numbers_follow_the_order_without_gaps(rows):
    got = sorted((r.rn, r.v) for r in numbered(rows, F.desc("v")).collect())
    assert [n for n, _ in got] == list(range(1, 4001))
    assert [v for _, v in got] == sorted((v for _, v in got), reverse=True)


def test_numbers_within_groups_null_being_one(rows):
    groups: dict = {}
    for r in numbered(rows, F.col("g"), F.desc("v"), name="at", start=0, by="g").collect():
        groups.setdefault(r.g, []).append((r["at"], r.v))
    assert None in groups and len(groups) > 1000
    for found in groups.values():
        assert [n for n, _ in sorted(found)] == list(range(len(found)))
        assert [v for _, v in sorted(found)] == sorted((v for _, v in found), reverse=True)


def test_empty_equal_and_unordered_rows(spark, rows):
    assert numbered(rows.limit(0), F.col("v"), by="v").count() == 0
    same = spark.range(50).select(F.lit(1).alias("x"))
    assert sorted(r.rn for r in numbered(same, F.col("x")).collect()) == list(range(1, 51))
    assert sorted(r.rn for r in numbered(rows).collect()) == list(range(1, 4001))


def test_sorted_groups_are_numbered_without_an_unpartitioned_window(spark, sf_dir):
    got = Engine(spark, sf_dir).execute("index=events | stats count by user_id | sort -count", "spl").rows
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the one window without partitions is over the counts of the ranges, a row each
    assert "row_number" not in plan and plan.count("SinglePartition") == 1 and "sum(_n" in plan
    counts = [(r.rn, r["count"]) for r in got.collect()]
    assert [c for _, c in sorted(counts)] == sorted((c for _, c in counts), reverse=True)
