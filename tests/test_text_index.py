"""The substring index against scans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import text_index


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    made = ["".join(rng.choice("abcdé ß🤗X") for _ in range(rng.randrange(80))) for _ in range(700)]
    return [*made, None, "", "ab", "NEEDLE in a haystack", "a needle too", "x" * 50_000 + "needless"]


@pytest.fixture(scope="module")
def index(spark, texts):
    return text_index.build(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3), "text", "id", 16)


def test_search_equals_a_scan(spark, texts, index):
    rng = random.Random(5)
    needles = ["needle", "NEEDLE", "ab", "a", "", "zzz", "é ß", "🤗x", "xxxx", "needles", "ABC", *[(lambda t, i: t[i : i + rng.randrange(1, 9)])(t, rng.randrange(len(t))) for t in rng.sample([t for t in texts if t and len(t) > 20], 25)]]
    got = sorted((r.needle, r.id) for r in index.search(spark.createDataFrame([(n,) for n in needles], "needle string")).collect())
    assert got == sorted((n, i) for n in set(needles) if n for i, t in enumerate(texts) if t is not None and n.lower() in t.lower())


def test_a_rare_needle_reads_few_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = text_index.build(docs, "text", "doc_id", 128)
    needle = docs.where(F.length("text") > 500).orderBy("doc_id").limit(1).select(F.substring("text", 200, 60).alias("needle"))
    read, every = index.blocks_read(needle)
    assert 0 < read < every / 10
    want = docs.join(needle, F.contains(F.lower("text"), F.lower("needle"))).count()
    assert index.search(needle).count() == want > 0
    plan = index.search(needle)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "block" in plan

