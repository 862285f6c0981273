"""A training corpus from raw documents: five stages, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the last return
the columns of ``documents``.

Defined cases: documents with a null or empty text are scored like any other, link with nothing, hold no benchmark item
and are copied and placed by their 8 bytes; a null doc_id is carried along, learns no label, and is in no group of copies;
a null source is a source of weight 1; repeated rows are one document in the n-gram join, which keeps one of them, and of
different texts under one doc_id each stays if the doc_id does; texts of any length are read whole by every stage; an empty
table gives an empty result; further columns of any name are carried to the end, unless they are called shard or slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from larkspur.llm.common import Carried, remove, table, written
from larkspur.llm.queries import WEIGHTS


def unnamed(docs: DataFrame, needed: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage over ``docs`` with the names of the needed columns only, so that none clashes with what the stage adds."""
    held = Carried(docs)
    out = stage(held.df.withColumnsRenamed({held[n]: n for n in needed}))
    return held.back(out.withColumnsRenamed({n: held[n] for n in needed}))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return unnamed(docs, ("text",), lambda df: toxicity.score(df, model).where("predicted = 0"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; rows without doc_id stay."""
    return ngram_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's target weight, in a global shuffle."""
    return unnamed(docs, ("doc_id", "text", "source"), lambda df: mixing.mix(df, WEIGHTS, seed=17))


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard (0 to 23, near equal bytes) and slot."""
    return sharding.shard(docs, shards=24, size=sharding.text_size("text"), key=sharding.text_key("text", "doc_id"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", into_shards),
]

#: The toxicity stage learns its model, which SQL cannot express; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # a stage's table goes once the next one is written
        if before is not None:
            remove(before, spark)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
