"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A source with weight w (of all weights W) and b of all B bytes is to be repeated w / W * B / b times on average. Each
document's count is the inverse of the Poisson distribution with that mean at a number in [0, 1) hashed from its id and
the seed; the document is exploded by its count, and all copies are sorted by another hash. Counts depend on nothing
but (doc_id, text, seed, rate), so a lost executor's rows come back the same.

Rates are made from sums over all documents, one row a source; weights are joined to them as a table. Sources up to
``MANY`` are joined by broadcast, more by a join salted over the documents, so a source of any share is spread over
tasks.

High rates: a rate over ``CHUNK`` is drawn as a sum of independent counts. Copies are made in runs of ``RUN``; where a
rate lets a document be expected in more than one run, runs are dealt out over all tasks before the copies are made, so
no row and no task holds all copies of a small source. A rate of ``MOST`` and more is refused with the source's name.

Defined cases: a null source is a source of its own; unlisted sources weigh ``other``; a source weighing 0 goes; a
source without text has the rate 1 if it weighs anything; a null text counts 0 bytes; rows repeated with id and text
are drawn alike and told apart by nothing; very long texts count by their bytes; an empty table gives an empty result;
columns are carried along, unless they are named like an output (replica, shuffle_key), which then replaces them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.llm.common import Carried, written

#: Sources up to which rates are broadcast.
MANY = 10_000
SALTS = 64
#: The largest mean that is drawn at once.
CHUNK = 32.0
#: Copies that are made from one row at a time.
RUN = 4096
#: Rates from here on are refused.
MOST = float(1 << 30)


def fraction(*parts: Column) -> Column:
    """A number in [0, 1): 52 bits of the MD5 of the parts, joined by colons."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, source: str, text: str, weights: Mapping[str, float], other: float) -> DataFrame:
    """(_source, rate, draws, cdf): a written table with the cumulative distribution of a draw, to beyond 1 - 2**-52."""
    spark = docs.sparkSession
    per = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).alias("bytes"))
    listed = spark.createDataFrame([(name, float(w)) for name, w in weights.items()], "name string, listed double")
    per = per.join(listed, F.col("_source") == F.col("name"), "left").select("_source", "bytes", F.coalesce("listed", F.lit(float(other))).alias("weight"))
    per = written(per, "mix-sources")
    # shares of the largest weight as decimals, so that their sum is the same in any order
    largest = max([*weights.values(), other, 0.0]) or 1.0
    total = per.agg(F.sum("bytes").alias("bytes"), F.sum((F.col("weight") / largest).cast("decimal(20,18)")).cast("double").alias("weights")).first()
    share = F.col("weight") / largest / F.lit(total.weights or 1.0)
    rate = F.when(F.col("weight") <= 0, 0.0).when(F.col("bytes") == 0, 1.0).otherwise(F.round(share * F.lit(total.bytes or 0) / F.col("bytes"), 9))
    refused = F.raise_error(F.concat(F.lit("too small for its weight: source "), F.coalesce("_source", F.lit("null")))).cast("double")
    per = per.withColumn("rate", rate).withColumn("rate", F.when(F.col("rate") >= MOST, refused).otherwise(F.col("rate")))
    # p(0) = exp(-mean), p(i) = p(i - 1) * mean / i
    per = per.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / CHUNK)).cast("int")).withColumn("mean", F.col("rate") / F.col("draws"))
    steps = F.sequence(F.lit(1), F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 24).cast("int"))
    first = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("c"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * F.col("mean") / i
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return written(per.select("_source", "rate", "draws", F.aggregate(steps, first, step, lambda acc: acc["c"]).alias("cdf")), "mix-rates")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, other: float = 1.0, seed: int = 17) -> DataFrame:
    """``docs`` (doc_id, text, source, ...), repeated, in a global shuffle, with ``replica`` (from 0) and ``shuffle_key``."""
    weights = weights or {}
    if any(not math.isfinite(w) or w < 0 for w in (*weights.values(), other)):
        raise ValueError("weights are finite and 0 at least")
    held = Carried(docs, ("replica", "shuffle_key"))
    doc_id, text, source = held["doc_id"], held["text"], held["source"]
    table = rates(held.df, source, text, weights, other)
    highest = table.agg(F.count("*").alias("n"), F.max("rate").alias("rate")).first()
    same = F.col(source).eqNullSafe(F.col("_source"))
    if highest.n <= MANY:
        joined = held.df.join(F.broadcast(table), same)
    else:
        salt = F.pmod(F.xxhash64(doc_id, text), F.lit(SALTS)).cast("int")
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = held.df.withColumn("mine", salt).join(salted, same & (F.col("mine") == F.col("salt")))
    key = (F.col(doc_id), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    # each draw is hashed once: the numbers first, then their places in the distribution
    numbers = F.transform(F.sequence(F.lit(1), F.col("draws")), lambda i: fraction(F.lit(seed), *key, i))
    count = F.aggregate("numbers", F.lit(0).cast("long"), lambda n, u: n + F.size(F.filter("cdf", lambda c: c <= u)))
    counted = joined.withColumn("numbers", numbers).withColumn("n", count).where("n > 0").select(*held.columns, "n")
    if (highest.rate or 0) > RUN / 2:
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        counted = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
        counted = counted.repartition(tasks, F.xxhash64(doc_id, text), "run")
        of_run = F.sequence((F.col("run") * RUN).cast("int"), (F.least("n", (F.col("run") + 1) * RUN) - 1).cast("int"))
    else:
        of_run = F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))
    copies = counted.withColumn("replica", F.explode(of_run))
    order = F.md5(F.concat_ws(":", F.lit(seed + 1), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "replica").cast("binary"))
    return held.back(copies.withColumn("order", order).orderBy("order", "replica"), "replica", F.col("order").alias("shuffle_key"))
