"""Sharding by sampled splitters.

Records are ordered by (key, doc_id) and cut into shards of near equal bytes:

1. A sample of keys, each record drawn with a probability in proportion to its size, gives quantile splitters.
2. One pass counts records and bytes of every range between splitters; ranges with more than twice their share are
   subdivided by a denser sample of their own, or at the middle of their keys where the sample holds no boundary, until
   none is left that can be split (a single key cannot).
3. Records are partitioned by range and sorted within; with the totals of the ranges before, each knows the bytes and
   records before it, and shard s takes the records whose middle byte lies in the s-th part of all bytes.

So the bytes of a shard differ from an even share by no more than the records at its two ends. What the driver holds is
bounded by the number of ranges (``max_ranges``) and never by the records. The key of a text (upper bits by text, lower
bits by doc_id) lays equal texts side by side, so a group of them is in one shard or in consecutive ones: it is cut only
where a shard ends, at most ``shards`` - 1 groups are, and a group of copies of any size can be spread.

Defined cases: a null text counts 8 bytes; a null size counts as 0; repeated rows get neighbouring slots; rows without
doc_id and of one text have one key, which one task orders (in a sort that spills) however many they are; fewer records
than shards leave shards empty; an empty table gives an empty result; other columns, whatever their names, are carried
along, unless they are named like an output (shard, slot), which then replaces them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.llm.common import Carried, written

#: Splitters are quantiles of about so many sampled keys a range.
PER_RANGE = 16


def text_size(text: str) -> Column:
    """UTF-8 bytes plus 8."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long")


def text_crc32(text: str) -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def text_key(text: str, doc_id: str) -> Column:
    """36 bits of the text's MD5, then 24 of the id's."""
    hashed = [F.md5(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) for c in (text, doc_id)]
    return F.conv(F.concat(F.substring(hashed[0], 1, 9), F.substring(hashed[1], 1, 6)), 16, 10).cast("long")


def _range_of(splitters: np.ndarray, spark):
    shared = spark.sparkContext.broadcast(splitters)

    @F.pandas_udf("int")
    def number(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, key.to_numpy(), side="right").astype(np.int32))

    return number(F.col("key"))


def _sampled(narrow: DataFrame, share: Column, seed: int) -> list:
    """Keys of the records whose hash-seeded number falls below their share."""
    number = F.pmod(F.xxhash64("key", "doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return narrow.where(number < share)


def splitters(narrow: DataFrame, total: int, ranges: int, seed: int = 1) -> tuple[np.ndarray, list]:
    """Boundaries between ranges, and (range, bytes, records) of each."""
    spark = narrow.sparkSession
    wanted = ranges * PER_RANGE

    def keys(of: DataFrame, step: int) -> np.ndarray:
        drawn = _sampled(of, F.col("size") * (wanted / total), seed + step).select("key").limit(4 * wanted)
        return np.sort(drawn.toArrow()["key"].to_numpy())

    first = keys(narrow, 0)
    cuts = np.unique(first[np.linspace(0, len(first) - 1, ranges + 1).astype(int)][1:-1]) if ranges > 1 and len(first) else np.zeros(0, np.int64)
    for step in range(1, 100):  # halving alone ends within 64 steps
        ranged = narrow.withColumn("range", _range_of(cuts, spark))
        found = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"), F.min("key").alias("low"), F.max("key").alias("high")).toArrow().to_pylist()
        over = [r for r in found if r["bytes"] > 2 * total / ranges and r["low"] < r["high"]]
        if not over:
            break
        # as many keys of each overfull range as it holds shares, PER_RANGE times over
        numbers = spark.createDataFrame([(r["range"],) for r in over], "range int")
        extra = keys(ranged.join(F.broadcast(numbers), "range", "left_semi"), step)[PER_RANGE // 4 :: PER_RANGE // 2]  # max_ranges numbers at most
        halves = []
        for r in over:
            inside = extra[np.searchsorted(extra, r["low"], "right") : np.searchsorted(extra, r["high"], "right")]
            # a boundary is the first key of the range behind it
            halves += inside.tolist() or [r["low"] + (r["high"] - r["low"] + 1) // 2]
        cuts = np.unique(np.concatenate([cuts, np.array(halves, np.int64)]))
    return cuts.astype(np.int64), sorted((r["range"], r["bytes"], r["records"]) for r in found)


def shard(docs: DataFrame, shards: int = 24, size: str | Column = "size", key: str | Column = "key", range_bytes: int = 64 << 20, max_ranges: int = 1 << 17, seed: int = 1) -> DataFrame:
    """``docs`` (doc_id, ...) with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in its shard).

    size, key: columns of ``docs``, or expressions over them, of longs.
    """
    spark = docs.sparkSession
    size, key = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("long").alias(a) for c, a in ((size, "size"), (key, "key")))
    held = Carried(docs, ("shard", "slot"), size, key)
    measured = held.df
    doc_id = held["doc_id"]
    narrow = written(measured.select(F.col(doc_id).alias("doc_id"), "size", "key"), "shard-keys")
    all_ = narrow.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    total = max(all_.bytes or 0, 1)
    ranges = int(min(max_ranges, max(4 * shards, total // range_bytes)))
    cuts, sums = splitters(narrow, total, ranges, seed) if all_.n else (np.zeros(0, np.int64), [])
    before = np.zeros((2, len(cuts) + 2), np.int64)
    for r, n_bytes, n in sums:
        before[:, r + 1] = n_bytes, n
    before = np.cumsum(before, axis=1)

    def placed(df: DataFrame, doc_id: str) -> DataFrame:
        """With the bytes and records before each."""
        offsets = spark.createDataFrame(pd.DataFrame({"range": np.arange(len(cuts) + 1, dtype=np.int32), "bytes": before[0, :-1], "rows": before[1, :-1]}))
        w = Window.partitionBy("range").orderBy("key", F.col(doc_id).asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
        return (
            df.withColumn("range", _range_of(cuts, spark))
            .withColumn("to", F.sum("size").over(w))
            .withColumn("n", F.count(F.lit(1)).over(w))
            .join(F.broadcast(offsets), "range")  # max_ranges rows of three numbers, or as many more as were subdivided
            .withColumn("middle", F.col("bytes") + F.col("to") - F.col("size") / 2)
            .withColumn("shard", F.least(F.floor(F.col("middle") * shards / total), F.lit(shards - 1)).cast("int"))
            .withColumn("at", F.col("rows") + F.col("n") - 1)
        )

    firsts = placed(narrow, "doc_id").groupBy("shard").agg(F.min("at").alias("first"))
    firsts = spark.createDataFrame([(r.shard, r["first"]) for r in firsts.collect()], "shard int, first long")
    return held.back(placed(measured, doc_id).join(F.broadcast(firsts), "shard"), "shard", (F.col("at") - F.col("first")).alias("slot"))
