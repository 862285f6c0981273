"""Benchmark decontamination by SimHash over item-sized windows. DataFrame functions only.

Words are those of the license scan (letters, digits and non-ASCII characters, lower case); a shingle is the hash of
five consecutive words, or of all where there are fewer.

1. Windows. For an item of m shingles, windows are m shingles of a document. Moving a window on to its next shingle
   that the item has too never loses one it shares, so the most similar windows are among those that start at a shared
   shingle (or are the last of the text). Only these are made, and only where the window holds as many shingles of the
   benchmark as the similarity asks for at least; a text that shares none has no similar window.
2. Fingerprints. 64-bit SimHash of each window and item, shingles weighted by how often they occur.
3. Multi-index. A fingerprint is cut into 8 blocks of 8 bits. Fingerprints within ``RADIUS`` = 23 bits differ by 2 bits
   at most in some block, so each item is entered under every value within 2 bits of its own, block by block: a lookup
   of the window's 8 blocks meets all items of its size within the radius. Hamming distances are then taken in full.
4. Verification. Weighted Jaccard similarity of the shingles (sum of smaller over sum of larger counts), at least
   ``threshold`` (0.8).

What the radius misses: windows at a similarity of 0.8 are about 9 or 10 bits from their item, with a deviation under
3, so 23 bits lie over four deviations off. Of 2,000 planted windows of 1 to 50 shingles, each as far from its item as
0.8 allows, the test finds all.

The benchmark is what is held on the driver and broadcast, and its size is checked: up to ``INLINE`` shingles in up to
``MAX_ITEMS`` items are tested as a hash set in the scan and entered in a broadcast index. Above these, ``leaks`` joins
by shuffle, with the same result. Keys of documents to remove are broadcast up to ``MAX_KEYS``, else joined by shuffle.

Defined cases: null or empty texts and items share nothing; items and texts under five words are one shingle; a text
shorter than an item is one window; very long texts and items are read to the end; rows with the same doc_id and text
are one document, a null doc_id being an id like others; rows with one doc_id and different texts are judged one by one;
empty tables give an empty result; other columns of the documents, whatever their names, are carried along by
``decontaminate`` and not read by ``leaks``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.llm.common import Carried, if_small, written
from larkspur.llm.licenses import spaced

K = 5
RADIUS, BLOCKS, WIDTH = 23, 8, 8
INLINE, MAX_ITEMS, MAX_KEYS = 100_000, 2_000, 200_000
#: All values of up to RADIUS // BLOCKS bits.
NEAR = [sum(1 << b for b in bits) for k in range(RADIUS // BLOCKS + 1) for bits in combinations(range(WIDTH), k)]
LANES = 0x0000000100000001


def shingles(text: Column) -> Column:
    """Hashes of all runs of K words of a text, in order; empty without words."""
    # the lambda's variable stands for the words, so they are made once
    return F.element_at(F.transform(F.array(F.split(spaced(text), " ")), _of_words), 1)


def _of_words(w: Column) -> Column:
    none = F.array().cast("array<bigint>")
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(K)]))
    return F.when(F.get(w, F.lit(0)) == "", none).when(F.size(w) < K, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(runs)


def simhash(s: Column) -> Column:
    """Bit b is set where most of the hashes have it set. 32 sums, each of 2 counters of 32 bits, as many as any array
    has places."""

    def shifted(x: Column, by: Column) -> Column:
        return F.call_function("shiftrightunsigned", x, by)

    def lane(g: Column) -> Column:
        return F.aggregate(s, F.lit(0).cast("long"), lambda acc, x: acc + shifted(x, g).bitwiseAND(F.lit(LANES)))

    def bits(lanes: Column) -> Column:
        def bit(b: Column) -> Column:
            often = shifted(F.get(lanes, b % 32), F.floor(b / 32).cast("int") * 32).bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.size(s)
            return F.when(often, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda out, b: out.bitwiseOR(bit(b)))

    # the lanes are a lambda's variable, so they are summed up once
    return F.element_at(F.transform(F.array(F.transform(F.sequence(F.lit(0), F.lit(31)), lane)), bits), 1)


def similarity(x: Column, y: Column) -> Column:
    """Weighted Jaccard of two arrays of shingles."""
    both = F.array_intersect(x, y)
    often = F.aggregate(both, F.lit(0), lambda acc, s: acc + F.least(F.size(F.filter(x, lambda v: v == s)), F.size(F.filter(y, lambda v: v == s))))
    once = (F.size(F.array_distinct(x)) == F.size(x)) | (F.size(F.array_distinct(y)) == F.size(y))
    shared = F.when(once, F.size(both)).otherwise(often)
    return shared / (F.size(x) + F.size(y) - shared)


def _block(fingerprint: Column, b: Column | int) -> Column:
    by = b * WIDTH if isinstance(b, Column) else F.lit(b * WIDTH)
    return F.call_function("shiftrightunsigned", fingerprint, by).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, hash, item_id, similarity): items that a document holds, with that of the most similar window.

    hash is that of the text; it tells texts with the same or no doc_id apart.
    """
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", shingles(F.col("text")).alias("item")).where(F.size("item") > 0)
    items = written(items.distinct().withColumn("m", F.size("item")).withColumn("item_print", simhash(F.col("item"))), "decon-items")
    wanted = items.select(F.explode("item").alias("s"), "m").distinct()
    size = items.agg(F.count("*").alias("n"), F.sum("m").alias("m")).first()
    few = size.n <= MAX_ITEMS and (size.m or 0) <= INLINE
    # a generator of one row: the shingles are not computed again in each expression that uses them
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.explode(F.array(shingles(F.col("text")))).alias("all"))
    if few:
        known = sorted({r.s for r in wanted.select("s").collect()})
        places = F.array_compact(F.transform("all", lambda s, i: F.when(s.isin(known), i))) if known else F.array().cast("array<int>")
        held = rows.select("*", F.explode(F.array(places)).alias("places")).where(F.size("places") > 0)
        starts = held.select("*", F.posexplode("places").alias("j", "p")).withColumn("s", F.get("all", "p")).join(F.broadcast(wanted), "s").drop("s")
    else:
        # places of a text once, however often its row is repeated; a null doc_id is an id like others
        per = rows.select("doc_id", "hash", F.posexplode("all").alias("p", "s")).join(wanted, "s").groupBy(F.col("doc_id").alias("id"), F.col("hash").alias("of"))
        per = per.agg(F.collect_set(F.struct("p", "m")).alias("found"))
        held = rows.join(per, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("of"))).dropDuplicates(["doc_id", "hash"])
        starts = held.select("doc_id", "hash", "all", F.array_sort(F.array_distinct("found.p")).alias("places"), F.explode("found").alias("x")).select("doc_id", "hash", "all", "places", "x.p", "x.m")
        starts = starts.withColumn("j", (F.array_position("places", F.col("p")) - 1).cast("int"))
    # a window that starts at place j holds enough shingles of the benchmark if the last it needs lies within; the last
    # window of a text is held against the bound that all places of the text give
    last = F.greatest(F.size("all") - F.col("m"), F.lit(0))
    need = F.ceil(threshold / (1 + threshold) * (F.col("m") + F.least("m", F.size("all"))) - 1e-9).cast("int")
    enough = F.when(F.col("p") <= last, F.coalesce(F.get("places", F.col("j") + need - 1) < F.col("p") + F.col("m"), F.lit(False))).otherwise(F.size("places") >= need)
    windows = starts.where(enough).withColumn("start", F.least("p", last)).select("doc_id", "hash", "m", "start", F.slice("all", F.col("start") + 1, F.col("m")).alias("window"))
    windows = windows.dropDuplicates(["doc_id", "hash", "start", "m"]).withColumn("window_print", simhash(F.col("window")))
    b = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("b")
    probes = windows.select("*", b).withColumn("v", _block(F.col("window_print"), F.col("b")))
    entries = items.select("item_id", "item_print", "m", b)
    entries = entries.withColumn("near", F.explode(F.array(*[F.lit(x) for x in NEAR]))).withColumn("v", _block(F.col("item_print"), F.col("b")).bitwiseXOR(F.col("near")))
    entries = entries.drop("near")
    met = probes.join(F.broadcast(entries) if few else entries, ["m", "b", "v"])
    apart = F.col("window_print").bitwiseXOR(F.col("item_print"))
    # a pair is taken at the first block that meets
    first = F.lit(True)
    for j in range(BLOCKS):
        first = first & ((F.lit(j) >= F.col("b")) | (F.bit_count(_block(apart, j)) > RADIUS // BLOCKS))
    met = met.where((F.bit_count(apart) <= RADIUS) & first).select("doc_id", "hash", "window", "item_id", "item_print", "m")
    bodies = items.select("item_id", "item_print", "m", "item")
    found = met.join(F.broadcast(bodies) if few else bodies, ["item_id", "item_print", "m"]).withColumn("similarity", similarity(F.col("window"), F.col("item")))
    return found.where(F.col("similarity") >= threshold).groupBy("doc_id", "hash", "item_id").agg(F.max("similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` (doc_id, text, ...) without those that hold an item."""
    found = leaks(docs.select("doc_id", "text"), benchmark, threshold).select(F.col("doc_id").alias("id"), "hash").distinct()
    held = Carried(docs)
    same = (F.xxhash64(held["text"]) == F.col("hash")) & F.col(held["doc_id"]).eqNullSafe(F.col("id"))
    return held.back(held.df.join(if_small(written(found, "decon-found"), MAX_KEYS), same, "left_anti"))
