"""Jaccard self-join of documents on word n-grams, with adaptive multi-match prefixes.

A document's set holds the distinct hashes (64 bits) of its runs of ``k`` words; two documents link when their sets'
Jaccard similarity is ``share`` or more. Exact up to hash collisions; no pair is dropped for its cost.

1. Counts. Every n-gram of every text is counted in one of up to 2**28 cells; a bit a cell says whether it was met
   twice, coarser bits whether a cell was met over 16 and over 256 times. The sketch fixes one order for all documents,
   rare classes first, then by hash. It can misjudge how frequent an n-gram is, which costs time and never a result.
2. Prefixes. A set of n with o = ceil(share * n) has the prefix n - o + l: two sets that link share l tokens of their
   l-prefixes. Each document takes the l from 1 to ``LONGEST`` with the least estimated cost: its prefix rows, plus the
   partners that the classes of its prefix tokens let expect, over l. A pair must share as many prefix tokens as the
   smaller l of its two documents. Tokens met once are left out, as they meet nobody.
3. Equal sets are one class, known by its smallest doc_id; only that goes on, so copies never meet each other.
4. Stars. In token buckets of more than ``SMALL`` documents, one is held against the others, twice: first the one that
   shares most of its set, then one drawn by hash; verified links are made components. Then all buckets emit the pairs
   of different components only. Prefix tokens that no other class has bound what a set can share, and pairs whose
   bounds are below the overlap they need are not emitted. A large group of near copies so costs about its size: what
   the stars connect needs no further pair, and what is too far from the others is bounded out.
   They are made at early tokens only: of the prefix tokens that a pair must share, the first has the others behind it
   in both prefixes.
5. Pairs must be within the length bounds, and the prefix tokens they share with all that lies beyond the prefixes must
   reach the overlap that their sizes ask for. They are verified on the full sets, made anew from the texts of the
   documents in pairs.

Defined cases: a null or blank text has an empty set, links with nothing and is its own component; fewer than k words
are one token; very long texts are read to the end; rows with the same doc_id are one document with several sets, which
links where any of them does, so all its rows have one component (repeated rows are just repeated in the result); rows
with a null doc_id come back with a null component and link with nothing; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.llm import textops as tx
from larkspur.llm.common import Carried, bit, bits_of, if_small, release, remove, small_batches, written
from larkspur.llm.components import components
from larkspur.llm.sketch import merged_levels

#: Documents in a bucket up to which all its pairs are held against each other at once.
SMALL = 16
LONGEST = 8
#: Rounds of stars before all pairs of different components.
STARS = 2
#: Partners that a prefix token of each class lets expect.
PARTNERS = np.array([0.0, 32.0, 1024.0])
#: The cost of verifying a pair, in prefix rows.
VERIFY = 4.0
#: Rows of a token, and documents that go, up to which they are broadcast.
FEW, GONE = 200_000, 1_000_000
#: Coarser bits stand for so many cells.
FOLD = 4


class Similarity:
    """At least num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, n):
        """What a set of n must share with any that it links with."""
        return -(-self.num * n // self.den)

    def need(self, n: Column) -> Column:
        return F.ceil(n * self.num / self.den - 1e-9)

    def shared(self, a: Column, b: Column) -> Column:
        """What sets of a and b must share to link."""
        return F.ceil((a + b) * self.num / (self.num + self.den) - 1e-9)

    def lengths(self, a: Column, b: Column) -> Column:
        return (F.least(a, b) * self.den) >= (F.greatest(a, b) * self.num)


def shingles(w: tx.Words, k: int) -> list[np.ndarray]:
    """The sorted distinct tokens of each text."""
    g, n = tx.grams(w.hash, w.first, k)
    cut = np.r_[0, np.cumsum(n)]
    out = []
    for i, words in enumerate(w.counts):
        if n[i]:
            out.append(np.unique(g[cut[i] : cut[i + 1]]))
        elif words:
            out.append(tx.grams(w.hash[w.first[i] : w.first[i + 1]], np.array([0, words]), int(words), salt=3)[0])
        else:
            out.append(np.zeros(0, tx.U))
    return out


def token_classes(docs: DataFrame, k: int, width: int) -> list[np.ndarray]:
    """Packed bits of 2**width cells: met twice; and, FOLD cells a bit, met over 16 and over 256 times."""
    shift = tx.U(64 - width)

    def cells(column: pa.Array) -> Iterator[np.ndarray]:
        for _, _, data, offsets in tx.pieces(column):
            w = tx.words(data, offsets, lower=True)
            g, n = tx.grams(w.hash, w.first, k)
            short = [s for s in (shingles(_only(w, i), k)[0] for i in np.flatnonzero((n == 0) & (w.counts > 0))) if len(s)]
            yield (np.concatenate([g, *short]) >> shift).astype(np.uint32)

    return merged_levels(docs, cells, width, [(2, 1), (17, FOLD), (257, FOLD)])


def _only(w: tx.Words, i: int) -> tx.Words:
    a, b = w.first[i], w.first[i + 1]
    return tx.Words(w.data, w.offsets[i : i + 2], w.start[a:b], w.end[a:b], np.array([0, b - a]), w.hash[a:b], w.sums)


def chosen_prefix(tokens: np.ndarray, classes: np.ndarray, sim: Similarity) -> tuple[np.ndarray, int]:
    """Places of the prefix in a sorted set, and its l."""
    n = len(tokens)
    need = int(sim.overlap(n))
    order = np.argsort(classes, kind="stable")
    base, most = n - need + 1, min(LONGEST, need)
    longest = order[: base + most - 1]
    if not classes[longest[:base]].any():
        return order[:base], 1
    partners = np.cumsum(PARTNERS[classes[longest]])[base - 1 :]
    l = np.arange(1, most + 1)
    best = int(np.argmin((base + l - 1) + VERIFY * partners / l)) + 1
    return order[: base + best - 1], best


def prefixes(docs: DataFrame, k: int, sim: Similarity, width: int) -> DataFrame:
    """(doc_id, n, s1, s2, l, prefix) of each row; s1 and s2 are a 128-bit signature of the set."""
    shared = docs.sparkSession.sparkContext.broadcast(token_classes(docs, k, width))
    shift, fold = tx.U(64 - width), FOLD.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, many, most = shared.value
        for batch in batches:
            for a, b, data, offsets in tx.pieces(batch.column(1)):
                sets = shingles(tx.words(data, offsets, lower=True), k)
                size = np.array([len(s) for s in sets])
                flat = np.concatenate(sets)
                cell = (flat >> shift).astype(np.int64)
                classes = (bit(many, cell >> fold) + bit(most, cell >> fold)).astype(np.int8)
                live = bit(twice, cell).astype(bool)
                cut = np.r_[0, np.cumsum(size)]
                some, some_n, l = [], [], []
                for i, s in enumerate(sets):
                    if not len(s):
                        some_n.append(0)
                        l.append(1)
                        continue
                    at, best = chosen_prefix(s, classes[cut[i] : cut[i + 1]], sim)
                    at = at[live[cut[i] + at]]
                    some.append(s[at])
                    some_n.append(len(at))
                    l.append(best)
                tokens = np.concatenate(some).view(np.int64) if some else np.zeros(0, np.int64)
                signs = []
                for salt in (1, 2):
                    sums = np.r_[tx.U(0), np.cumsum(tx.mix(flat, salt), dtype=tx.U)]
                    signs.append(pa.array((sums[cut[1:]] - sums[cut[:-1]]).view(np.int64)))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(some_n)].astype(np.int32)), pa.array(tokens))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size.astype(np.int32)), *signs, pa.array(np.array(l, np.int8)), lists], ["doc_id", "n", "s1", "s2", "l", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, s1 long, s2 long, l byte, prefix array<long>")


def verified(docs: DataFrame, pairs: DataFrame, k: int, sim: Similarity, n_docs: int) -> DataFrame:
    """The (a, b) of ``pairs`` that link. Sets are made anew, from the texts of documents in pairs only."""
    spark = docs.sparkSession
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    width = min(28, max(15, (8 * n_docs).bit_length()))
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(1 << width))
    # 2**width bits, 32 MB at most: they spare most other texts; what they let through in error meets no pair
    shared = spark.sparkContext.broadcast(bits_of(ids.select(cell.alias("cell")), "cell", width))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            own = batch.filter(pa.array(bit(bits, batch.column(2).to_numpy()).astype(bool)))
            for a, b, data, offsets in tx.pieces(own.column(1)):
                sets = shingles(tx.words(data, offsets, lower=True), k)
                cut = np.r_[0, np.cumsum([len(s) for s in sets])]
                flat = np.concatenate(sets).view(np.int64)
                packed = pa.Array.from_buffers(pa.large_binary(), len(sets), [None, pa.py_buffer((cut * 8).astype(np.int64)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([own.column(0).slice(a, b - a), packed.cast(pa.binary())], ["doc_id", "tokens"])

    chosen = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", cell.alias("cell")).mapInArrow(select, "doc_id long, tokens binary")
    sets = written(chosen, "join-sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                good[i] = sim.den * shared >= sim.num * (len(x) + len(y) - shared) and shared > 0
            yield batch.select([0, 1]).filter(pa.array(good))

    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    out = written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct(), "join-links")
    remove(sets, spark)
    release(spark)
    return out


def labelled(shared: DataFrame, known: DataFrame | None) -> DataFrame:
    """With the component of each document so far; its own id where no link is known."""
    if known is None:
        return shared.withColumn("component", F.col("doc_id"))
    found = shared.join(known.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return found.withColumn("component", F.coalesce("component", "doc_id"))


def join(docs: DataFrame, k: int = 5, share: tuple[int, int] = (4, 5), max_width: int = 28) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    sim = Similarity(*share)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("n")).first()
    width = min(max_width, max(20, (int(size.bytes or 0) // 4).bit_length()))
    sets = written(prefixes(docs, k, sim, width), "join-prefixes")
    real = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(real.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")), "join-classes")
    reps = real.join(classes.select(F.col("rep").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"], "left_semi").dropDuplicates(["doc_id", "s1", "s2"])
    postings = written(reps.select("doc_id", "n", "l", F.posexplode("prefix").alias("at", "token")), "join-postings")
    # rows of a token are counted and written first, so the joins back are ones that adaptive execution can split
    buckets = written(postings.groupBy("token").agg(F.count("*").alias("k")).where("k > 1"), "join-buckets")
    shared = postings.join(if_small(buckets, FEW), "token")
    # prefix tokens that no other class has can be in no overlap: what is left of a set bounds it
    own = Window.partitionBy("doc_id", "n", "l")
    shared = shared.withColumn("live", F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("at", "token")))
    shared = written(shared.drop("at").withColumn("most", sim.need(F.col("n")) - F.col("l") + F.col("live")), "join-shared")
    remove(postings, spark)
    release(spark)

    def can_link(x: str, y: str) -> Column:
        """By length, and by the overlap that both sets can reach at most."""
        n = F.col(f"{x}n"), F.col(f"{y}n")
        return sim.lengths(*n) & (F.least(f"{x}most", f"{y}most") >= sim.shared(*n))

    # a doc_id with several sets links the classes of all of them
    several = real.groupBy("doc_id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo < hi").select("doc_id")
    links = real.join(several, "doc_id").join(classes, ["s1", "s2", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    links, known = written(links, "join-links"), None
    for step in range(STARS):
        # one member of each large bucket against the others, in four large buckets of each document: first the one
        # whose set the other documents share most of, as the original of copies, then one drawn by hash
        large = labelled(shared, known).where(F.col("k") > SMALL)
        order = F.struct((F.col("most") / F.col("n")).alias("a"), F.xxhash64("doc_id").alias("b")) if not step else F.struct(F.xxhash64("doc_id", "token").alias("b"))
        drawn = large.groupBy("token").agg(F.max_by(F.struct("doc_id", "n", "most", "component"), order).alias("r"))
        drawn = drawn.select("token", *(F.col(f"r.{c}").alias(f"r_{c}") for c in ("doc_id", "n", "most", "component")))
        drawn = written(drawn, "join-drawn")
        few = large.groupBy("doc_id").agg(*(F.min_by("token", F.xxhash64("token", F.lit(4 * step + i))).alias(f"t{i}") for i in range(4)))
        mine = large.join(few, "doc_id").where("token IN (t0, t1, t2, t3)")
        stars = mine.join(if_small(drawn, FEW), "token").where((F.col("component") != F.col("r_component")) & can_link("", "r_"))
        stars = written(stars.select(F.least("doc_id", "r_doc_id").alias("a"), F.greatest("doc_id", "r_doc_id").alias("b")).distinct(), "join-stars")
        found = verified(docs, stars, k, sim, size.n)
        remove(drawn, spark)
        remove(stars, spark)
        links = links.unionByName(found)
        known = written(components(links), "join-known")

    # all buckets: the pairs of different components that share enough prefix tokens
    every = written(labelled(shared, known).drop("k"), "join-labelled")
    mixed = every.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    mixed = written(mixed, "join-mixed")
    open_ = written(every.join(if_small(mixed, FEW), "token", "left_semi"), "join-open")
    x, y = (open_.select("token", *(F.col(c).alias(f"{s}_{c}") for c in ("doc_id", "n", "l", "most", "live", "rank", "component"))) for s in "xy")
    # shared tokens not met in the prefixes lie beyond the end of one of them, where a set has need - l + 1 tokens left
    beyond = F.greatest(sim.need(F.col("x_n")) - F.col("x_l"), sim.need(F.col("y_n")) - F.col("y_l")) + 1
    least = F.greatest(F.least("x_l", "y_l"), sim.shared(F.col("x_n"), F.col("y_n")) - beyond)
    # of the tokens that a pair must share, the first leaves the others behind it in both prefixes
    early = (F.col("x_rank") <= F.col("x_live") - least + 1) & (F.col("y_rank") <= F.col("y_live") - least + 1)
    met = x.join(y, "token").where((F.col("x_doc_id") < F.col("y_doc_id")) & (F.col("x_component") != F.col("y_component")) & can_link("x_", "y_") & early)
    met = met.groupBy(F.col("x_doc_id").alias("a"), F.col("y_doc_id").alias("b")).agg(F.min(least).alias("least"))
    tokens = written(every.groupBy("doc_id").agg(F.collect_set("token").alias("tokens")), "join-tokens")  # a document's prefix
    met = met.join(tokens.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta")), "a").join(tokens.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb")), "b")
    pairs = met.where(F.size(F.array_intersect("ta", "tb")) >= F.col("least")).select("a", "b")
    pairs = written(pairs, "join-pairs")
    more = verified(docs, pairs, k, sim, size.n)
    for done in (buckets, shared, every, mixed, open_, tokens, pairs):
        remove(done, spark)
    release(spark)
    found = components(links.unionByName(more)).withColumnRenamed("node", "rep")

    out = sets.join(classes, ["s1", "s2", "n"], "left").join(found, "rep", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each component; of its repeated rows one stays.

    Documents without words link with nothing and stay, as do rows without doc_id. Of rows with one doc_id and different
    texts each text stays, if that doc_id does. Columns of any name are carried along.
    """
    held = Carried(docs)
    doc_id, text = held["doc_id"], held["text"]
    found = written(join(docs.select("doc_id", "text"), k, share).select("doc_id", "component_id"), "join-found")
    gone = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct(), "join-gone")
    # few enough to be sent to all tasks, else by shuffle; rows without doc_id meet none
    kept = held.df.join(if_small(gone, GONE), F.col(doc_id) == F.col("id"), "left_anti")
    twice = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id")
    twice = written(twice, "join-twice")
    if twice.isEmpty():
        return held.back(kept)
    # only rows of a doc_id that is there more than once are compared
    once = kept.join(if_small(twice, GONE), F.col(doc_id) == F.col("id"), "left_anti")
    repeated = kept.join(if_small(twice, GONE), F.col(doc_id) == F.col("id"), "left_semi")
    repeated = repeated.withColumn("hash", F.xxhash64(text)).dropDuplicates([doc_id, "hash"]).drop("hash")
    return held.back(once.unionByName(repeated))
