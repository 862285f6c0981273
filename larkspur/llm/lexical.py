"""Exact ranked lexical search by Fagin's threshold algorithm, over an index that is divided by documents.

1. Forward index, a table: of each document its length and, for the terms of the stated queries, their numbers and
   counts. One pass over the texts; queries are taken in blocks of ``BLOCK`` terms about, so what is broadcast is bounded.
2. Corpus statistics over all documents: how many have terms, how many terms they have, in how many each term is.
3. Search. A task takes its documents a few thousand at a time (as many as ``CELLS`` cells of the forward index allow),
   sorts each term's postings by impact, and answers every query by the threshold algorithm: the query's lists are read
   from the top in step, ``FIRST`` places and then twice as many each time; each document met for the first time is looked up in the forward index,
   which gives its full score at once; the threshold is the sum of the impacts at the places reached, which no document
   not yet met can exceed. A list set is left when the threshold is strictly below the k-th best score so far. The best
   of a task's earlier documents count for its later ones, so these are left early.
4. The k best of every task are ranked together; each task sends k rows a query at most.

Scores are whole numbers: a term's weight is floor(1000 * ln((2N + 2) / (2df + 1))), and it counts
(10**9 * tf) div (1000 * tf + 20 * m), where m = 100 - 50 + (50 * n * N) div L. Hashes of 64 bits stand for terms.

Defined cases: a document with a null text, or with no terms, has no score and counts nowhere; rows repeated with an id
are ranked each; a null id comes after all others of its score; rows with one item_id are one query with the terms of
all, null being an id too; an item without terms, or with terms that no document has, has no results; equal scores go by
the smaller id; texts of any length are read whole; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from larkspur.llm import textops as tx
from larkspur.llm.common import new_path, remove, written

#: Distinct terms of the queries of a block, about; a query is never divided.
BLOCK = 1 << 16
#: Cells of the forward index (documents times terms, 4 bytes each) that a task holds at a time, and documents at most.
CELLS, DOCUMENTS = 1 << 23, 4096
#: Places of the lists that are read before the first look at the threshold; each further look is at twice the depth.
FIRST = 16
RESULT = "item_id long, doc_id long, score long"


def terms_of(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, terms): the distinct terms of each item that has some, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tx.pieces(batch.column(1)):
                w = tx.words(data, offsets, tx.SIGNS, lower=True)
                row = w.row()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + row)), pa.array(w.hash.view(np.int64))], ["item_id", "term"])

    return items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).mapInArrow(run, "item_id long, term long").distinct().groupBy("item_id").agg(F.collect_list("term").alias("terms"))


def forward_index(docs: DataFrame, terms: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, counts) as a written table: of each document with terms its length, and the places in ``terms``
    (sorted hashes) of those it has, as 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for a, b, data, offsets in tx.pieces(batch.column(1)):
                w = tx.words(data, offsets, tx.SIGNS, lower=True)
                at = np.searchsorted(known, w.hash)
                held = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == w.hash) if len(known) else np.zeros(0, np.int64)
                pair, count = np.unique(w.row()[held] * len(known) + at[held], return_counts=True)
                row, term = np.divmod(pair, max(len(known), 1))
                some = np.flatnonzero(w.counts)
                cut = np.searchsorted(row, np.r_[some, len(w.counts)]) * 4
                packed = [pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(x.astype(np.int32))]) for x in (term, np.minimum(count, 2**31 - 1))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + some)), pa.array(w.counts[some]), *packed], ["doc_id", "n", "terms", "counts"])

    return written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, terms binary, counts binary"), "lexical-forward")


def document_counts(forward: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term is: a row a task and term is added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    rows = forward.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(n_terms, np.int64)
    out[rows["term"].to_numpy()] = rows["df"].to_numpy()
    return out


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores, self.ids = k, [np.zeros(0, np.int64)] * queries, [np.zeros(0, np.int64)] * queries

    def bar(self, query: int) -> int:
        """The k-th score, or 0, which counts as no result."""
        return int(self.scores[query][-1]) if len(self.scores[query]) == self.k else 0

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores > 0
        scores, ids = np.r_[self.scores[query], scores[good]], np.r_[self.ids[query], ids[good]]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[query], self.ids[query] = scores[order], ids[order]


class Part:
    """Some documents' forward index, and their postings in the order of impact."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray):
        self.ids, self.weights = ids, weights
        share = (10**9 * tf) // (1000 * tf + 20 * m[row])  # below 10**6
        self.forward = np.zeros((len(ids), len(weights)), np.int32)
        self.forward[row, term] = share
        # of a term the weight is the same, so the order of shares is that of impacts
        order = np.lexsort((-share, term))
        self.docs, self.shares = row[order], share[order]
        self.first = np.searchsorted(term[order], np.arange(len(weights) + 1))

    def search(self, query: int, terms: np.ndarray, best: Best) -> int:
        """The threshold algorithm for one query; gives the places it read."""
        weights, first, size = self.weights[terms], self.first[terms], np.diff(self.first)[terms]
        met, depth, read = np.zeros(len(self.ids), bool), 0, 0
        while depth < size.max(initial=0):
            to = 2 * depth or FIRST
            n = np.maximum(np.minimum(to, size) - depth, 0)
            places = np.repeat(first + depth - (np.cumsum(n) - n), n) + np.arange(n.sum())
            new = np.unique(self.docs[places])
            new = new[~met[new]]
            met[new] = True
            best.add(query, self.forward[np.ix_(new, terms)].astype(np.int64) @ weights, self.ids[new])
            read += len(places)
            depth = to
            # the impact at the last place read, nothing where a list has ended
            last = np.where(size > depth, self.shares[np.minimum(first + depth - 1, len(self.shares) - 1)], 0)
            if int(last @ weights) < best.bar(query):
                break
        return read


def _parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Runs of ``rows`` rows of a task."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            some = batch.slice(0, rows - n)
            held.append(some)
            n += some.num_rows
            batch = batch.slice(some.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def search(forward: DataFrame, queries: list[tuple[int | None, np.ndarray]], weights: np.ndarray, n_docs: int, n_words: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): the k best of every task for each query (item_id, places of its terms)."""
    shared = forward.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, held = shared.value
        best, last = Best(len(asked), k), np.iinfo(np.int64).max
        for part in _parts(batches, max(1, min(DOCUMENTS, CELLS // max(len(held), 1)))):
            ids = part["doc_id"].fill_null(last).to_numpy()
            m = np.array([100 - 50 + 50 * n * n_docs // n_words for n in part["n"].to_pylist()], np.int64)
            packed = [part[c].to_pylist() for c in ("terms", "counts")]
            term, tf = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in packed)
            row = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in packed[0]])
            index = Part(ids, m, row, term, tf, held)
            for query, (_, terms) in enumerate(asked):
                index.search(query, terms, best)
        for query, (item, _) in enumerate(asked):
            ids = best.ids[query]
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int64()), pa.array(ids, mask=ids == last), pa.array(best.scores[query])], ["item_id", "doc_id", "score"])

    return forward.mapInArrow(run, RESULT)


def rank(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    queries = written(terms_of(items, item_id, text), "lexical-queries")
    n = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks, path = -(-n // BLOCK), new_path(spark, "lexical-found")
    spark.createDataFrame([], RESULT).write.parquet(path)
    for block in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        if not asked.num_rows:
            continue
        sizes = [len(x) for x in asked["terms"]]
        terms, at = np.unique(np.concatenate(asked["terms"].to_numpy()).view(tx.U), return_inverse=True)
        forward = forward_index(docs, terms, doc_id, text)
        totals = forward.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
        if totals.docs:
            df = document_counts(forward, len(terms))
            weights = np.array([math.floor(1000 * math.log((2 * totals.docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
            held = list(zip(asked["item_id"].to_pylist(), np.split(at, np.cumsum(sizes)[:-1])))
            search(forward, held, weights, totals.docs, totals.words, k).write.mode("append").parquet(path)
        remove(forward, spark)
    remove(queries, spark)
    every = spark.read.schema(RESULT).parquet(path)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
