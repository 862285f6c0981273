"""Toxicity: a factorization machine over hashed terms.

Terms are the words of a whole text (ASCII lower case, every other ASCII sign a gap) and their first 6 and 8 bytes,
each hashed to one of 2**20 numbers and counted once per text. A text's margin is

    bias + sum of w[i] + sum over pairs i < j of <v[i], v[j]>

so pairs of terms that are harmless alone, such as an insult beside the name of a group, can weigh in together.

Fit: on at most ``max_labelled`` labelled rows, the first by a hash of doc_id (the bound is a parameter); of their
terms those that occur in ``min_support`` rows and depend on the label (chi-square) are kept, ``max_terms`` at most.
So what the driver gathers is bounded by the two parameters. Scoring reads every text to its end.

Defined cases: a null or empty text has no terms and scores by the bias; a label of null counts as none; of several
labels of a doc_id the largest counts; labels without doc_id are not learned from, and rows without doc_id are scored like
others; repeated rows are scored alike; very long texts are read to the end; without labels every score is 0.25; an
empty table gives an empty result. Other columns of ``docs``, whatever their names, are carried along unless they are
named like an output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from larkspur.llm import textops as tx
from larkspur.llm.common import Carried, small_batches

BITS = 20
HEADS = (6, 8)


def held_out(doc_id: str = "doc_id"):
    """Rows for testing: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def terms(column: pa.Array, known: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row from, row to, row of each term, term): distinct terms of each text, in order.

    known: the number of each hashed term, -1 for those to leave out.
    """
    shift, mask = tx.U(64 - BITS), (1 << BITS) - 1
    for a, b, data, offsets in tx.pieces(column):
        w = tx.words(data, offsets, tx.SIGNS, lower=True)
        row, found = w.row(), []
        for h in (w.hash, *(w.head_hash(n) for n in HEADS)):
            at = (h >> shift).astype(np.int64)
            here = row
            if known is not None:
                at = known[at]
                here, at = row[at >= 0], at[at >= 0]
            found.append(here << BITS | at)
        key = np.unique(np.concatenate(found))
        yield a, b, key >> BITS, key & mask


@dataclass
class FactorizationMachine:
    """known: of each hashed term its place in w and v, -1 if it has none."""

    known: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, n: int, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        if not len(term):
            return np.full(n, self.bias)
        out = self.bias + np.bincount(row, self.w[term], n)
        for f in range(self.v.shape[1]):
            v = self.v[term, f]
            out += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return out

    @staticmethod
    def trained(known: np.ndarray, size: int, rows: list[np.ndarray], y: np.ndarray, factors: int, epochs: int, seed: int) -> FactorizationMachine:
        """AdaGrad on the logistic loss, one row at a time in the order given."""
        rng = np.random.default_rng(seed)
        w, v = np.zeros(size), rng.standard_normal((size, factors)) * 0.01
        gw, gv, gb = np.full(size, 1e-6), np.full((size, factors), 1e-6), 1e-6
        bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5)))
        for _ in range(epochs if len(y) else 0):
            for d in rng.permutation(len(y)):
                f = rows[d]
                vf = v[f]
                s = vf.sum(0)
                z = bias + w[f].sum() + 0.5 * ((s * s).sum() - (vf * vf).sum())
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[d]
                dw, dv = g + 1e-6 * w[f], g * (s - vf) + 1e-6 * vf
                gw[f] += dw * dw
                w[f] -= 0.1 * dw / np.sqrt(gw[f])
                gv[f] += dv * dv
                v[f] -= 0.05 * dv / np.sqrt(gv[f])
                gb += g * g
                bias -= 0.1 * g / np.sqrt(gb)
        return FactorizationMachine(known, float(bias), w, v)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    max_labelled: int = 20_000,
    min_support: int = 5,
    min_chi2: float = 12.0,
    max_terms: int = 1 << 14,
    factors: int = 8,
    epochs: int = 4,
    seed: int = 7,
) -> FactorizationMachine:
    """Learn ``label`` from the labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    order = F.xxhash64("doc_id", F.lit(seed))
    rows = (
        labels.where(F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("_y"))
        .orderBy(order, "doc_id")
        .limit(max_labelled)
        .collect()
    )
    spark = docs.sparkSession
    sample = spark.createDataFrame([(r.doc_id, r._y) for r in rows], "doc_id long, _y int")
    # max_labelled rows at most, hence the broadcast
    train = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "_y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << BITS
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            y = batch.column(2).to_numpy(zero_copy_only=False)
            for a, _, row, term in terms(batch.column(1)):
                for label in (0, 1):
                    total[label] += np.bincount(term[(y[a + row] > 0) == label], minlength=size)
        at = np.flatnonzero(total.any(0))
        for i in range(0, len(at), 50_000):
            part = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[0, part]), pa.array(total[1, part])], ["term", "no", "yes"])

    n_yes, n = sum(r._y > 0 for r in rows), max(len(rows), 1)
    both, share = F.col("no") + F.col("yes"), n_yes / n
    e1, e0 = F.greatest(both * share, F.lit(1e-9)), F.greatest(both * (1 - share), F.lit(1e-9))
    chi2 = (F.col("yes") - e1) ** 2 / e1 + (F.col("no") - e0) ** 2 / e0
    kept = (
        train.mapInArrow(count, "term int, no long, yes long")
        .groupBy("term")
        .agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
        .where((both >= min_support) & (chi2 >= min_chi2))
        .orderBy(chi2.desc(), "term")
        .limit(max_terms)
        .collect()
    )
    known = np.full(1 << BITS, -1, np.int32)
    for i, r in enumerate(sorted(kept, key=lambda r: r.term)):
        known[r.term] = i
    shared = spark.sparkContext.broadcast(known)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, term in terms(batch.column(1), shared.value):
                cuts = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.ListArray.from_arrays(cuts, pa.array(term, pa.int32()))],
                    ["doc_id", "_y", "terms"],
                )

    # max_labelled rows of max_terms numbers at most, however often a doc_id is repeated
    found = train.mapInArrow(gather, "doc_id long, _y int, terms array<int>").orderBy(order, "doc_id", F.xxhash64("terms")).limit(max_labelled).collect()
    y = np.array([float(r._y > 0) for r in found])
    return FactorizationMachine.trained(known, len(kept), [np.array(r.terms, np.int64) for r in found], y, factors, epochs, seed)


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.5 at least)."""
    small_batches(docs.sparkSession)
    held = Carried(docs, ("score", "predicted"))
    at, shared = held.columns.index(held["text"]), docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*held.df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.concatenate([fm.margins(b - a, row, term) for a, b, row, term in terms(batch.column(at), fm.known)])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema.names)

    return held.back(held.df.mapInArrow(run, schema), "score", "predicted")
