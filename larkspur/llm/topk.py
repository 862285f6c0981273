"""Exact top-k inner-product search with a vector-approximation file.

1. Bounds. Each dimension is cut into ``CELLS`` cells at quantiles of a sample, denser towards its ends (``SAMPLE`` components at most,
   of the first vectors by hash); the outer cells reach to the least and the largest component over all vectors, so every
   vector has a cell, and a few far ones widen the outer cells only. Of a length that the sample lacks, cells are of equal
   width.
2. Approximation file. One byte a dimension, written once as a table (vec_id, h1, h2, dims, cells); h1 and h2 are 128
   bits of the exact vector. Rows repeated with id and vector are one; of equal vectors only the k + 1 smallest ids are
   in it, as no other can be among the k best of any query (one may be the query's own).
3. Scan. Queries are taken in blocks of ``block`` rows, each broadcast (so its size is the parameter, not the table's)
   and held against the approximation alone, whose cells bound every score from both sides. A task keeps, for each
   query, the vectors whose upper bound reaches the k-th largest lower bound it has met; over all tasks those are kept
   that reach the k-th largest lower bound of all.
4. Exact vectors, in the order of upper bounds: first those of the k largest bounds of a query; then only those whose
   bound is not below the k-th exact score found so far. With these the k-th result is certain, and no other exact
   vector is read into a product.

Every block's candidates are written to the shared folder before the next block begins, so plans stay small.

Integer scores: components are integers. Products are summed in 64-bit integers where the largest possible sum fits,
else in unbounded ones; a score that 64 bits cannot hold raises an error, as does a component (in ``integer_vectors``).

Defined cases: a vector that is null, empty, or holds a null, NaN or infinite component takes no part; vectors are
compared only with those of as many components; a query never meets rows with its own id; rows repeated with the same
id and vector count once; ties go to the smaller id; a query with fewer than k candidates returns all; vectors of any
length are read whole, each length with bounds of its own (the driver holds a row a length); empty tables give an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from larkspur.llm.common import if_small, new_path, written

#: Cells a dimension; the cell of a component is kept in a byte.
CELLS = 256
#: Vectors, and queries of a block, that a task holds against each other at a time.
ROWS, QUERIES = 4096, 512
#: Candidates of a block up to which they are broadcast to the exact vectors, of 40 bytes each.
FEW = 200_000
#: Components that the cells are cut by (of 16384 vectors at most), and candidates that a task holds before it sends them.
SAMPLE, HELD = 1 << 22, 1_000_000
RESULT = "query_id long, rank int, vec_id long, score long"
FOUND = "query_id long, q1 long, q2 long, vec_id long, h1 long, h2 long, lower double, upper double"


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component; rows that take no part are gone."""
    x, inf = F.col(embedding), F.lit(float("inf"))
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < inf))
    too_large = F.raise_error(F.concat(F.lit("a component of vector "), F.col(vec_id).cast("string"), F.lit(" is beyond 64 bits"))).cast("long")
    whole = F.transform(x, lambda c: F.when(F.abs(c.cast("double") * scale) >= 2.0**63, too_large).otherwise(F.floor(c.cast("double") * scale)))
    return vectors.where(F.col(vec_id).isNotNull() & usable).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of each value of the column dims."""
    size = batch.column("dims").to_numpy(zero_copy_only=False)
    for dims in np.unique(size).tolist():
        yield dims, batch.filter(pa.array(size == dims))


def _dot(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row, exactly."""
    largest = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * q.shape[1]
    if largest < 2.0**62:
        return np.einsum("ij,ij->i", q, v)
    score = (q.astype(object) * v.astype(object)).sum(1)
    if any(not -(2**63) <= s < 2**63 for s in score):
        raise OverflowError("a score is beyond 64 bits")
    return score.astype(np.int64)


class Cells:
    """The cells of a dimension each: cell c holds the integers from its cut to below the next cell's."""

    def __init__(self, low: np.ndarray, high: np.ndarray, sample: np.ndarray | None = None):
        if sample is None:
            steps = np.arange(1, CELLS) / CELLS
            inner = low.astype(np.float64)[:, None] * (1 - steps) + high.astype(np.float64)[:, None] * steps
            # doubles near the ends of 64 bits round to beyond them
            cuts = np.clip(inner, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
        else:
            # quantiles, and towards both ends ever fewer vectors a cell, so that few share one with far ones
            ordered, n = np.sort(sample, axis=0), len(sample)
            tail = np.minimum(np.r_[0, 2 ** np.arange(max(1, (n // CELLS).bit_length()))], n - 1)
            inner = CELLS - 2 - 2 * len(tail)
            places = np.r_[tail, np.arange(1, inner + 1) * n // (inner + 1), n - 1 - tail[::-1]]
            cuts = np.concatenate([ordered[places], np.minimum(ordered[-1:], 2**63 - 2) + 1]).T
            cuts = np.sort(cuts, axis=1)
        self.cuts = np.clip(cuts, low[:, None], high[:, None])
        # as doubles, what they are off by being part of the bounds' slack; an empty cell's upper end is below its lower one
        lower, upper = (np.concatenate(x, axis=1, dtype=np.float64) for x in ((low[:, None], self.cuts), (self.cuts, high[:, None])))
        upper[:, :-1] -= 1
        self.middle, self.half = (lower + upper) / 2, np.maximum((upper - lower) / 2, 0)

    def of(self, v: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cuts, own, "right") for cuts, own in zip(self.cuts, v.T)], axis=1).astype(np.uint8)

    def around(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The middle of each component's cell, and half its width."""
        d = np.arange(cells.shape[1])
        return self.middle[d, cells], self.half[d, cells]


def cell_bounds(vectors: DataFrame) -> dict[int, Cells]:
    """Cells by the number of components: a row a task and length is merged, a row a length comes back, and the sample."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for dims, own in _by_length(batch):
                v = _matrix(own.column("v"), dims)
                low, high = found.setdefault(dims, [v[0].copy(), v[0].copy()])
                np.minimum(low, v.min(0), out=low)
                np.maximum(high, v.max(0), out=high)
        for dims, (low, high) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([low.tolist()]), pa.array([high.tolist()])], ["dims", "low", "high"])

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(dims, dims, np.int32)), pa.array(np.arange(dims, dtype=np.int32)), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["dims", "d", "low", "high"])

    per = vectors.mapInArrow(ends, "dims int, low array<long>, high array<long>").mapInArrow(flat, "dims int, d int, low long, high long")
    rows = per.groupBy("dims", "d").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow().sort_by([("dims", "ascending"), ("d", "ascending")])
    most = max(16, min(16_384, SAMPLE // max(pc.max(rows["dims"]).as_py() or 1, 1)))
    drawn = vectors.orderBy(F.xxhash64("v"), F.xxhash64(F.lit(1), "v")).limit(most).toArrow()
    out = {}
    for dims in pc.unique(rows["dims"]).to_pylist():
        own, some = rows.filter(pc.equal(rows["dims"], dims)), drawn.filter(pc.equal(drawn["dims"], dims))
        sample = _matrix(some["v"].combine_chunks(), dims) if some.num_rows else None
        out[dims] = Cells(own["low"].to_numpy(), own["high"].to_numpy(), sample)
    return out


def with_hashes(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dims, h1, h2)"""
    return vectors.select("vec_id", "v", F.size("v").alias("dims"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))


def approximation_file(vectors: DataFrame, k: int) -> tuple[DataFrame, dict[int, Cells]]:
    """(vec_id, h1, h2, dims, cells binary) as a written table, and what its cells stand for. ``vectors``: with_hashes."""
    bounds = cell_bounds(vectors.select("v", "dims"))
    shared = vectors.sparkSession.sparkContext.broadcast(bounds)

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "h1", "h2", "dims", "cells"]
        for batch in batches:
            for dims, own in _by_length(batch):
                cells = shared.value[dims].of(_matrix(own.column("v"), dims))
                offsets = (np.arange(len(cells) + 1) * dims).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(cells), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(cells))])
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names[:4]), packed], names)

    rows = vectors.mapInArrow(quantise, "vec_id long, h1 long, h2 long, dims int, cells binary").dropDuplicates(["vec_id", "h1", "h2"])
    # each task first keeps its own k + 1 smallest, so a vector of any number of copies is no large group
    smallest = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    rows = rows.withColumn("nth", smallest).where(F.col("nth") <= k + 1).drop("nth")
    return written(rows, "topk-cells"), bounds


class Scan:
    """The candidates of a block of queries among the vectors of a task, by the bounds of their cells."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, cells: Cells, k: int):
        self.ids, self.q, self.cells, self.k = ids, q.astype(np.float64), cells, k
        self.size = np.abs(self.q)
        self.best = np.full((len(ids), k), -np.inf)  # the k largest lower bounds so far
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: np.ndarray, h1: np.ndarray, h2: np.ndarray, cells: np.ndarray) -> None:
        middle, half = self.cells.around(cells)
        largest = np.abs(middle).max(0)
        for i in range(0, len(self.ids), QUERIES):
            some = slice(i, i + QUERIES)
            score = self.q[some] @ middle.T
            # the bound of the cells, and what sums of doubles may be off by
            slack = self.size[some] @ half.T + 1e-10 * (1 + self.size[some] @ largest)[:, None]
            score[self.ids[some, None] == ids[None, :]] = -np.inf
            lower = score - slack
            top = lower if lower.shape[1] <= self.k else np.partition(lower, -self.k, axis=1)[:, -self.k :]
            self.best[some] = np.partition(np.concatenate([self.best[some], top], axis=1), -self.k, axis=1)[:, -self.k :]
            row, col = np.nonzero((score + slack >= self.best[some].min(1)[:, None]) & (score > -np.inf))
            self.parts.append((row + i, ids[col], h1[col], h2[col], lower[row, col], score[row, col] + slack[row, col]))

    def taken(self, most: int) -> tuple[np.ndarray, ...] | None:
        """What is held, by the bounds so far, if it is more than ``most``; it is then no longer held."""
        if sum(len(p[0]) for p in self.parts) <= most:
            return None
        out = [np.concatenate(x) for x in zip(*self.parts)]
        good = out[5] >= self.best.min(1)[out[0]]
        out = tuple(x[good] for x in out)
        self.parts = [out] if len(out[0]) <= most // 2 and most else []
        return None if self.parts else out


def candidates(cells: DataFrame, bounds: dict[int, Cells], block: pa.Table, k: int) -> DataFrame:
    """(query_id, q1, q2, vec_id, h1, h2, lower, upper): what the approximation leaves for the queries of a block."""
    held = {}
    for dims in set(block["dims"].to_pylist()) & bounds.keys():
        own = block.filter(pc.equal(block["dims"], dims))
        held[dims] = (*(own[c].to_numpy() for c in ("vec_id", "h1", "h2")), _matrix(own["v"].combine_chunks(), dims))
    shared = cells.sparkSession.sparkContext.broadcast((held, bounds))

    def rows(queries: tuple, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        row, *rest = found
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*(c[row] for c in queries[:3]), *rest)], [x.split()[0] for x in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, of = shared.value
        scans = {dims: Scan(ids, q, of[dims], k) for dims, (ids, _, _, q) in queries.items()}
        for batch in batches:
            for dims, own in _by_length(batch):
                for i in range(0, own.num_rows if dims in scans else 0, ROWS):
                    some = own.slice(i, ROWS)
                    raw = np.frombuffer(b"".join(some.column("cells").to_pylist()), np.uint8).reshape(-1, dims)
                    scans[dims].add(*(some.column(c).to_numpy() for c in ("vec_id", "h1", "h2")), raw)
                    # what is sent early is held against the bounds of all tasks below
                    if (found := scans[dims].taken(HELD)) is not None:
                        yield rows(queries[dims], found)
        for dims, scan in scans.items():
            if (found := scan.taken(0)) is not None:
                yield rows(queries[dims], found)

    found = cells.mapInArrow(run, FOUND)
    # the k-th largest lower bound of a query is reached by k vectors, so what stays below it cannot count
    query = Window.partitionBy("query_id", "q1", "q2")
    bar = F.nth_value("lower", k).over(query.orderBy(F.desc("lower")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return found.withColumn("bar", bar).where(F.col("bar").isNull() | (F.col("upper") >= F.col("bar"))).drop("bar", "lower")


def _exact(wanted: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, q1, q2, vec_id, score) of the pairs, from the exact vectors."""

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "q1", "q2", "vec_id"]
        for batch in batches:
            for dims, own in _by_length(batch):
                score = _dot(_matrix(own.column("q"), dims), _matrix(own.column("v"), dims))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), pa.array(score)], [*names, "score"])

    met = vectors.join(if_small(wanted, FEW), ["vec_id", "h1", "h2"]).dropDuplicates(["query_id", "q1", "q2", "vec_id", "h1", "h2"])
    return met.join(queries.select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("v").alias("q")), ["query_id", "q1", "q2"]).mapInArrow(dots, "query_id long, q1 long, q2 long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of each query; both of (vec_id, v array<long>).

    A query that is there with several vectors has k results with each, ranked together and cut to k.
    """
    spark = vectors.sparkSession
    queries = written(with_hashes(queries).dropDuplicates(["vec_id", "h1", "h2"]), "topk-queries")
    n = queries.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    vectors = with_hashes(vectors)
    cells, bounds = approximation_file(vectors, k)
    # hash parts of the queries: about block rows each, so what is broadcast does not grow with the table
    parts = -(-n // block)
    part = F.pmod(F.xxhash64("vec_id", "h1"), F.lit(parts))
    path = new_path(spark, "topk-candidates")
    for p in range(parts):
        candidates(cells, bounds, queries.where(part == p).toArrow(), k).write.mode("append").parquet(path)
    found = spark.read.schema(", ".join(x for x in FOUND.split(", ") if not x.startswith("lower"))).parquet(path)

    query = Window.partitionBy("query_id", "q1", "q2")
    ordered = written(found.withColumn("at", F.row_number().over(query.orderBy(F.desc("upper"), "vec_id", "h1"))), "topk-ordered")
    first = written(_exact(ordered.where(F.col("at") <= k), vectors, queries), "topk-first")
    bar = first.groupBy("query_id", "q1", "q2").agg(F.count("*").alias("n"), F.min("score").alias("bar"))
    rest = ordered.where(F.col("at") > k).join(bar, ["query_id", "q1", "q2"]).where((F.col("n") < k) | (F.col("upper") >= F.col("bar")))
    rest = written(rest.drop("n", "bar"), "topk-rest")
    every = first.unionByName(_exact(rest, vectors, queries)).select("query_id", "vec_id", "score").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
