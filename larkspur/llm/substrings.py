"""Substring dedup: words covered by a window that an earlier document holds too are removed.

A window is ``window`` consecutive words. Its anchor is the smallest hash among its runs of ``gram`` words, so equal
windows have equal anchors, and neighbouring windows mostly share one.

1. Count-min: a sketch of ``DEPTH`` rows of cells. Each task counts, per document once, the cells of the anchors it sees,
   one in each row; the sketches of all tasks are added up. The least count of an anchor's cells is never below the
   number of documents that hold one of its windows.
2. Blocks: neighbouring windows with one anchor, of those with a least count of 2 and no others, are one block, grouped
   exactly by 128 bits of all its words. Blocks that a smaller doc_id holds too mark their words.
3. Windows: an anchor with a single block is settled so, as its windows are in no other block. Windows of anchors with
   different blocks (at edits and at the ends of passages) are grouped exactly one by one, by 128 bits of their words;
   the smallest doc_id of each is joined back, and windows of larger ones mark their words.

What is broadcast is one bit a cell, ``max_cells`` at most (2**28, 32 MB), twice; a fuller sketch lets more windows
through to the exact grouping and loses none. Equal blocks and windows are summed up in each task before the shuffle and
written; what is in several documents is joined back by broadcast up to ``FEW`` rows, and beyond by joins that adaptive
execution splits where a window is in very many documents. Texts without a mark are not shuffled.

Defined cases: a null or empty text has no words and stays as it is with kept_text empty; a null doc_id is neither
larger nor smaller, so such rows are kept whole; rows with the same doc_id do not cover each other; a text shorter than
a window is kept; very long texts are read to the end; an empty table gives an empty result; other columns, whatever
their names, are carried along, unless they are named like an output, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from larkspur.llm import textops as tx
from larkspur.llm.common import Carried, bit, bits_of, if_small, release, remove, written
from larkspur.llm.sketch import merged_levels

WINDOW, GRAM = 50, 16
#: Rows of the sketch.
DEPTH = 2
#: Blocks or windows that are in several documents, up to which they are broadcast, of 24 bytes each.
FEW = 200_000


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Of each k consecutive ones."""
    size = 1
    while size * 2 <= k:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (k - size)], x[k - size :]) if k > size else x


def anchors(w: tx.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, anchor) of every window."""
    h, n = tx.grams(w.hash, w.first, gram)
    k = window - gram + 1
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, tx.U)
    lowest = sliding_min(h, k)
    m = np.maximum(n - k + 1, 0)
    row = np.repeat(np.arange(len(n)), m)
    start = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    return row, start, lowest[(np.cumsum(n) - n)[row] + start]


def _cells(anchor: np.ndarray, cells: int) -> np.ndarray:
    return (anchor & tx.U(cells - 1)).astype(np.int64)


def _sketched(anchor: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each anchor in each row of a sketch of 2**width cells."""
    own = width - (DEPTH - 1).bit_length()
    return [(tx.mix(anchor, 11 + r) >> tx.U(64 - own)).astype(np.int64) + (r << own) for r in range(DEPTH)]


def repeated_anchors(docs: DataFrame, width: int, window: int, gram: int) -> np.ndarray:
    """The merged sketch: a bit a cell, packed, set where it counts 2 or more."""

    def cells(column: pa.Array) -> Iterator[np.ndarray]:
        for _, _, data, offsets in tx.pieces(column):
            row, _, anchor = anchors(tx.words(data, offsets), window, gram)
            new = _changes(row, anchor)
            for cell in _sketched(anchor[new], width):
                yield (np.unique(row[new] << 32 | cell) & 0xFFFFFFFF).astype(np.uint32)

    return merged_levels(docs, cells, width, [(2, 1)])[0]


def _repeated(bits: np.ndarray, anchor: np.ndarray, width: int) -> np.ndarray:
    """Whether the least count of an anchor's cells is 2 or more."""
    return np.logical_and.reduce([bit(bits, c) == 1 for c in _sketched(anchor, width)])


def _changes(row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Where a run of windows of one text with one anchor begins."""
    return np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]) if len(row) else row


def _emitted(docs: DataFrame, bits: np.ndarray, window: int, gram: int, width: int, whole: bool) -> DataFrame:
    """(h1, h2, doc_id, tag, start, anchor, size): blocks of anchors that the sketch ``bits`` estimates repeated, or single
    windows of anchors whose one bit is set."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, _, data, offsets in tx.pieces(batch.column(2)):
                w = tx.words(data, offsets)
                row, start, anchor = anchors(w, window, gram)
                if whole:
                    at = _changes(row, anchor)
                    size = np.diff(np.r_[at, len(row)])
                    live = _repeated(shared.value, anchor[at], width)
                    at, size = at[live], size[live]
                else:
                    at = np.flatnonzero(bit(shared.value, _cells(anchor, 1 << width)))
                    size = np.ones(len(at), np.int64)
                first = w.first[row[at]] + start[at]
                columns = [*tx.spans(w.hash, first, window - 1 + size), ids[a + row[at]], tags[a + row[at]], start[at].astype(np.int32), anchor[at].view(np.int64), size.astype(np.int32)]
                for i in range(0, len(at), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], ["h1", "h2", "doc_id", "tag", "start", "anchor", "size"])

    return docs.mapInArrow(emit, "h1 long, h2 long, doc_id long, tag long, start int, anchor long, size int")


def marks(docs: DataFrame, window: int, gram: int, max_cells: int) -> DataFrame:
    """(doc_id, tag, _starts, _sizes): runs of windows that start in a document with a smaller doc_id too."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    # about one anchor in 100 bytes, and 25 cells an anchor where the bound allows it
    width = min(max_cells.bit_length() - 1, max(16, (int(size) // 4).bit_length()))
    tagged = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), _tag("text").alias("tag"), "text")
    blocks = written(_emitted(tagged, repeated_anchors(docs, width, window, gram), window, gram, width, True), "substring-blocks")
    kinds = written(blocks.groupBy("h1", "h2", "anchor").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")), "substring-kinds")
    release(spark)
    repeated = kinds.where("_first < _last").select("h1", "h2", "_first")
    runs = blocks.join(if_small(repeated, FEW), ["h1", "h2"]).where("doc_id > _first").select("doc_id", "tag", "start", "size")
    runs = written(runs, "substring-runs")

    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("n"), F.min("_first").alias("lo"), F.max("_last").alias("hi")).where("n > 1 AND lo < hi")
    cell = F.col("anchor").bitwiseAND((1 << width) - 1)
    open_ = bits_of(mixed.select(cell.alias("cell")), "cell", width)
    release(spark)
    windows = written(_emitted(tagged, open_, window, gram, width, False).drop("anchor", "size"), "substring-windows")
    first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last").drop("_last")
    first = written(first, "substring-firsts")
    single = windows.join(if_small(first, FEW), ["h1", "h2"]).where("doc_id > _first").select("doc_id", "tag", "start", F.lit(1).alias("size"))
    found = runs.unionByName(single).groupBy("doc_id", "tag")
    out = written(found.agg(F.collect_list(F.struct("start", "size")).alias("_runs")), "substring-marks")
    for done in (blocks, kinds, windows, first, runs):
        remove(done, spark)
    release(spark)
    return out.select("doc_id", "tag", F.col("_runs.start").alias("_starts"), F.col("_runs.size").alias("_sizes"))


def _tag(text: str):
    """Tells texts with the same doc_id apart."""
    return F.xxhash64(text)


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, max_cells: int = 1 << 28) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (the words left, one space between)."""
    spark = docs.sparkSession
    held = Carried(docs, ("n_words", "n_removed", "kept_text"))
    kept = held.columns
    found = marks(docs.select("doc_id", "text"), window, gram, max_cells).toDF("doc", "tag", "starts", "sizes")
    keyed = held.df.withColumn("doc", F.col(held["doc_id"]).cast("long")).withColumn("tag", _tag(held["text"]))
    n = found.count()
    width = min(28, max(15, (16 * n).bit_length()))
    cell = F.pmod(F.xxhash64("doc", "tag"), F.lit(1 << width))
    # 2**width bits, 32 MB at most: texts without a bit have no mark and need no join
    shared = spark.sparkContext.broadcast(bits_of(found.select(cell.alias("cell")), "cell", width))
    at, fields = kept.index(held["text"]), [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    schema = T.StructType([*held.df.schema.fields, *fields])

    def cut(batches: Iterator[pa.RecordBatch], marked: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not marked:
                cells = batch.column(len(kept)).to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(bit(shared.value, cells) == 0))
            n_words, n_removed, texts = [], [], []
            for i, text in enumerate(tx.binary(batch.column(at))):
                words = text.as_py().split()
                n_words.append(len(words))
                if marked and (starts := batch.column(len(kept))[i]).is_valid:
                    edges = np.zeros(len(words) + 1, np.int32)
                    start, size = starts.values.to_numpy(), batch.column(len(kept) + 1)[i].values.to_numpy()
                    np.add.at(edges, start, 1)
                    np.add.at(edges, start + size + window - 1, -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                n_removed.append(n_words[-1] - len(words))
                texts.append(b" ".join(words))
            made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], schema.names)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bit(shared.value, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)) == 1))

    keyed = keyed.withColumn("cell", cell)
    plain = keyed.select(*kept, "cell").mapInArrow(lambda batches: cut(batches, False), schema)
    rest = keyed.mapInArrow(marked, keyed.schema).join(found, ["doc", "tag"], "left").select(*kept, "starts", "sizes")
    return held.back(plain.unionByName(rest.mapInArrow(lambda batches: cut(batches, True), schema)), "n_words", "n_removed", "kept_text")
