"""Count sketches: every task counts the cells of its own texts, and the counts of all tasks are added up cell by cell.

A sketch of several rows (count-min) is several runs of cells in one: an item has a cell in each row, and the least of
its counts, never below the truth, is its estimate. It is at least n where all of its cells' counts are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells that are merged and sent together, and cells that a task holds back before it sends them.
SEGMENT, HELD = 1 << 16, 2_000_000


def merged_levels(texts: DataFrame, cells: Callable[[pa.Array], Iterator[np.ndarray]], width: int, levels: list[tuple[int, int]]) -> list[np.ndarray]:
    """For each (least, fold) packed bits, one for ``fold`` neighbouring cells: set where a cell of them counts ``least``.

    cells: numbers below 2**width (uint32), of the texts of an Arrow column, piece by piece. What reaches the driver is
    2**width / fold bits a level, whatever the input.
    """
    spark = texts.sparkSession
    names = [f"level{i}" for i in range(len(levels))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            cell = np.sort(np.concatenate(held))
            segment = cell >> np.uint32(16)
            cuts = np.r_[0, np.flatnonzero(segment[1:] != segment[:-1]) + 1, len(cell)]
            low = (cell & np.uint32(0xFFFF)).astype(np.uint16).tobytes()
            packed = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 2).astype(np.int32)), pa.py_buffer(low)])
            return pa.RecordBatch.from_arrays([pa.array(segment[cuts[:-1]].astype(np.int32)), packed], ["segment", "cells"])

        for batch in batches:
            for found in cells(batch.column(0)):
                held.append(found)
                size += len(found)
                if size > HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                n = np.bincount(np.frombuffer(found.as_buffer(), np.uint16), minlength=SEGMENT)
                old = total.get(segment)
                total[segment] = np.minimum(n if old is None else n + old, 1000).astype(np.uint16)
        for s in sorted(total):
            n = total.pop(s)
            bits = (np.packbits(n.reshape(-1, fold).max(1) >= least, bitorder="little").tobytes() for least, fold in levels)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([b]) for b in bits)], ["segment", *names])

    # 2**width / 2**16 segments, each a dense array once merged, whatever the input
    parts = max(1, min(1 << (width - 16), 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    merged = texts.select("text").mapInArrow(count, "segment int, cells binary").repartition(parts, "segment").mapInArrow(merge, ", ".join(["segment int", *(f"{n} binary" for n in names)]))
    rows = merged.toArrow()
    out = [np.zeros((1 << width) // 8 // fold, np.uint8) for _, fold in levels]
    for segment, *bits in zip(*(rows[c].to_pylist() for c in ("segment", *names))):
        for level, b in zip(out, bits):
            level[segment * len(b) : (segment + 1) * len(b)] = np.frombuffer(b, np.uint8)
    return out
