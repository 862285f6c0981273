"""Connected components of an edge table: in one task up to a checked number of edges, by alternating stars beyond."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larkspur.llm.common import remove, written


#: Edges that one task takes, of 16 bytes each; more are never gathered in one place.
FEW = 1_000_000


def _labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that can be reached) by label minima and pointer jumps."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        # the labels' own entries are lowered too, so whole trees move at once
        for i in (x, y, label[x], label[y]):
            np.minimum.at(new, i, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        node, label = _labels(table["a"].to_numpy(), table["b"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], ["node", "component"])

    return edges.repartition(1).mapInArrow(run, "node long, component long")


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node go to the smallest node next to it."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them; edges point from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = edges.join(least, "a")
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b"))).where("a <> b")


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b): component is the smallest node that can be reached.

    Minima are summed up in each task first, and joins back to a node with very many edges are split by adaptive
    execution. Every round is written to the shared folder, so its lineage is one round long.
    """
    spark = links.sparkSession
    pair = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = written(links.where("a <> b").select(*pair).distinct(), "cc-edges")
    if edges.limit(FEW + 1).count() <= FEW:
        return _in_one_task(edges)
    state = None
    for _ in range(rounds):
        found = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if found.n == 0 or (found.n, found.h) == state:
            break
        state = (found.n, found.h)
        stars = written(_small_star(_large_star(edges).distinct()).distinct(), "cc-edges")
        remove(edges, spark)
        edges = stars
    else:
        raise RuntimeError("components did not settle")
    # each node but the smallest of its component now points at that one
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
