"""Micro-batches relayed to tables that a restart neither loses nor doubles rows of.

A batch's rows go to a folder of its own number, and a commit file of that number is written beside the rows when all are
there. Spark repeats a batch that was not finished with the same rows and number, so what a stop in the middle has left is
written over. Readers see the rows of committed batches only.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

LOG = logging.getLogger(__name__)
Sink = Callable[[DataFrame, int], None]


def _files(spark: SparkSession, path: str):
    """(file system, path) of a path in any store that Spark writes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


class RelayedTable:
    """A sink, and the table that it has written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def __call__(self, batch: DataFrame, number: int) -> None:
        """Write a batch and commit it. A number that is committed is not written again."""
        done, at = _files(self.spark, f"{self.path}/commits/{number}")
        if done.exists(at):
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/rows/batch={number}")
        done.create(at, True).close()

    def committed(self) -> list[int]:
        """Numbers of the batches, one a micro-batch."""
        files, at = _files(self.spark, f"{self.path}/commits")
        return sorted(int(f.getPath().getName()) for f in files.listStatus(at)) if files.exists(at) else []

    def read(self, schema) -> DataFrame:
        """The rows of all committed batches with the number of theirs."""
        numbers = self.committed()
        if not numbers:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
        paths = [f"{self.path}/rows/batch={n}" for n in numbers]
        rows = self.spark.read.option("basePath", f"{self.path}/rows").schema(schema).parquet(*paths)
        return rows.withColumn("batch", F.col("batch").cast("long"))


def relay(stream: DataFrame, sinks: dict[str, Sink], checkpoint: str, mode: str = "append"):
    """Every batch to every sink. One that fails is logged and gets no more of this run, while the others have the batch;
    what it missed it gets by ``caught_up``, as only its own commits say what it has."""
    live = dict(sinks)

    def send(batch: DataFrame, number: int) -> None:
        # several sinks read the batch's rows once
        kept = batch.persist() if len(live) > 1 else batch
        for name in list(live):
            try:
                live[name](kept, number)
            except Exception:  # the others still get the batch
                LOG.exception("sink %s failed and is dropped", name)
                del live[name]
        if kept.is_cached:
            kept.unpersist()
        if not live:
            raise RuntimeError("no sink is left")

    return stream.writeStream.foreachBatch(send).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def caught_up(behind: RelayedTable, ahead: RelayedTable, schema) -> list[int]:
    """Give a table the batches that another one has and it has not; returns their numbers."""
    missing = sorted(set(ahead.committed()) - set(behind.committed()))
    rows = ahead.read(schema)
    for number in missing:
        behind(rows.where(F.col("batch") == number).drop("batch"), number)
    return missing
