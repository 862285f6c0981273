"""A channel: messages numbered as they are published, to be read from any number on, as often as wanted.

A channel is a folder. Messages lie in segments of a fixed number of them, as lines of JSON with their number; a head file,
put in place when all lines of a publication are there, says what the next number will be. Readers keep their place
themselves, as an offset in a query's checkpoint, so a channel has any number of them and none loses what it was not
connected for.

``register`` makes the format ``channel`` known: ``spark.readStream.format("channel").option("path", ...)`` with
``startingOffset`` (0 by default, or ``latest``). A task reads one segment. The folder has to be one that the executors'
Python reaches (a shared mount, or a store that Arrow has a file system for).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from larkspur.operators.numbering import numbered

SEGMENT = 10_000
SCHEMA = "offset long, value string"


def _reached(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def head(path: str) -> int:
    """The number that the next message will have."""
    files, at = _reached(path)
    if files.get_file_info(f"{at}/head").type == fs.FileType.NotFound:
        return 0
    with files.open_input_stream(f"{at}/head") as stream:
        return int(stream.read())


def publish(rows: DataFrame, path: str, order: str) -> int:
    """Add a message a row, its columns as JSON, numbered by ``order``; returns the next number. One publisher at a time;
    lines that one left without a head are written over by the next, as they have its numbers."""
    first = head(path)
    named = numbered(rows.select(F.to_json(F.struct("*")).alias("value"), F.col(order).alias("_order")), F.col("_order"), name="offset", start=first)
    segments = named.select("offset", "value", F.floor(F.col("offset") / SEGMENT).alias("segment"), F.lit(first).alias("first"))
    # a publication has a folder of its own in each segment, so one that is repeated takes the place of what it left
    segments.repartition("segment").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment", "first").json(f"{path}/segments")
    last = first + named.count()
    files, at = _reached(path)
    with files.open_output_stream(f"{at}/head.new") as stream:
        stream.write(str(last).encode())
    files.move(f"{at}/head.new", f"{at}/head")
    return last


class Part(InputPartition):
    """The messages from ``first`` to before ``last``, of one segment."""

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class Reader(DataSourceStreamReader):
    def __init__(self, path: str, start: str):
        self.path, self.start = path, start

    def initialOffset(self) -> dict:
        return {"next": head(self.path) if self.start == "latest" else int(self.start)}

    def latestOffset(self) -> dict:
        return {"next": head(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        first, last = start["next"], end["next"]
        return [Part(max(first, s * SEGMENT), min(last, (s + 1) * SEGMENT)) for s in range(first // SEGMENT, -(-last // SEGMENT))] if last > first else []

    def read(self, partition: Part) -> Iterator[tuple[int, str]]:
        files, at = _reached(self.path)
        folder = fs.FileSelector(f"{at}/segments/segment={partition.first // SEGMENT}", recursive=True)
        for info in files.get_file_info(folder):
            if info.type == fs.FileType.File and info.base_name.startswith("part-"):
                with files.open_input_file(info.path) as stream:
                    for line in stream.read().splitlines():
                        message = json.loads(line)
                        if partition.first <= message["offset"] < partition.last:
                            yield message["offset"], message["value"]


class Channel(DataSource):
    @classmethod
    def name(cls) -> str:
        return "channel"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("startingOffset", "0"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Channel)


def messages(spark: SparkSession, path: str, schema: str, start: int | str = 0) -> DataFrame:
    """The stream of a channel's messages from an offset on, taken apart by ``schema``."""
    register(spark)
    raw = spark.readStream.format("channel").option("path", path).option("startingOffset", str(start)).load()
    return raw.select("offset", F.from_json("value", schema).alias("m")).select("offset", "m.*")
