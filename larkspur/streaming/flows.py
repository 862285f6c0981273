"""Event streams: message dedup, time charts, job states, routing; each equals its batch form on the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur.sources.work import if_small, new_path
from larkspur.streaming.relay import RelayedTable, relay

#: Created keys up to which they are broadcast.
MOST_CREATED = 10_000


def events(spark: SparkSession, folder: str, name: str = "events", time: str = "ts") -> DataFrame:
    """A table's file or folder of files as a stream, a file a batch, with its time as a timestamp that watermarks accept."""
    table = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(table).schema).option("maxFilesPerTrigger", 1)
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    found = reader.parquet(table) if whole else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return found.withColumn(time, F.col(time).cast("timestamp"))


def first_of_keys(stream: DataFrame, keys: list[str], time: str | None = None, late: str = "1 day") -> DataFrame:
    """One row a key. With ``time``, keys are forgotten once the watermark has passed, which bounds the state."""
    if time:
        return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def timechart(stream: DataFrame, time: str = "ts", span: str = "1 hour", late: str = "2 hours") -> DataFrame:
    windows = stream.withWatermark(time, late).groupBy(F.window(time, span))
    return windows.agg(F.count("*").alias("count"), F.round(F.avg("value"), 4).alias("avg_value")).select(F.col("window.start").alias("_time"), "count", "avg_value")


def job_states(stream: DataFrame, key: str, order: list[str], state: list[str]) -> DataFrame:
    """The last state of each key, by order of the updates and not of arrival."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*state), F.struct(*order)).alias("_s")).select(key, "_s.*")


def job_merges(stream: DataFrame, key: str, order: list[str], state: list[str], created: DataFrame, gone: Column) -> DataFrame:
    """Of each created key the last value that an update set in each column; keys whose last update removes them are left
    out. Updates of unknown keys are dropped before they reach the state, which so is bounded by the created keys."""
    at = F.struct(*order)
    known = stream.join(if_small(created.select(key).distinct(), MOST_CREATED), key)
    merged = known.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in state], F.max_by(gone, at).alias("_gone"))
    return merged.where(~F.col("_gone")).drop("_gone")


def routed(stream: DataFrame, kind: str, column: str = "event_type") -> DataFrame:
    return stream.where(F.col(column) == kind)


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there into a table, and return its rows: those of all batches, or in complete mode
    of the last one, which has all groups."""
    spark = stream.sparkSession
    table = RelayedTable(spark, new_path(spark, "flow"))
    relay(stream, {"table": table}, new_path(spark, "flow-checkpoint"), mode).start().awaitTermination()
    rows = table.read(stream.schema)
    if mode == "complete":
        rows = rows.where(F.col("batch") == max(table.committed(), default=0))
    return rows.drop("batch")
