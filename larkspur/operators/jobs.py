"""Jobs: creation, states from updates, placeholders."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.operators.classify import job_display
from larkspur.operators.numbering import numbered

STATUSES = ("queued", "started", "progress", "completed", "failed")


def series(spark: SparkSession, days: int = 30, seed: int = 1) -> DataFrame:
    """``days`` rows of a label and a whole number from 10 to 100; labels are text and not checked to be dates."""
    n = F.col("id").cast("int") + 1
    return spark.range(days).select(F.format_string("2024-01-%02d", n).alias("date"), (F.floor(F.rand(seed) * 91) + 10).cast("int").alias("value"))


REGISTRY: Mapping[str, Callable[..., DataFrame]] = {"chart": series}


def create(spark: SparkSession, kind: str, **params) -> DataFrame:
    """The rows of a job of a registered kind. Unknown kinds are refused before anything is stored."""
    if kind not in REGISTRY:
        raise ValueError(f"unknown job kind: {kind}")
    return REGISTRY[kind](spark, **params)


def latest(updates: DataFrame, key: str, order: list[str], created: DataFrame | None = None) -> DataFrame:
    """The last update of each key; keys that were never created are ignored."""
    rest = [c for c in updates.columns if c != key]
    if created is not None:
        updates = updates.join(created.select(key).distinct(), key, "left_semi")
    return updates.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(key, "_last.*")


def merged(updates: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Shallow merge: of each column the last value that an update set."""
    at = F.struct(*order)
    return updates.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def placeholders(wanted: DataFrame, jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """Each placeholder's display state; a job that is not there yet is loading."""
    return wanted.join(jobs, key, "left").withColumn("display", job_display(F.col("status"), F.coalesce(F.col("has_blocks"), F.lit(False))))


def client_steps(spark: SparkSession) -> DataFrame:
    """(seq, status, progress) of a run without a server: started at 10, then steps of 20 to the end."""
    n, percent = F.col("id"), F.when(F.col("id") == 0, 10).otherwise(F.col("id") * 20).cast("int")
    status = F.when(n == 0, "started").when(n == 5, "completed").otherwise("progress")
    return spark.range(6).select(n.cast("int").alias("seq"), status.alias("status"), percent.alias("progress"))


def with_ids(df: DataFrame, order: str | None = None) -> DataFrame:
    """Random ids, or with ``order`` ids from 1 on without gaps, given by ranges and their offsets."""
    return df.withColumn("id", F.uuid()) if order is None else numbered(df, F.col(order), name="id")


def progress_steps(spark: SparkSession, steps: int = 10) -> DataFrame:
    """(seq, status, progress) of a run: queued, started, steps, completed."""
    n = F.col("id")
    status = F.when(n == 0, "queued").when(n == 1, "started").when(n == steps + 2, "completed").otherwise("progress")
    percent = F.when(n < 2, 0).otherwise(F.least(n - 1, F.lit(steps)) * (100 // steps)).cast("int")
    return spark.range(steps + 3).select(n.cast("int").alias("seq"), status.alias("status"), percent.alias("progress"))
