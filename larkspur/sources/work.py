"""Tables that steps write for later steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def work_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a session in one process (tests) gets one made, which goes when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        made = tempfile.mkdtemp(prefix="larkspur-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: it cuts the lineage, and a lost executor loses none of it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, most: int) -> DataFrame:
    """With a broadcast hint where ``df`` has ``most`` rows at most; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
