"""What the corpus operators share: table access, the shared work folder, written cut points."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs in one process (tests) is one made, which goes when the process ends; on a
    cluster executors would write to disks of their own, so there it is an error.
    """
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
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: it cuts the lineage, and a lost executor loses none of it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, most: int) -> DataFrame:
    """With a broadcast hint where ``df``, a written table, has ``most`` rows at most; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of so many rows at most in this session, if it has none set smaller: rows that hold texts or sets are
    large, and a batch stands several times in the memory of an executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


class Carried:
    """The columns of a table under numbered names while an operator adds its own, so that no two names clash.

    ``made``: names of outputs, in lower case; columns named so are left out, as the outputs replace them. ``beside``:
    expressions over the table, each with a name of its own.
    """

    def __init__(self, docs: DataFrame, made: tuple[str, ...] = (), *beside: Column):
        self.names = [c for c in docs.columns if c.lower() not in made]
        self.columns = [f"c{i}" for i in range(len(self.names))]
        quoted = ["`" + n.replace("`", "``") + "`" for n in self.names]
        self.df = docs.select(*[F.col(q).alias(c) for q, c in zip(quoted, self.columns)], *beside)

    def __getitem__(self, name: str) -> str:
        return self.columns[[n.lower() for n in self.names].index(name.lower())]

    def back(self, df: DataFrame, *made) -> DataFrame:
        """The table's columns under their own names, and then the operator's.

        All are made under the inner names first: in one selection a new name could stand for an inner one.
        """
        out = df.select(*self.columns, *made)
        return out.toDF(*self.names, *out.columns[len(self.columns) :])


def remove(df_or_path: DataFrame | str, spark: SparkSession) -> None:
    """Delete a written table that no later step reads."""
    path = df_or_path
    if isinstance(df_or_path, DataFrame):
        files = df_or_path.inputFiles()
        if not files:
            return
        path = files[0].rsplit("/", 1)[0]
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are done.

    It does so when the driver collects its garbage, by itself every half hour; steps of many shuffles need it sooner.
    """
    gc.collect()
    spark._jvm.System.gc()


def bits_of(numbers: DataFrame, column: str, width: int) -> np.ndarray:
    """Packed bits, one set for each number in ``column`` (0 to 2**width - 1). What reaches the driver is bounded by the
    width: parts of 4 KB, of 32768 bits each."""
    n = F.col(column).cast("long") + 1  # Spark numbers parts from 1 and the places in them from 0
    part, place = F.call_function("bitmap_bucket_number", n), F.call_function("bitmap_bit_position", n)
    rows = numbers.select(part.alias("part"), place.alias("place")).groupBy("part").agg(F.call_function("bitmap_construct_agg", F.col("place")).alias("bits")).toArrow()
    out = np.zeros(max(1 << width, 1 << 15) // 8, np.uint8)
    for part, bits in zip(rows["part"].to_pylist(), rows["bits"].to_pylist()):
        out[(part - 1) * 4096 : part * 4096] = np.frombuffer(bits, np.uint8)
    return out


def bit(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1
