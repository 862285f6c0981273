"""Indexes: named Parquet tables of a folder, whole or as a stable sample."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SAMPLE = 1000
#: Views that come from here, by what they hold; they may be replaced when another folder is asked.
REGISTERED: dict[str, int] = {}


class Indexes:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def names(self) -> list[str]:
        """Tables of the folder, by Hadoop's own listing, so any store that Spark reads will do."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        found = (f.getPath().getName() for f in files)
        return sorted(n.removesuffix(".parquet") for n in found if n.endswith(".parquet"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def load(self, name: str, mode: str = "full", order: str | None = None, size: int | str = SAMPLE) -> DataFrame:
        """All rows, or the first ``size`` by ``order``; a size that is no positive number means 1000."""
        df = self.table(name)
        if mode == "full":
            return df
        try:
            n = int(size)
        except ValueError:
            n = SAMPLE
        return df.orderBy(order or df.columns[0]).limit(n if n > 0 else SAMPLE)

    def register(self, text: str) -> None:
        """The indexes that a text names as views for SQL; a table or view of the user's by the same name stays as it is."""
        words = set(re.findall(r"\w+", text))
        for name in words.intersection(self.names()):
            if self.spark.catalog.tableExists(name) and self.spark.table(name).semanticHash() != REGISTERED.get(name):
                continue
            self.table(name).createOrReplaceTempView(name)
            REGISTERED[name] = self.spark.table(name).semanticHash()
