"""Session builder with the settings that results depend on pinned."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local or cluster session: UTC, adaptive execution, and a modest number of shuffle partitions.

    On a cluster pass ``shuffle_partitions`` as two to three times the cores; adaptive execution coalesces the rest.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName("larkspur")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
