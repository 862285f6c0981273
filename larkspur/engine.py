"""The executor: a query text and its language in, a result envelope out."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from larkspur.operators.classify import visualization_of
from larkspur.plans import spl
from larkspur.sources.indexes import Indexes


@dataclass
class QueryResult:
    """rows stay a DataFrame; nothing is computed before it is asked for, but for ``row_count``."""

    rows: DataFrame
    columns: list[str]
    visualization: str
    suggested: Mapping[str, object] = field(default_factory=dict)
    planning_seconds: float = 0.0

    def row_count(self) -> int:
        return self.rows.count()

    def single_value(self):
        row = self.rows.first()
        return None if row is None else row[0]


class Engine:
    def __init__(self, spark: SparkSession, folder: str, times: Mapping[str, str] | None = None):
        """times: the time column of an index, where it is not ``ts``."""
        self.spark, self.indexes, self.times = spark, Indexes(spark, folder), times or {}

    def execute(self, text: str, language: str = "sql") -> QueryResult:
        """Run SQL or pipe text. ``visualization`` is what the text suggests, ``suggested`` what the result's shape does."""
        begun = time.monotonic()
        if language == "spl":
            query = spl.parse(text)
            rows = spl.compiled(query, self.indexes.table, self.times.get(query.index, "ts"))
            suggested = spl.classify_result(rows, query)
        elif language == "sql":
            self.indexes.register(text)
            rows = self.spark.sql(text)
            suggested = {"visualization": "table", "columns": rows.columns}
        else:
            raise ValueError(f"unknown language: {language}")
        return QueryResult(rows, rows.columns, visualization_of(text), suggested, time.monotonic() - begun)
