"""Gapless row numbers in an order, without a task that sees all rows.

Rows are sorted by ranges, each with its place in its range, and written. The counts of the ranges, a row each, give
every range its offset; a row's number is the offset plus its place. Numbers within groups are those over all rows less
the group's first. A lost executor changes no number, as the places are read from the written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.sources.work import if_small, written

#: monotonically_increasing_id() holds the partition above this bit and the row's place in it below.
PLACE_BITS = 33
#: Groups up to which their first numbers are broadcast.
FEW_GROUPS = 100_000


def numbered(df: DataFrame, *order: Column, name: str = "rn", start: int = 1, by: str | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with a gapless number ``name`` from ``start`` on in the given order; with ``by``, a column that has to lead
    the order, from ``start`` on in each of its values, null being one.

    Ties come in any order, but each number is given once; rows that are equal in the order share a range, so where many
    are, a further key should split them. No row is lost; an empty table stays empty. Without an order rows are numbered
    as they lie.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inner = [f"c{i}" for i in range(len(df.columns))]
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order) if order else df
    at = F.monotonically_increasing_id()
    stored = written(placed.toDF(*inner).withColumn("_at", at), "numbered")
    rows = stored.select(*inner, F.shiftright("_at", PLACE_BITS).cast("int").alias("_range"), F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1).alias("_place"))
    # a row a range, so the window over them is as small as the number of ranges
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("_range").agg(F.count("*").alias("_n")).select(F.col("_range").alias("_of"), F.coalesce(before, F.lit(0)).alias("_offset"))
    out = rows.join(F.broadcast(offsets), F.col("_range") == F.col("_of")).withColumn("_rn", F.col("_offset") + F.col("_place"))
    if by is not None:
        group = inner[[c.lower() for c in df.columns].index(by.lower())]
        first = written(out.groupBy(F.col(group).alias("_group")).agg(F.min("_rn").alias("_first")), "numbered-groups")
        out = out.join(if_small(first, FEW_GROUPS), F.col(group).eqNullSafe(F.col("_group"))).withColumn("_rn", F.col("_rn") - F.col("_first"))
    return out.select(*inner, (F.col("_rn") + start).alias("_rn")).toDF(*df.columns, name)
