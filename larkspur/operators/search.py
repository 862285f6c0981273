"""Text search over several columns, filters, counts, catalog search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from larkspur.functions.scalars import contains_folded


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def filter_columns(df: DataFrame, most: int = 3) -> list[str]:
    """Offered as filters: the first text columns but the id."""
    return [c for c in text_columns(df) if c != "id"][:most]


def _cell_matches(name: str, kind: T.DataType, needle: str) -> Column:
    """Empty, zero, false and null cells match nothing."""
    c = F.col(name)
    full = c.isNotNull()
    if isinstance(kind, T.StringType):
        full = full & (c != "")
    elif isinstance(kind, T.BooleanType):
        full = full & c
    elif isinstance(kind, T.NumericType):
        full = full & (c != 0)
    return full & contains_folded(c, needle)


def search(df: DataFrame, term: str, keys: Sequence[str] | None = None, filters: Mapping[str, str] | None = None) -> DataFrame:
    """Rows where any key holds the term, and each filtered column its value. A blank term or value filters nothing; the
    term itself is matched untrimmed."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if term.strip():
        df = df.where(reduce(lambda a, b: a | b, [_cell_matches(k, kinds[k], term) for k in keys or text_columns(df)], F.lit(False)))
    for name, value in (filters or {}).items():
        if value:
            df = df.where(_cell_matches(name, kinds[name], value))
    return df


def shown_of(df: DataFrame, found: Column) -> DataFrame:
    return df.agg(F.count_if(found).alias("shown"), F.count("*").alias("total"))


def first_results(df: DataFrame, order: str, most: int = 10) -> DataFrame:
    """The first rows with ``more``, the number of those left out."""
    n = df.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    return df.orderBy(order).limit(most).join(F.broadcast(n))  # one row


def catalog_search(df: DataFrame, query: str = "", category: str = "All") -> DataFrame:
    """Name, description or any tag holds the query, and the category is the one asked for."""
    hit = contains_folded(F.col("name"), query) | contains_folded(F.col("description"), query) | F.exists("tags", lambda t: contains_folded(t, query))
    return df.where(hit & (F.lit(category == "All") | (F.col("category") == category)))


def featured(df: DataFrame, query: str = "", category: str = "All") -> tuple[DataFrame, DataFrame]:
    """Featured rows, which search does not touch, and the others found."""
    is_featured = F.coalesce("featured", F.lit(False))
    return df.where(is_featured), catalog_search(df, query, category).where(~is_featured)


def featured_shown(df: DataFrame, query: str = "", category: str = "All") -> DataFrame:
    """Featured rows as a page shows them: only while nothing is asked for."""
    return featured(df)[0] if not query and category == "All" else df.limit(0)


def categories(df: DataFrame, position: str) -> DataFrame:
    """Distinct categories in order of their first row, with All before them."""
    seen = df.groupBy("category").agg(F.min(position).cast("long").alias("pos"))
    return seen.unionByName(df.sparkSession.createDataFrame([("All", -1)], "category string, pos long"))
