"""Table view: sort with numeric coercion, cap, page, row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from larkspur.functions.scalars import leading_number

PAGE, MAX_ROWS = 50, 100


def numeric_keys(column: Column, position: Column, descending: bool = False) -> list[Column]:
    """The same order for a column of numbers, without reading them as text."""
    number = F.when(~F.isnan(column.cast("double")), column)
    name = F.when(number.isNull(), F.when(column.isNull(), "null").otherwise("nan"))
    flip = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    return [number.isNull().asc(), flip(number), flip(name), position.asc()]


def sort_keys(column: Column, position: Column, descending: bool = False) -> list[Column]:
    """Numbers first by value, then texts by their lower case; ties stay in input order.

    Two numbers are compared as numbers and anything else as text, pair by pair, in the original rule; that is no total
    order on mixed columns, for which numbers before texts is a choice of ours. Null compares as the text "null".
    """
    text = F.coalesce(column.cast("string"), F.lit("null"))
    number = leading_number(text)
    is_text = number.isNull().cast("int")
    lower = F.when(number.isNull(), F.lower(text))
    flip = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    return [is_text.asc(), flip(number), flip(lower), position.asc()]


def sorted_page(df: DataFrame, column: str, position: str, descending: bool = False, page: int = 1, max_rows: int = MAX_ROWS, page_size: int = PAGE) -> DataFrame:
    """Rows of one page with their number ``rn``: sort, keep ``max_rows``, cut pages.

    The cap goes first through a bounded top-k, so only ``max_rows`` rows reach the window that numbers them.
    """
    numeric = isinstance(df.schema[column].dataType, T.NumericType)
    keys = (numeric_keys if numeric else sort_keys)(F.col(column), F.col(position), descending)
    top = df.orderBy(*keys).limit(max_rows)
    numbered = top.withColumn("rn", F.row_number().over(Window.orderBy(*keys)).cast("int"))
    return numbered.where((F.col("rn") > (page - 1) * page_size) & (F.col("rn") <= page * page_size))


def page_info(df: DataFrame, max_rows: int = MAX_ROWS, page_size: int = PAGE) -> DataFrame:
    """total_rows, shown_rows, pages."""
    shown = F.least(F.count("*"), F.lit(max_rows))
    return df.agg(F.count("*").alias("total_rows"), shown.cast("long").alias("shown_rows"), F.ceil(shown / page_size).cast("long").alias("pages"))
