"""Scalar rules of the workspace as column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: All Unicode space at both ends, as browsers trim.
EDGES = r"(?U)^\s+|\s+$"


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def contains_folded(c: Column, needle: str) -> Column:
    """Literal substring, case-folded on both sides; null never matches."""
    return F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(needle.lower())), F.lit(False))


def truncate(c: Column, n: int = 30) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def chat_title(title: Column, chat_id: Column) -> Column:
    """Null and empty titles fall back to the id."""
    return F.when(title.isNull() | (title == ""), F.concat(F.lit("Chat "), chat_id.cast("string"))).otherwise(title)


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def plain_number(c: Column) -> Column:
    """A number rounded to two decimals, without trailing zeros."""
    return F.regexp_replace(F.format_string("%.2f", c), r"\.?0+$", "")


def file_size(size: Column) -> Column:
    """Bytes, KB, MB or GB by thresholds; beyond GB there is no unit, so null."""
    out = F.when(size == 0, F.lit("0 Bytes"))
    for i, unit in enumerate(("Bytes", "KB", "MB", "GB")):
        scaled = round_half_up(size / float(1024**i) * 100) / 100
        out = out.when((size >= 1024**i) & (size < 1024 ** (i + 1)), F.concat(plain_number(scaled), F.lit(f" {unit}")))
    return out


def file_extension(name: Column) -> Column:
    """After the last dot, lower case; the whole name without one."""
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def accepts(name: Column, mime: Column, accept: str) -> Column:
    """Entries are ``.ext`` (equality with the lower-cased extension; the entry itself is not folded) or MIME patterns."""
    ok = F.lit(False)
    for entry in (e.strip() for e in accept.split(",")):
        if entry.startswith("."):
            ok = ok | (F.concat(F.lit("."), file_extension(name)) == entry)
        elif entry:
            ok = ok | F.coalesce(mime.rlike(entry.replace("*", ".*")), F.lit(False))
    return ok


def days_until(due: Column, as_of: Column) -> Column:
    millis = F.unix_millis(due.cast("timestamp")) - F.unix_millis(as_of.cast("timestamp"))
    return F.ceil(millis / 86_400_000.0)


def due_label(due: Column, as_of: Column) -> Column:
    """Null where the date cannot be read."""
    d = days_until(due, as_of)
    return (
        F.when(d < 0, F.concat(F.lit("Overdue ("), F.abs(d).cast("string"), F.lit(" days)")))
        .when(d == 0, "Due today")
        .when(d == 1, "Due tomorrow")
        .when(d.isNotNull(), F.concat(F.lit("Due in "), d.cast("string"), F.lit(" days")))
    )


def is_overdue(due: Column, as_of: Column) -> Column:
    return F.coalesce(due < as_of, F.lit(False))


def hour_label(ts: Column) -> Column:
    return F.date_format(ts, "HH:00")


def split_tags(text: Column) -> Column:
    """Comma-separated, trimmed, empties dropped."""
    return F.filter(F.transform(F.split(text, ","), trim_all), lambda t: t != "")


def grouped(c: Column, decimals: int = 0) -> Column:
    return F.format_number(c, decimals)


def locale_number(c: Column) -> Column:
    """Grouped thousands and up to three decimals, without trailing zeros."""
    return F.regexp_replace(F.format_number(F.round(c.cast("double"), 3), 3), r"\.?0+$", "")


def single_value(c: Column, unit: str | None = None) -> Column:
    """A number as shown, with its unit."""
    return F.concat(locale_number(c), F.lit(unit or ""))


def leading_number(c: Column) -> Column:
    """The number that a text starts with, as browsers parse it; null without one."""
    text = F.regexp_extract(c, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    infinite = F.regexp_extract(c, r"^\s*([+-]?)Infinity", 0)
    return F.when(infinite != "", F.when(F.contains(infinite, F.lit("-")), float("-inf")).otherwise(float("inf"))).otherwise(text.try_cast("double"))


def given(df: DataFrame, column: str) -> Column:
    """A cell as text, null where it counts as missing: empty text, the number 0 or NaN, false."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.StringType):
        return F.nullif(c, F.lit(""))
    if isinstance(kind, T.BooleanType):
        return F.when(c, c.cast("string"))
    if isinstance(kind, T.NumericType):
        return F.when((c != 0) & ~F.isnan(c.cast("double")), c.cast("string"))
    return c.cast("string")


@F.pandas_udf(T.StringType())
def pretty_json(text: pd.Series) -> pd.Series:
    """JSON text laid out by two spaces a level; text that is no JSON is null."""

    def whole(x: float) -> float | int:
        return int(x) if x.is_integer() and abs(x) < 1e21 else x

    def laid_out(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x, parse_float=lambda f: whole(float(f))), indent=2, ensure_ascii=False)
        except ValueError:
            return None

    return text.map(laid_out)
