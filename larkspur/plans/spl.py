"""A small pipe language: ``index=NAME | stats ... | timechart ... | sort ...``, compiled to DataFrame calls.

Grammar: ``index=NAME`` and then any of

* ``stats AGG[(field)] {, AGG(field)} [by field {, field}]`` with AGG one of count, sum, avg;
* ``timechart [span=1h] [limit=10] AGG[(field)] {, AGG(field)} [by field]``, giving a row for every span from the first to
  the last, without a gap: ``_time`` and a column an aggregate; with ``by`` a column for each of the ``limit`` largest
  series and one for all OTHER (with ``limit=0`` a row for each span and series that there is);
* ``sort [+|-]field {, [+|-]field}``; groups also get ``rn``, the row's number.

``span`` and several fields after ``by`` go beyond the texts this language is modelled on.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.operators.numbering import numbered

SPANS = {"s": "second", "m": "minute", "h": "hour", "d": "day"}


@dataclass(frozen=True)
class Aggregate:
    name: str
    column: str | None = None

    @property
    def alias(self) -> str:
        return self.name if self.column is None else f"{self.name}_{self.column}"

    def compiled(self) -> Column:
        if self.name == "count":
            return F.count(F.lit(1) if self.column is None else F.col(self.column)).alias(self.alias)
        call = {"sum": F.sum, "avg": F.avg}[self.name]
        return call(self.column).alias(self.alias)


@dataclass(frozen=True)
class Stats:
    aggregates: list[Aggregate]
    by: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Timechart(Stats):
    span: str = "1 hour"
    limit: int = 10


@dataclass(frozen=True)
class Sort:
    keys: list[tuple[str, bool]]


@dataclass(frozen=True)
class Query:
    index: str
    commands: list[Stats | Timechart | Sort]


class SplError(ValueError):
    """A text that is not in the grammar."""


def _aggregates(text: str) -> list[Aggregate]:
    out = []
    for part in (p.strip() for p in text.split(",")):
        m = re.fullmatch(r"(count|sum|avg)(?:\(\s*([A-Za-z_]\w*)\s*\))?", part)
        if not m or (m[1] != "count" and not m[2]):
            raise SplError(f"no aggregate: {part!r}")
        out.append(Aggregate(m[1], m[2]))
    return out


def _names(text: str) -> list[str]:
    names = [n.strip() for n in text.split(",")]
    for n in names:
        if not re.fullmatch(r"[A-Za-z_]\w*", n):
            raise SplError(f"no field name: {n!r}")
    return names


def _command(text: str) -> Stats | Timechart | Sort:
    word, _, rest = text.strip().partition(" ")
    rest = rest.strip()
    if word == "stats":
        body, *by = re.split(r"\s+by\s+", rest)
        return Stats(_aggregates(body), _names(by[0]) if by else [])
    if word == "timechart":
        span, limit = "1 hour", 10
        while m := re.match(r"(?:span=(\d+)([smhd])|limit=(\d+))\s+", rest):
            if m[1]:
                span = f"{m[1]} {SPANS[m[2]]}"
            else:
                limit = int(m[3])
            rest = rest[m.end() :]
        body, *by = re.split(r"\s+by\s+", rest)
        names = _names(by[0]) if by else []
        if limit and len(names) > 1:
            raise SplError("a time chart has one field after by, or limit=0")
        return Timechart(_aggregates(body), names, span, limit)
    if word == "sort":
        keys = [(k.strip().lstrip("+-"), k.strip().startswith("-")) for k in rest.split(",")]
        _names(",".join(k for k, _ in keys))
        return Sort(keys)
    raise SplError(f"no command: {word!r}")


def parse(text: str) -> Query:
    first, *rest = [p.strip() for p in text.split("|")]
    m = re.fullmatch(r"index=([A-Za-z_]\w*)", first)
    if not m:
        raise SplError("a query begins with index=NAME")
    return Query(m[1], [_command(p) for p in rest])


OTHER, NULL = "OTHER", "NULL"


def timechart(df: DataFrame, c: Timechart, time: str) -> DataFrame:
    """Spans without a gap and series as columns; those are chosen in a pass of their own, in which a series counts by the
    first aggregate over all of its rows. A span without rows has counts of 0 and otherwise nulls."""
    at = F.window(time, c.span)["start"].alias("_time")
    if c.by and not c.limit:
        return df.groupBy(at, *c.by).agg(*[a.compiled() for a in c.aggregates])
    if c.by:
        name = F.coalesce(F.col(c.by[0]).cast("string"), F.lit(NULL))
        sizes = df.where(name != OTHER).groupBy(name.alias("name")).agg(c.aggregates[0].compiled().alias("size"))
        # limit rows
        largest = [r.name for r in sizes.orderBy(F.desc_nulls_last("size"), "name").limit(c.limit).collect()]
        series = F.when(name.isin(largest), name).otherwise(OTHER)
        rest = [OTHER] if df.where(~name.isin(largest)).limit(1).count() else []
        wide = df.withColumn("_series", series).groupBy(at).pivot("_series", [*largest, *rest]).agg(*[a.compiled() for a in c.aggregates])
        columns = [f"{a.alias}: {s}" if len(c.aggregates) > 1 else s for s in [*largest, *rest] for a in c.aggregates]
        counts = [a.name == "count" for _ in [*largest, *rest] for a in c.aggregates]
    else:
        wide = df.groupBy(at).agg(*[a.compiled() for a in c.aggregates])
        columns, counts = [a.alias for a in c.aggregates], [a.name == "count" for a in c.aggregates]
    inner = [f"s{i}" for i in range(len(columns))]
    wide = wide.toDF("_time", *inner)
    ends = wide.agg(F.min("_time").alias("lo"), F.max("_time").alias("hi")).where("lo IS NOT NULL")
    spine = ends.select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {c.span}"))).alias("_time"))
    shown = [F.coalesce(i, F.lit(0)).alias(i) if n else F.col(i) for i, n in zip(inner, counts)]
    return spine.join(wide, "_time", "left").select("_time", *shown).toDF("_time", *columns)


def compiled(query: Query, source: Callable[[str], DataFrame], time: str = "ts") -> DataFrame:
    df, grouped = source(query.index), False
    for c in query.commands:
        grouped = grouped or isinstance(c, Stats)
        if isinstance(c, Timechart):
            df = timechart(df, c, time)
        elif isinstance(c, Stats):
            df = df.groupBy(*c.by).agg(*[a.compiled() for a in c.aggregates])
        else:
            # ties are settled by the remaining columns, so results are stable
            keys = [F.desc(k) if down else F.asc(k) for k, down in c.keys]
            keys += [F.asc(k) for k in df.columns if k not in dict(c.keys)]
            if grouped:
                df = numbered(df, *keys).withColumn("rn", F.col("rn").cast("int"))
            else:
                # raw rows keep their shape
                df = df.orderBy(*keys)
    return df


def classify_result(df: DataFrame, query: Query) -> Mapping[str, object]:
    """The visualization that the result's own shape suggests."""
    last = next((c for c in reversed(query.commands) if isinstance(c, Stats)), None)
    if isinstance(last, Timechart):
        return {"visualization": "timechart", "x": "_time", "series": [c for c in df.columns if c not in ("_time", "rn", *last.by)]}
    if last and not last.by:
        return {"visualization": "single-value", "field": last.aggregates[0].alias}
    if last:
        return {"visualization": "bar", "x": last.by[0], "series": [a.alias for a in last.aggregates]}
    return {"visualization": "table", "columns": df.columns}
