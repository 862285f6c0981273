"""Read views, small series, documentation search, file lists and display formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur.functions.scalars import contains_folded, trim_all


def decoded_array(text: Column) -> Column:
    """JSON text of an array as variants; empty text is an empty array."""
    return F.try_parse_json(F.when(text.isNull() | (text == ""), "[]").otherwise(text))


def decoded_object(text: Column) -> Column:
    return F.try_parse_json(F.when(text.isNull() | (text == ""), "{}").otherwise(text))


def message_view(messages: DataFrame) -> DataFrame:
    """Messages with their blocks decoded."""
    return messages.withColumn("blocks", decoded_array(F.col("blocks")))


def job_view(jobs: DataFrame) -> DataFrame:
    """Jobs with params and result decoded; an empty result stays null."""
    return jobs.withColumn("params", decoded_object(F.col("params"))).withColumn("result", F.try_parse_json(F.nullif("result", F.lit(""))))


def job_created_view(jobs: DataFrame) -> DataFrame:
    """What the creation of a job answers: the job view without its error."""
    return job_view(jobs).drop("error")


def appended_uploads(files: DataFrame, more: DataFrame, valid: Column, now: Column) -> DataFrame:
    """The valid ones of ``more`` behind ``files``, uploaded now."""
    return files.unionByName(more.where(valid).withColumn("uploaded_at", now).select(*files.columns))


def without_handlers(actions: Column) -> Column:
    """Form actions without what cannot be stored."""
    return F.transform(actions, lambda a: a.dropFields("onClick"))


def hours(spark: SparkSession) -> DataFrame:
    """The labels of a day's 24 buckets."""
    return spark.range(24).select(F.concat(F.lpad(F.col("id").cast("string"), 2, "0"), F.lit(":00")).alias("time"))


def documentation_search(df: DataFrame, query: str = "", category: str = "all") -> DataFrame:
    """Category and (name, description or type); the query is not trimmed."""
    if category != "all":
        df = df.where(F.col("category") == category)
    if query:
        df = df.where(contains_folded(F.col("name"), query) | contains_folded(F.col("description"), query) | contains_folded(F.col("type"), query))
    return df


def preferred(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first list unless it is empty."""
    flag = first.limit(1).agg((F.count("*") == 0).alias("_none"))
    return first.unionByName(second.join(F.broadcast(flag.where("_none"))).drop("_none"))  # one row at most


def not_blank(text: Column) -> Column:
    return F.coalesce(trim_all(text) != "", F.lit(False))


def prepended(df: DataFrame, row: DataFrame, position: str) -> DataFrame:
    """``row`` before all rows: positions count from it."""
    return row.withColumn(position, F.lit(0)).unionByName(df.withColumn(position, (F.col(position) + 1).cast("int")))


def quoted(text: Column, n: int, always: bool = False) -> Column:
    """The first n characters, with dots if there are more, or always."""
    dots = F.lit("...") if always else F.when(F.length(text) > n, "...").otherwise("")
    return F.concat(F.substring(text, 1, n), dots)


def date_shown(ts: Column) -> Column:
    return F.date_format(ts, "M/d/yyyy, h:mm:ss a")
