"""Conversation and message queries, and edits expressed as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.functions.scalars import contains_folded, trim_all

NEW_TITLE = "New Chat"


def get(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; none found is an error."""
    found = find(df, key, value)
    if found.isEmpty():
        raise LookupError(f"no row with {key} = {value}")
    return found


def find(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; none found is an empty frame."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def recent(df: DataFrame, updated: str, as_of: Column, days: int = 7) -> DataFrame:
    return df.where(F.col(updated) > as_of - F.expr(f"INTERVAL {days} DAYS"))


def sidebar_search(df: DataFrame, query: str, title: str = "title", key: str = "id") -> DataFrame:
    """The stored title or the id as text holds the query; a blank query finds all."""
    if not query.strip():
        return df
    return df.where(contains_folded(F.col(title), query) | contains_folded(F.col(key), query))


def last_messages(messages: DataFrame, conversation: str, order: str, n: int = 10) -> DataFrame:
    """The last n of each conversation, oldest first by ``rn``."""
    newest = Window.partitionBy(conversation).orderBy(F.desc(order))
    kept = messages.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n)
    size = F.count(F.lit(1)).over(Window.partitionBy(conversation))
    return kept.withColumn("rn", (size - F.col("_r") + 1).cast("int")).drop("_r")


def with_messages(conversations: DataFrame, messages: DataFrame, key: str) -> DataFrame:
    return conversations.join(messages, key)


def auto_titles(conversations: DataFrame, messages: DataFrame, key: str, order: str) -> DataFrame:
    """A conversation still called New Chat takes the first 50 characters of its first message, if a user wrote it."""
    first = messages.groupBy(key).agg(F.min_by(F.struct("role", "text"), order).alias("_first"))
    title = trim_all(F.substring("_first.text", 1, 50))
    fresh = (F.col("title") == NEW_TITLE) & (F.col("_first.role") == "user") & (title != "")
    return conversations.join(first, key, "left").withColumn("title", F.when(fresh, title).otherwise(F.col("title"))).drop("_first")


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys, key, "left_anti")


def in_folder(df: DataFrame, folders: DataFrame, key: str, folder: str) -> DataFrame:
    return df.join(folders.where(F.col("folder") == folder), key, "left_semi")


def first_of_each(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the first stays."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def append_new(df: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not there yet are added."""
    return df.unionByName(more.join(df.select(*keys), keys, "left_anti"))


def touch(conversations: DataFrame, messages: DataFrame, key: str, created: str, updated: str) -> DataFrame:
    """updated becomes the time of the last message, where that is later."""
    last = messages.groupBy(key).agg(F.max(created).alias("_last"))
    return conversations.join(last, key, "left").withColumn(updated, F.greatest(updated, "_last")).drop("_last")


def patched(df: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns take the patch's values where it has them; unknown keys change nothing."""
    new = patch.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def renamed(df: DataFrame, patch: DataFrame, key: str, now: Column, updated: str = "updated_at") -> DataFrame:
    """Titles take the patch's values where it has them, and the rows it names are updated now; unknown keys change nothing."""
    new = patch.select(key, F.col("title").alias("_title"), F.lit(True).alias("_named"))
    joined = df.join(new, key, "left").withColumn("title", F.coalesce("_title", "title"))
    return joined.withColumn(updated, F.when(F.col("_named"), now).otherwise(F.col(updated))).select(*df.columns)


def added(df: DataFrame, row: DataFrame, position: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """``row`` before all rows, and the current key, which is that of the row."""
    first = row.withColumn(position, F.lit(0))
    return first.unionByName(df.withColumn(position, (F.col(position) + 1).cast("int"))), row.select(F.col(key).alias("current"))


def replace_partition(df: DataFrame, key: str, value, rows: DataFrame) -> DataFrame:
    return df.where(~F.col(key).eqNullSafe(F.lit(value))).unionByName(rows)


def most_recent(df: DataFrame, updated: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(updated), key).limit(1)


def current_after_delete(df: DataFrame, deleted, current, key: str = "id", position: str = "pos") -> DataFrame:
    """(current): the one before, or the first that remains if it was deleted; null if none remains."""
    first = df.where(F.col(key) != F.lit(deleted)).agg(F.min_by(key, position).alias("current"))
    return first if current == deleted else df.sparkSession.createDataFrame([(current,)], first.schema)


_INSIDE = """
WITH RECURSIVE above(start, at) AS (
  SELECT parent, parent FROM {nodes} WHERE id = :item AND parent IS NOT NULL
  UNION ALL SELECT start, n.parent FROM above JOIN {nodes} AS n ON n.id = above.at WHERE n.parent IS NOT NULL AND above.at <> :item
) SELECT DISTINCT start FROM above WHERE at = :item
"""


def toggled(df: DataFrame, item: str, checked: bool, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """The item is checked or not, wherever it is; what lies below a match stays as it is, even by the same id."""
    nodes = df.select(F.col(key).alias("id"), F.col(parent).alias("parent"))
    inside = df.sparkSession.sql(_INSIDE, args={"item": item}, nodes=nodes).select(F.col("start").alias(parent), F.lit(True).alias("_inside"))
    marked = df.join(inside, parent, "left").select(*df.columns, "_inside")
    return marked.withColumn("checked", F.when((F.col(key) == item) & F.col("_inside").isNull(), F.lit(checked)).otherwise(F.col("checked"))).drop("_inside")


def symmetric_toggle(ids: Column, item: str) -> Column:
    """Out if it is in, else in."""
    return F.when(F.array_contains(ids, item), F.array_remove(ids, item)).otherwise(F.array_append(ids, F.lit(item)))
