"""Queries over stored tables: each makes one from a given table, changes it, and reads it."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.catalog.registry import query, table
from larkspur.sources.stored import StoredTable
from larkspur.sources.work import new_path


def _messages(spark, d):
    """(conv_id, id, role, text) of all messages; a turn that is there twice is there with its smallest text."""
    turns = table(spark, d, "conversations").groupBy("conv_id", F.col("turn").alias("id")).agg(F.min_by(F.struct("role", "text"), F.struct("text", "role")).alias("m"))
    return turns.select("conv_id", "id", "m.role", "m.text")


_MESSAGES = "SELECT conv_id, turn AS id, arg_min(role, (text, role)) AS role, min(text) AS text FROM conversations GROUP BY ALL"


def _stored(spark, rows, key):
    return StoredTable.create(spark, new_path(spark, "stored"), rows.schema, key, buckets=16)


@query("stored_messages", f"WITH m AS ({_MESSAGES}) SELECT conv_id, id, role, text FROM m WHERE id % 3 <> 2 OR conv_id % 2 = 0")
def stored_messages(spark, d):
    """Appended in three parts that overlap, each message once."""
    messages = _messages(spark, d)
    stored = _stored(spark, messages, "conv_id")
    for some in ("id % 3 = 0", "id % 3 < 2", "conv_id % 2 = 0"):
        stored.append(messages.where(some), ["conv_id", "id"])
    return stored.read()


@query("stored_replace_and_clear", f"""
WITH m AS ({_MESSAGES})
SELECT conv_id, id, role, text FROM m WHERE conv_id % 5 > 1 UNION ALL SELECT conv_id, id, role, '! ' || text FROM m WHERE conv_id % 5 = 0 AND id = 0
""")
def stored_replace_and_clear(spark, d):
    """The messages of some conversations are replaced by their first one, marked, those of others cleared."""
    messages = _messages(spark, d)
    stored = _stored(spark, messages, "conv_id")
    stored.append(messages)
    some = messages.where("conv_id % 5 = 0")
    stored.replace(some, some.where("id = 0").withColumn("text", F.concat(F.lit("! "), "text")))
    stored.delete(messages.where("conv_id % 5 = 1"))
    return stored.read()


@query("stored_versions", f"""
WITH m AS ({_MESSAGES})
SELECT 0 AS version, 0 AS messages, 0 AS conversations UNION ALL SELECT 1, count(*), count(DISTINCT conv_id) FROM m
UNION ALL SELECT 2, count(*), count(DISTINCT conv_id) FROM m WHERE conv_id % 2 = 0
""")
def stored_versions(spark, d):
    """Every version is there to read after later changes."""
    messages = _messages(spark, d)
    stored = _stored(spark, messages, "conv_id")
    stored.append(messages)
    stored.delete(messages.where("conv_id % 2 = 1"))
    counts = [stored.read(v).agg(F.count("*").alias("messages"), F.count_distinct("conv_id").alias("conversations")).select(F.lit(v).alias("version"), "*") for v in stored.versions()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).select(*[F.col(c).cast("int").alias(c) for c in ("version", "messages", "conversations")])


@query("stored_conversation_touch", f"""
WITH m AS ({_MESSAGES}), c AS (SELECT conv_id, min(id) AS created, max(id) FILTER (id < 2) AS first_part FROM m GROUP BY conv_id)
SELECT conv_id, CASE WHEN t.title = 'New Chat' AND role = 'user' AND trim(substring(text, 1, 50), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' THEN trim(substring(text, 1, 50), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE t.title END AS title, (SELECT max(id) FROM m AS x WHERE x.conv_id = c.conv_id) AS updated
FROM c JOIN m USING (conv_id), (SELECT 'New Chat' AS title) AS t WHERE m.id = c.created
""")
def stored_conversation_touch(spark, d):
    """Conversations are stored as new, then each takes its title from its first message and the time of its last."""
    from larkspur.operators.conversations import auto_titles

    messages = _messages(spark, d)
    fresh = messages.groupBy("conv_id").agg(F.lit("New Chat").alias("title"), F.max(F.when(F.col("id") < 2, F.col("id"))).alias("updated"))
    stored = _stored(spark, fresh, "conv_id")
    stored.append(fresh, ["conv_id"])
    titled = auto_titles(stored.read(), messages, "conv_id", "id").select("conv_id", "title")
    stored.upsert(titled.withColumn("updated", F.lit(None).cast("long")), partial=True)
    last = messages.groupBy("conv_id").agg(F.lit(None).cast("string").alias("title"), F.max("id").alias("updated"))
    stored.upsert(last, partial=True)
    return stored.read()


@query("stored_jobs", """
WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = 'purchase' THEN value END AS value, event_id % 3 AS part FROM events), born AS (
  SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) FILTER (event_id = m) AS value
  FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS m FROM e WHERE part = 0) GROUP BY user_id
), one AS (SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) FILTER (value IS NOT NULL) AS value FROM e WHERE part = 1 GROUP BY user_id
), two AS (SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) FILTER (value IS NOT NULL) AS value FROM e WHERE part = 2 GROUP BY user_id)
SELECT user_id, coalesce(two.status, one.status, born.status) AS status, coalesce(two.value, one.value, born.value) AS value
FROM born LEFT JOIN one USING (user_id) LEFT JOIN two USING (user_id)
""")
def stored_jobs(spark, d):
    """Jobs are set, then updated twice in the columns that the updates have; updates of unknown jobs are ignored."""
    events = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("status"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"))
    at = F.col("event_id")
    whole = F.max_by(F.struct("status", "value"), at).alias("job")
    first = events.where("event_id % 3 = 0").groupBy("user_id").agg(whole).select("user_id", "job.*")
    stored = _stored(spark, first, "user_id")
    stored.upsert(first)
    for part in (1, 2):
        update = events.where(at % 3 == part).groupBy("user_id").agg(F.max_by("status", at).alias("status"), F.max_by("value", F.when(F.col("value").isNotNull(), at)).alias("value"))
        stored.upsert(update, partial=True)
    return stored.read()
