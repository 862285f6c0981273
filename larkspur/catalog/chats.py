"""Conversations, messages and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.catalog.registry import query, table, values
from larkspur.functions.scalars import chat_title, truncate
from larkspur.operators import conversations as conv, jobs

AS_OF = "TIMESTAMP_NTZ '2024-01-31 00:00:00'"


def _chats(spark, d):
    """A conversation a user of the events, updated at the last one; every third has no title."""
    title = F.when(F.col("user_id") % 3 == 0, F.lit(None)).when(F.col("user_id") % 3 == 1, "").otherwise(F.concat(F.lit("Conversation about the incidents of user "), F.col("user_id").cast("string")))
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("updated_at")).withColumn("title", title).withColumnRenamed("user_id", "id")


_CHATS = """chats AS (SELECT user_id AS id, max(ts) AS updated_at,
  CASE user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Conversation about the incidents of user ' || user_id END AS title FROM events GROUP BY user_id)"""


@query("conv_list_recent", f"""
WITH {_CHATS}, t AS (SELECT id, CASE WHEN title IS NULL OR title = '' THEN 'Chat ' || id ELSE title END AS title, updated_at FROM chats WHERE updated_at > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY)
SELECT id, CASE WHEN length(title) > 30 THEN substr(title, 1, 30) || '...' ELSE title END AS title, updated_at
FROM t ORDER BY updated_at DESC, id
""")
def conv_list_recent(spark, d):
    found = conv.recent(_chats(spark, d), "updated_at", F.expr(AS_OF))
    return found.orderBy(F.desc("updated_at"), "id").select("id", truncate(chat_title(F.col("title"), F.col("id"))).alias("title"), "updated_at")


@query("conv_most_recent", f"WITH {_CHATS} SELECT id, updated_at FROM chats ORDER BY updated_at DESC, id LIMIT 1")
def conv_most_recent(spark, d):
    return conv.most_recent(_chats(spark, d), "updated_at", "id").select("id", "updated_at")


@query("conv_sidebar_search", f"WITH {_CHATS} SELECT id FROM chats WHERE contains(lower(coalesce(title, '')), '12') OR contains(CAST(id AS VARCHAR), '12')")
def conv_sidebar_search(spark, d):
    return conv.sidebar_search(_chats(spark, d), "12").select("id")


def _messages(spark, d):
    return table(spark, d, "conversations")


@query("conv_auto_title", r"""
WITH f AS (SELECT conv_id, arg_min(role, turn) AS role, regexp_replace(substr(arg_min(text, turn), 1, 50), '^\s+|\s+$', '', 'g') AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN role = 'user' AND t <> '' THEN t ELSE 'New Chat' END AS title FROM f
""")
def conv_auto_title(spark, d):
    fresh = _messages(spark, d).select("conv_id").distinct().withColumn("title", F.lit(conv.NEW_TITLE))
    return conv.auto_titles(fresh, _messages(spark, d), "conv_id", "turn")


@query("conv_history_top10", """
WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, role, CAST(least(n, 10) - r + 1 AS INTEGER) AS rn FROM r WHERE r <= 10
""")
def conv_history_top10(spark, d):
    return conv.last_messages(_messages(spark, d).select("conv_id", "turn", "role"), "conv_id", "turn")


@query("conv_messages_join", "SELECT c.conv_id, m.role, count(*) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN conversations m USING (conv_id) GROUP BY ALL")
def conv_messages_join(spark, d):
    chats = _messages(spark, d).select("conv_id").distinct()
    return conv.with_messages(chats, _messages(spark, d), "conv_id").groupBy("conv_id", "role").agg(F.count("*").alias("n"))


@query("conv_anti_delete", "SELECT conv_id, turn FROM conversations WHERE conv_id % 7 <> 0")
def conv_anti_delete(spark, d):
    gone = _messages(spark, d).select("conv_id").distinct().where("conv_id % 7 = 0")
    return conv.without(_messages(spark, d), gone, "conv_id").select("conv_id", "turn")


@query("conv_semi_folder", "SELECT conv_id, turn FROM conversations WHERE conv_id % 5 = 0")
def conv_semi_folder(spark, d):
    folder = F.when(F.col("conv_id") % 5 == 0, "favorites").otherwise("work")
    folders = _messages(spark, d).select("conv_id").distinct().withColumn("folder", folder)
    return conv.in_folder(_messages(spark, d), folders, "conv_id", "favorites").select("conv_id", "turn")


@query("conv_current_after_delete", "SELECT min(conv_id) AS current FROM conversations WHERE conv_id <> (SELECT min(conv_id) FROM conversations)")
def conv_current_after_delete(spark, d):
    chats = _messages(spark, d).select("conv_id").distinct()
    first = chats.agg(F.min("conv_id")).first()[0]
    return conv.current_after_delete(chats, first, first, "conv_id", "conv_id")


@query("msg_dedup_first", "SELECT conv_id, turn, role, text FROM conversations")
def msg_dedup_first(spark, d):
    once = _messages(spark, d).withColumn("arrival", F.lit(0))
    twice = once.unionByName(once.withColumn("arrival", F.lit(1)).withColumn("text", F.lit("again")))
    return conv.first_of_each(twice, ["conv_id", "turn"], "arrival").drop("arrival")


@query("msg_append_new", "SELECT conv_id, turn FROM conversations UNION ALL SELECT DISTINCT conv_id, CAST(-1 AS BIGINT) FROM conversations")
def msg_append_new(spark, d):
    have = _messages(spark, d).select("conv_id", "turn")
    more = have.unionByName(have.select("conv_id", F.lit(-1).cast("long").alias("turn")).distinct())
    return conv.append_new(have, more, ["conv_id", "turn"])


@query("msg_replace_partition", "SELECT conv_id, turn, CASE WHEN conv_id = 3 THEN 'edited' ELSE role END AS role FROM conversations")
def msg_replace_partition(spark, d):
    have = _messages(spark, d).select("conv_id", "turn", "role")
    return conv.replace_partition(have, "conv_id", 3, have.where("conv_id = 3").withColumn("role", F.lit("edited")))


@query("conv_touch", "SELECT user_id AS id, greatest(TIMESTAMP '2024-01-20', max(ts)) AS updated_at FROM events GROUP BY user_id")
def conv_touch(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("id"), "ts")
    chats = events.select("id").distinct().withColumn("updated_at", F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"))
    return conv.touch(chats, events, "id", "ts", "updated_at")


@query("conv_rename", f"WITH {_CHATS} SELECT id, CASE WHEN id % 10 = 0 THEN 'Renamed' ELSE title END AS title FROM chats")
def conv_rename(spark, d):
    chats = _chats(spark, d).select("id", "title")
    patch = chats.where("id % 10 = 0").select("id", F.lit("Renamed").alias("title")).unionByName(spark.createDataFrame([(-5, "Nobody")], "id long, title string"))
    return conv.patched(chats, patch, "id", ["title"])


@query("conv_rename_updated", f"WITH {_CHATS} SELECT id, CASE WHEN id % 10 = 0 THEN 'Renamed' ELSE title END AS title, CASE WHEN id % 5 = 0 THEN TIMESTAMP '2024-02-01' ELSE updated_at END AS updated_at FROM chats")
def conv_rename_updated(spark, d):
    chats = _chats(spark, d).select("id", "title", "updated_at")
    patch = chats.where("id % 5 = 0").select("id", F.when(F.col("id") % 10 == 0, "Renamed").alias("title")).unionByName(spark.createDataFrame([(-5, "Nobody")], "id long, title string"))
    return conv.renamed(chats, patch, "id", F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"))


@query("conv_add_current", "SELECT 'list' AS what, r_name AS id, CAST(r_regionkey + 1 AS INTEGER) AS pos FROM region UNION ALL VALUES ('list', 'new', 0), ('current', 'new', 0)")
def conv_add_current(spark, d):
    have = table(spark, d, "region").select(F.col("r_name").alias("id"), F.col("r_regionkey").alias("pos"))
    every, current = conv.added(have, spark.createDataFrame([("new",)], "id string"), "pos")
    return every.select(F.lit("list").alias("what"), "id", "pos").unionByName(current.select(F.lit("current").alias("what"), F.col("current").alias("id"), F.lit(0).alias("pos")))


@query("role_avatar", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'U' ELSE 'AI' END AS avatar FROM conversations")
def role_avatar(spark, d):
    return _messages(spark, d).select("conv_id", "turn", F.when(F.col("role") == "user", "U").otherwise("AI").alias("avatar"))


#: Event types stand for the states of a job.
_STATUS = {"click": "queued", "view": "started", "purchase": "progress", "login": "completed"}
_STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + " ELSE 'failed' END"


def _updates(spark, d):
    status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in _STATUS.items() for x in p]), F.col("event_type")), F.lit("failed"))
    return table(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts", "event_id", status.alias("status"))


@query("job_latest_state", f"SELECT user_id AS job_id, arg_max({_STATUS_SQL}, (ts, event_id)) AS status, max(ts) AS ts FROM events WHERE user_id % 4 <> 0 GROUP BY user_id")
def job_latest_state(spark, d):
    updates = _updates(spark, d)
    return jobs.latest(updates, "job_id", ["ts", "event_id"], updates.where("job_id % 4 <> 0")).select("job_id", "status", "ts")


@query("job_lookup", f"SELECT 'found' AS lookup, user_id AS job_id, arg_max({_STATUS_SQL}, (ts, event_id)) AS status FROM events WHERE user_id = (SELECT min(user_id) FROM events) GROUP BY user_id")
def job_lookup(spark, d):
    known = jobs.latest(_updates(spark, d), "job_id", ["ts", "event_id"]).select("job_id", "status")
    first = known.agg(F.min("job_id")).first()[0]
    # the worker's own lookup of a job that is gone finds nothing and does not fail
    return conv.get(known, "job_id", first).select(F.lit("found").alias("lookup"), "*").unionByName(conv.find(known, "job_id", -1).select(F.lit("gone").alias("lookup"), "*"))


@query("job_placeholder_state", f"""
WITH j AS (SELECT user_id AS job_id, arg_max({_STATUS_SQL}, (ts, event_id)) AS status FROM events WHERE user_id % 4 <> 0 GROUP BY user_id)
SELECT job_id, CASE WHEN status IS NULL THEN 'loading' WHEN status = 'completed' AND job_id % 2 = 0 THEN 'blocks' WHEN status = 'failed' THEN 'error' ELSE 'progress' END AS display
FROM (SELECT DISTINCT user_id AS job_id FROM events) LEFT JOIN j USING (job_id)
""")
def job_placeholder_state(spark, d):
    updates = _updates(spark, d)
    known = jobs.latest(updates, "job_id", ["ts", "event_id"], updates.where("job_id % 4 <> 0")).withColumn("has_blocks", F.col("job_id") % 2 == 0)
    return jobs.placeholders(updates.select("job_id").distinct(), known.select("job_id", "status", "has_blocks")).select("job_id", "display")


@query("job_merged_state", """
SELECT user_id AS job_id, arg_max(value, (ts, event_id)) FILTER (event_type <> 'error' AND value IS NOT NULL) AS progress, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id
""")
def job_merged_state(spark, d):
    events = table(spark, d, "events")
    updates = events.select(F.col("user_id").alias("job_id"), "ts", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("progress"), F.col("event_type").alias("status"))
    return jobs.merged(updates, "job_id", ["ts", "event_id"], ["progress", "status"])


_JOBS = "(SELECT DISTINCT user_id AS job_id FROM events)"


def _jobs(spark, d):
    """Each user's job."""
    return table(spark, d, "events").select(F.col("user_id").alias("job_id")).distinct()


@query("job_progress_steps", f"SELECT * FROM {_JOBS}, (VALUES {values([(0, 'queued', 0), (1, 'started', 0), *[(i + 1, 'progress', 10 * i) for i in range(1, 11)], (12, 'completed', 100)])}) AS t(seq, status, progress)")
def job_progress_steps(spark, d):
    return _jobs(spark, d).join(F.broadcast(jobs.progress_steps(spark)))  # 13 rows


@query("job_client_steps", f"SELECT * FROM {_JOBS}, (VALUES {values([(0, 'started', 10), *[(i, 'progress', 20 * i) for i in range(1, 5)], (5, 'completed', 100)])}) AS t(seq, status, progress)")
def job_client_steps(spark, d):
    return _jobs(spark, d).join(F.broadcast(jobs.client_steps(spark)))  # 6 rows


@query("series_generator", "SELECT format('2024-01-{:02d}', i) AS date, true AS in_range FROM range(1, 61) AS t(i)")
def series_generator(spark, d):
    return jobs.create(spark, "chart", days=60).select("date", F.col("value").between(10, 100).alias("in_range"))
