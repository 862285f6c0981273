"""Streaming queries, drained over the events table; their SQL is that of the batch forms."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from larkspur.catalog.registry import query, table
from larkspur.sources import channel
from larkspur.sources.work import new_path
from larkspur.streaming import flows, keyed
from larkspur.streaming.relay import RelayedTable, relay


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    pairs = flows.events(spark, d).select("user_id", "event_type")
    return flows.drained(flows.first_of_keys(pairs, ["user_id", "event_type"]), "append")


@query("stream_timechart", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS _time, count(*) AS count, round(avg(value), 4) AS avg_value FROM events GROUP BY 1")
def stream_timechart(spark, d):
    return flows.drained(flows.timechart(flows.events(spark, d)), "complete").withColumn("_time", F.col("_time").cast("timestamp_ntz"))


@query("stream_job_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def stream_job_state(spark, d):
    return flows.drained(flows.job_states(flows.events(spark, d), "user_id", ["ts", "event_id"], ["event_type"]), "complete")


@query("stream_routed", "SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def stream_routed(spark, d):
    return flows.drained(flows.routed(flows.events(spark, d), "error").select("event_id", "user_id"), "append")


@query("stream_job_merge", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) FILTER (event_type <> 'error' AND value IS NOT NULL) AS value
FROM events WHERE user_id % 4 <> 0 GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) <> 'error'
""")
def stream_job_merge(spark, d):
    updates = flows.events(spark, d).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    created = spark.read.parquet(f"{d}/events.parquet").where("user_id % 4 <> 0")
    return flows.drained(flows.job_merges(updates, "user_id", ["ts", "event_id"], ["event_type", "value"], created, F.col("event_type") == "error"), "complete")


def _replays(spark, rows, halves: int = 2, batches: int = 5):
    """The stream of rows by event_id, and a function that adds the next half of them, ``batches`` micro-batches."""
    path, middle = new_path(spark, "replay"), rows.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    parts = iter([rows.where(F.col("event_id") <= middle), rows.where(F.col("event_id") > middle)])
    spark.createDataFrame([], rows.schema).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stream, lambda: keyed.replayable(next(parts), "event_id", batches, path)


_JOB_EVENTS = """
SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'set' WHEN 'error' THEN 'remove' ELSE 'update' END AS action,
  CASE WHEN event_type <> 'click' THEN event_type END AS status, CASE WHEN event_type IN ('signup', 'purchase') THEN value END AS value FROM {}
"""


@query("stream_keyed_jobs", f"""
WITH e AS ({_JOB_EVENTS.format("events")}), born AS (
  SELECT user_id, max(event_id) AS "at", max(event_id) FILTER (action <> 'update') AS born, arg_max(action, event_id) FILTER (action <> 'update') AS kind FROM e GROUP BY user_id
)
SELECT user_id AS key, "at", arg_max(status, event_id) FILTER (event_id >= born AND status IS NOT NULL) AS status,
  arg_max(value, event_id) FILTER (event_id >= born AND value IS NOT NULL) AS value
FROM e JOIN born USING (user_id) WHERE kind = 'set' GROUP BY user_id, "at"
""")
def stream_keyed_jobs(spark, d):
    """Ten micro-batches, restarted from the checkpoint after five."""
    keyed.use_rocks(spark)
    rows = table(spark, d, "events").selectExpr("user_id", "event_id", "event_type", "value")
    stream, more = _replays(spark, spark.sql(_JOB_EVENTS.format("{rows}"), rows=rows))
    found = keyed.states(stream, "user_id", "action", "event_id", ["status", "value"])
    out, checkpoint = RelayedTable(spark, new_path(spark, "jobs")), new_path(spark, "jobs-checkpoint")
    for _ in range(2):
        more()
        relay(found, {"jobs": out}, checkpoint, "update").start().awaitTermination()
    return keyed.current(out.read(found.schema)).select("key", "at", "status", "value")


@query("stream_first_rows", """
SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type
""")
def stream_first_rows(spark, d):
    """The first row of each key with its payload, over ten micro-batches and a restart; keys are held for 400 days."""
    keyed.use_rocks(spark)
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    stream, more = _replays(spark, rows)
    found = keyed.first_rows(stream.withWatermark("ts", "1 hour"), ["user_id", "event_type"], "event_id", "ts", 400 * 86_400_000).drop("ts")
    out, checkpoint = RelayedTable(spark, new_path(spark, "first")), new_path(spark, "first-checkpoint")
    for _ in range(2):
        more()
        relay(found, {"first": out}, checkpoint).start().awaitTermination()
    return out.read(found.schema).drop("batch")


@query("stream_relayed", "SELECT event_id, user_id, event_type, value FROM events")
def stream_relayed(spark, d):
    """All rows in a relayed table, once each, after a stop between a batch's rows and their commit."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    stream, more = _replays(spark, rows)
    out, checkpoint, stops = RelayedTable(spark, new_path(spark, "relayed")), new_path(spark, "relayed-checkpoint"), [3]

    def stopping(batch, number):
        if number in stops:
            stops.remove(number)
            batch.write.mode("overwrite").parquet(f"{out.path}/rows/batch={number}")
            raise RuntimeError("stopped between rows and commit")
        out(batch, number)

    more()
    for _ in range(2):
        try:
            relay(stream, {"relayed": stopping}, checkpoint).start().awaitTermination()
        except StreamingQueryException:
            more()
    return out.read(rows.schema).drop("batch")


@query("stream_channel", """
SELECT 'all' AS reader, event_id, user_id, value FROM events UNION ALL
SELECT 'late' AS reader, event_id, user_id, value FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM events) WHERE n > 500
""")
def stream_channel(spark, d):
    """Events published in two parts and read by two readers: one connected all the time, one from message 500 on."""
    rows = table(spark, d, "events").select("event_id", "user_id", "value")
    path, middle = new_path(spark, "channel"), rows.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    schema = "event_id long, user_id long, value double"
    readers = {name: (RelayedTable(spark, new_path(spark, f"channel-{name}")), new_path(spark, "channel-checkpoint"), start) for name, start in (("all", 0), ("late", 500))}
    parts = [rows.where(F.col("event_id") <= middle), rows.where(F.col("event_id") > middle)]
    for part, names in zip(parts, (["all"], ["all", "late"])):
        channel.publish(part, path, "event_id")
        for name in names:
            out, checkpoint, start = readers[name]
            relay(channel.messages(spark, path, schema, start), {name: out}, checkpoint).start().awaitTermination()
    every, late = (readers[n][0].read(f"offset long, {schema}").select(F.lit(n).alias("reader"), "event_id", "user_id", "value") for n in ("all", "late"))
    return every.unionByName(late)
