"""Read views, lists and display formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.catalog.registry import query, table
from larkspur.functions import scalars
from larkspur.operators import jobs, views


@query("message_read_view", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 0 ELSE turn % 3 END::INT AS n_blocks FROM conversations")
def message_read_view(spark, d):
    text = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, '[{"type": "code"}]').otherwise('[{"type": "code"}, {"type": "list", "data": {"items": [1]}}]')
    shown = views.message_view(table(spark, d, "conversations").select("conv_id", "turn", text.alias("blocks")))
    return shown.select("conv_id", "turn", F.json_array_length(F.to_json("blocks")).alias("n_blocks"))


@query("chart_legacy", "SELECT format('2024-01-{:02d}', i) AS date FROM range(1, 31) AS t(i)")
def chart_legacy(spark, d):
    return jobs.series(spark, 30).select("date")


@query("hour_labels", "SELECT format('{:02d}:00', i) AS time FROM range(24) AS t(i)")
def hour_labels(spark, d):
    return views.hours(spark)


@query("files_preferred", "SELECT 'uploads' AS kind, region.r_name AS name FROM region UNION ALL SELECT 'given', n_name FROM nation")
def files_preferred(spark, d):
    up, given = table(spark, d, "region").select(F.col("r_name").alias("name")), table(spark, d, "nation").select(F.col("n_name").alias("name"))
    first = views.preferred(up, given).select(F.lit("uploads").alias("kind"), "name")
    return first.unionByName(views.preferred(up.limit(0), given).select(F.lit("given").alias("kind"), "name"))


@query("number_display", """
SELECT l_orderkey, l_linenumber, printf('%.2f', l_extendedprice) AS fixed, greatest(0.5::DOUBLE, least(2.0::DOUBLE, l_discount * 30)) AS zoom, CAST(floor(l_quantity / 3 + 0.5) AS BIGINT) AS rounded FROM lineitem
""")
def number_display(spark, d):
    items = table(spark, d, "lineitem")
    return items.select(
        "l_orderkey", "l_linenumber", F.format_string("%.2f", "l_extendedprice").alias("fixed"),
        scalars.clamp(F.col("l_discount") * 30, 0.5, 2.0).alias("zoom"), scalars.round_half_up(F.col("l_quantity") / 3).alias("rounded"),
    )


@query("date_display", "SELECT event_id, strftime(ts, '%-m/%-d/%Y, %-I:%M:%S %p') AS shown FROM events")
def date_display(spark, d):
    return table(spark, d, "events").select("event_id", views.date_shown(F.col("ts")).alias("shown"))


@query("quoted_snippets", """
SELECT conv_id, turn, substr(text, 1, 50) || '...' AS server, substr(text, 1, 40) || CASE WHEN length(text) > 40 THEN '...' ELSE '' END AS client
FROM conversations WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''
""")
def quoted_snippets(spark, d):
    text = F.col("text")
    said = table(spark, d, "conversations").where(views.not_blank(text))
    return said.select("conv_id", "turn", views.quoted(text, 50, always=True).alias("server"), views.quoted(text, 40).alias("client"))


@query("conv_prepend", "SELECT r_name AS title, CAST(r_regionkey + 1 AS INTEGER) AS pos FROM region UNION ALL SELECT 'New Chat', 0")
def conv_prepend(spark, d):
    have = table(spark, d, "region").select(F.col("r_name").alias("title"), F.col("r_regionkey").alias("pos"))
    return views.prepended(have, spark.createDataFrame([("New Chat",)], "title string"), "pos")


@query("child_fields", "SELECT unnest(['event_id', 'ts', 'user_id', 'value', 'props']) AS name")
def child_fields(spark, d):
    names = spark.createDataFrame([(c,) for c in table(spark, d, "events").columns], "name string")
    return names.where(F.col("name") != "event_type")
