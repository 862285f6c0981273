"""Content blocks, sample series, edits of lists and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.catalog.registry import query, table, values
from larkspur.functions import scalars
from larkspur.operators import blocks, documents as docs, jobs, views

_EVERY = """[{"type": "table", "data": {"columns": ["a"], "sortable": false}}, {"type": "json-explorer", "data": {"maxDepth": 0}}, {"type": "timeline"},
 {"type": "diagram", "data": {"type": "aws", "showControls": true}}, {"type": "file-upload-download", "data": {"mode": "upload", "multiple": false}},
 {"type": "markdown", "data": {"content": "hi"}}, {"type": "chart", "data": {"dataset": []}}, {"type": "collapsible"}]"""
_FIELDS = [
    ("0", "table", "columns", '["a"]'), ("0", "table", "rows", "[]"), ("0", "table", "showRowNumbers", "true"), ("0", "table", "sortable", "false"),
    ("1", "json-explorer", "data", "{}"), ("1", "json-explorer", "collapsed", "false"), ("1", "json-explorer", "maxDepth", "3"),
    ("2", "timeline", "events", "[]"), ("2", "timeline", "orientation", "vertical"), ("2", "timeline", "showTime", "true"),
    ("3", "diagram", "type", "aws"), ("3", "diagram", "diagram", ""), ("3", "diagram", "theme", "light"), ("3", "diagram", "interactive", "true"), ("3", "diagram", "showControls", "true"),
    ("4", "file-upload-download", "mode", "upload"), ("4", "file-upload-download", "files", "[]"), ("4", "file-upload-download", "multiple", "false"), ("4", "file-upload-download", "showFileList", "true"),
    ("5", "markdown", "content", "hi"), ("7", "collapsible", "title", "Section"), ("7", "collapsible", "defaultExpanded", "false"),
]


@query("block_fields", f"SELECT 1 AS id, * FROM (VALUES {values(_FIELDS)}) AS t(pos, type, field, value)")
def block_fields(spark, d):
    return blocks.block_fields(spark.createDataFrame([(1, _EVERY)], "id int, blocks string"), "id", "blocks")


@query("sample_series", f"SELECT kind, name, value FROM (VALUES {values([('pie', 'Success', 1250), ('pie', 'Warning', 150), ('pie', 'Error', 75), ('pie', 'Info', 200), ('bar', 'Mon', 1200), ('bar', 'Tue', 1350), ('bar', 'Wed', 1100), ('bar', 'Thu', 1450), ('bar', 'Fri', 1300), ('bar', 'Sat', 980), ('bar', 'Sun', 1050)])}) AS t(kind, name, value)")
def sample_series(spark, d):
    pie, bar = (blocks.sample_series(spark, k).select(F.lit(k).alias("kind"), "name", "value") for k in ("pie", "bar"))
    return pie.unionByName(bar)


@query("hour_series", "SELECT format('{:02d}:00', i) AS time, true AS counts, true AS averages, true AS requests, true AS errors FROM range(24) AS t(i)")
def hour_series(spark, d):
    hours, chart = blocks.hour_series(spark), blocks.sample_series(spark, "timechart")
    return hours.join(chart, "time").select(
        "time", F.col("count").between(500, 1499).alias("counts"), ((F.col("avg") >= 50) & (F.col("avg") < 150)).alias("averages"),
        F.col("requests").between(500, 1499).alias("requests"), F.col("errors").between(10, 59).alias("errors"),
    )


@query("chart_legacy_values", "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS label, count(*) AS value FROM events GROUP BY 1")
def chart_legacy_values(spark, d):
    days = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("value"))
    return days.select(F.col("date").alias("label"), "value")


@query("priority_colors", """
SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN '#dc2626' WHEN '2-HIGH' THEN '#ea580c' WHEN '3-MEDIUM' THEN '#f59e0b' WHEN '5-LOW' THEN '#10b981' ELSE 'transparent' END AS color, count(*) AS n
FROM orders GROUP BY o_orderpriority
""")
def priority_colors(spark, d):
    word = F.lower(F.substring_index("o_orderpriority", "-", -1))
    kind = F.when(word == "urgent", "critical").otherwise(word)
    return table(spark, d, "orders").groupBy("o_orderpriority", docs.lookup(kind, docs.PRIORITY_COLORS, "transparent").alias("color")).agg(F.count("*").alias("n"))


@query("uploads_appended", "SELECT r_name AS name, r_regionkey::BIGINT AS size, TIMESTAMP '2024-01-01' AS uploaded_at FROM region UNION ALL VALUES ('b.log', 5::BIGINT, TIMESTAMP '2024-02-01')")
def uploads_appended(spark, d):
    have = table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("size"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'").alias("uploaded_at"))
    more = spark.createDataFrame([("a.log", 20_971_520), ("b.log", 5)], "name string, size long")
    return views.appended_uploads(have, more, F.col("size") <= 10_485_760, F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"))


@query("row_ids", "SELECT count(*) AS n, count(*) AS uuids, count(*) AS numbers FROM nation")
def row_ids(spark, d):
    named = jobs.with_ids(table(spark, d, "nation")).withColumnRenamed("id", "uuid")
    return jobs.with_ids(named, "n_name").agg(F.count("*").alias("n"), F.count_distinct("uuid").alias("uuids"), F.count_distinct("id").alias("numbers"))


@query("sequential_ids", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS id FROM customer")
def sequential_ids(spark, d):
    return jobs.with_ids(table(spark, d, "customer").select("c_custkey"), "c_custkey")


@query("pretty_props", "SELECT event_id, '{' || chr(10) || '  \"k\": ' || CAST(json_extract(props, '$.k') AS VARCHAR) || chr(10) || '}' AS shown FROM events")
def pretty_props(spark, d):
    return table(spark, d, "events").select("event_id", scalars.pretty_json("props").alias("shown"))


@query("locale_numbers", r"SELECT l_orderkey, l_linenumber, regexp_replace(format('{:,.3f}', round(l_extendedprice / 7, 3)), '\.?0+$', '') AS shown FROM lineitem")
def locale_numbers(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.locale_number(F.col("l_extendedprice") / 7).alias("shown"))
