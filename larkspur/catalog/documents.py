"""Charts, JSON, checklists, forms, files and diagrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.catalog.registry import literal, query, table
from larkspur.functions import scalars
from larkspur.operators import documents as docs

_KINDS = ["click", "error", "login", "purchase", "view"]


@query("chart_wide_series", f"SELECT strftime(ts, '%H:00') AS label, {', '.join(f'''count(*) FILTER (event_type = '{k}') AS {k}''' for k in _KINDS)} FROM events GROUP BY 1")
def chart_wide_series(spark, d):
    return docs.wide_counts(table(spark, d, "events"), scalars.hour_label(F.col("ts")), "event_type", _KINDS)


@query("chart_pie", f"""
SELECT event_type AS label, count(*) AS value, (row_number() OVER (ORDER BY event_type) - 1)::INT AS idx,
  {literal(docs.PALETTE)}[row_number() OVER (ORDER BY event_type)] AS color FROM events GROUP BY event_type
""")
def chart_pie(spark, d):
    from pyspark.sql import Window

    counts = table(spark, d, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("value"))
    counts = counts.withColumn("idx", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))
    return counts.withColumn("color", docs.slice_color(F.col("idx")))


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


_DAYS = "ceil((epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '2000-01-01')) / 86400000.0)::BIGINT"


@query("due_labels", f"""
SELECT o_orderkey, CASE WHEN n < 0 THEN 'Overdue (' || abs(n) || ' days)' WHEN n = 0 THEN 'Due today' WHEN n = 1 THEN 'Due tomorrow' ELSE 'Due in ' || n || ' days' END AS label,
  o_orderdate < TIMESTAMP '2000-01-01' AS overdue FROM (SELECT *, {_DAYS} AS n FROM orders)
""")
def due_labels(spark, d):
    as_of = F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'")
    return table(spark, d, "orders").select("o_orderkey", scalars.due_label(F.col("o_orderdate"), as_of).alias("label"), scalars.is_overdue(F.col("o_orderdate"), as_of).alias("overdue"))


@query("file_size_documents", """
WITH s AS (SELECT doc_id, n_chars AS n, CASE WHEN n_chars >= 1024 THEN floor(n_chars / 1024.0::DOUBLE * 100 + 0.5) / 100 ELSE n_chars END AS v FROM documents)
SELECT doc_id, CASE WHEN n = 0 THEN '0 Bytes' ELSE regexp_replace(printf('%.2f', v::DOUBLE), '\\.?0+$', '') || CASE WHEN n >= 1024 THEN ' KB' ELSE ' Bytes' END END AS shown FROM s
""")
def file_size_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.file_size(F.col("n_chars")).alias("shown"))


@query("event_icons", f"""
SELECT event_type, CASE event_type WHEN 'error' THEN '✗' ELSE '●' END AS icon, CASE event_type WHEN 'error' THEN '#ef4444' ELSE '#0088FE' END AS color, count(*) AS n FROM events GROUP BY event_type
""")
def event_icons(spark, d):
    icon, color = docs.lookup(F.col("event_type"), docs.EVENT_ICONS, "●"), docs.lookup(F.col("event_type"), docs.EVENT_COLORS, "#0088FE")
    return table(spark, d, "events").groupBy("event_type", icon.alias("icon"), color.alias("color")).agg(F.count("*").alias("n"))
