"""Pipe and SQL queries, table view, search, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.catalog.registry import query, table
from larkspur.engine import Engine
from larkspur.functions.scalars import single_value
from larkspur.operators import profiling, search, tables, text_index
from larkspur.operators.conversations import get
from larkspur.plans import spl
from larkspur.sources.indexes import Indexes


@query("spl_stats_count_by", """
SELECT event_type, n AS count, CAST(row_number() OVER (ORDER BY n DESC, event_type) AS INTEGER) AS rn
FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
""")
def spl_stats_count_by(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark, d).execute("index=events | stats count by event_type | sort -count", "spl").rows


@query("spl_stats_count_total", "SELECT count(*) AS count FROM events")
def spl_stats_count_total(spark, d):
    return Engine(spark, d).execute("index=events | stats count", "spl").rows


@query("spl_stats_sum_avg_by", "SELECT event_type, round(sum(value), 4) AS sum_value, round(avg(value), 4) AS avg_value FROM events GROUP BY event_type")
def spl_stats_sum_avg_by(spark, d):
    found = Engine(spark, d).execute("index=events | stats sum(value), avg(value) by event_type", "spl").rows
    return found.select("event_type", *[F.round(c, 4).alias(c) for c in ("sum_value", "avg_value")])


@query("spl_timechart_hour", """
SELECT _time, coalesce(count, 0) AS count, avg_value FROM (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS _time FROM events)
LEFT JOIN (SELECT date_trunc('hour', ts) AS _time, count(*) AS count, round(avg(value), 4) AS avg_value FROM events GROUP BY 1) USING (_time)
""")
def spl_timechart_hour(spark, d):
    found = Engine(spark, d).execute("index=events | timechart count, avg(value)", "spl").rows
    return found.withColumn("avg_value", F.round("avg_value", 4))


@query("spl_timechart_by_type", "SELECT date_trunc('hour', ts) AS _time, event_type, count(*) AS count FROM events GROUP BY 1, 2")
def spl_timechart_by_type(spark, d):
    return Engine(spark, d).execute("index=events | timechart span=1h limit=0 count by event_type", "spl").rows


@query("spl_timechart_top", """
WITH sized AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) AS nth FROM events GROUP BY event_type
), b AS (SELECT time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') AS _time, least(nth, 3) AS nth FROM events JOIN sized USING (event_type)
), spine AS (SELECT unnest(generate_series(min(_time), max(_time), INTERVAL 3 HOUR)) AS _time FROM b)
SELECT _time, count(*) FILTER (nth = 1) AS first, count(*) FILTER (nth = 2) AS second, count(*) FILTER (nth = 3) AS other FROM spine LEFT JOIN b USING (_time) GROUP BY _time
""")
def spl_timechart_top(spark, d):
    """The columns are named by the data; here by their place."""
    return Engine(spark, d).execute("index=events | timechart span=3h limit=2 count by event_type", "spl").rows.toDF("_time", "first", "second", "other")


@query("spl_timechart_sparse", """
WITH e AS (SELECT ts, value, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id % 50 END AS who FROM events WHERE value > 100
), sized AS (SELECT coalesce(CAST(who AS VARCHAR), 'NULL') AS who, row_number() OVER (ORDER BY round(sum(value), 6) DESC, coalesce(CAST(who AS VARCHAR), 'NULL')) AS nth FROM e GROUP BY 1
), b AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS _time, least(nth, 3) AS nth, value FROM e JOIN sized ON sized.who = coalesce(CAST(e.who AS VARCHAR), 'NULL')
), spine AS (SELECT unnest(generate_series(min(_time), max(_time), INTERVAL 15 MINUTE)) AS _time FROM b)
SELECT _time, round(sum(value) FILTER (nth = 1), 4) AS first_sum, round(avg(value) FILTER (nth = 1), 4) AS first_avg, round(sum(value) FILTER (nth = 2), 4) AS second_sum, round(avg(value) FILTER (nth = 2), 4) AS second_avg,
  round(sum(value) FILTER (nth = 3), 4) AS other_sum, round(avg(value) FILTER (nth = 3), 4) AS other_avg
FROM spine LEFT JOIN b USING (_time) GROUP BY _time
""")
def spl_timechart_sparse(spark, d):
    """Spans without rows, series of nulls, and two aggregates a series."""
    rows = table(spark, d, "events").where("value > 100").withColumn("who", F.when(F.col("event_id") % 7 != 0, F.col("user_id") % 50))
    chart = spl.compiled(spl.parse("index=events | timechart span=15m limit=2 sum(value), avg(value) by who"), lambda _: rows)
    names = ["first_sum", "first_avg", "second_sum", "second_avg", "other_sum", "other_avg"]
    return chart.toDF("_time", *names).select("_time", *[F.round(n, 4).alias(n) for n in names])


_CUSTOMERS = """
SELECT c_custkey, c_name, c_acctbal, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS INT) AS rn
FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 100
"""


@query("sql_filter_sort_limit", _CUSTOMERS)
def sql_filter_sort_limit(spark, d):
    return Engine(spark, d).execute(_CUSTOMERS, "sql").rows


@query("gauge_error_percent", "SELECT round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 4) AS value, CAST(100 AS INTEGER) AS max FROM events")
def gauge_error_percent(spark, d):
    share = F.round(F.count_if(F.col("event_type") == "error") * 100.0 / F.count("*"), 4)
    return table(spark, d, "events").agg(share.alias("value"), F.lit(100).alias("max"))


@query("single_value_formatted", "SELECT format('{:,}', count(*)) AS shown FROM lineitem")
def single_value_formatted(spark, d):
    return table(spark, d, "lineitem").agg(single_value(F.count("*")).alias("shown"))


@query("single_value_unit", "SELECT regexp_replace(format('{:,.3f}', round(sum(o_totalprice) / 1000, 3)), '\\.?0+$', '') || ' k' AS shown FROM orders")
def single_value_unit(spark, d):
    return table(spark, d, "orders").agg(single_value(F.sum("o_totalprice") / 1000, " k").alias("shown"))


@query("index_names", "SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) AS name")
def index_names(spark, d):
    return spark.createDataFrame([(n,) for n in Indexes(spark, d).names()], "name string")


@query("index_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def index_sample(spark, d):
    return Indexes(spark, d).load("orders", "sample", "o_orderkey", "not a number").select("o_orderkey", "o_totalprice")


@query("point_lookup", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def point_lookup(spark, d):
    orders = table(spark, d, "orders")
    return get(orders, "o_orderkey", orders.agg(F.min("o_orderkey")).first()[0]).select("o_orderkey", "o_orderstatus")


@query("table_sort_numeric", """
WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(rn AS INTEGER) AS rn FROM t WHERE rn > 50 AND rn <= 100
""")
def table_sort_numeric(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return tables.sorted_page(items, "l_extendedprice", "pos", descending=True, page=2).drop("pos")


@query("table_sort_text", """
SELECT p_partkey, p_name, CAST(rn AS INTEGER) AS rn FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS rn FROM part) WHERE rn <= 50
""")
def table_sort_text(spark, d):
    return tables.sorted_page(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@query("table_sort_iso_date", """
SELECT o_orderkey, day, CAST(rn AS INTEGER) AS rn
FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (ORDER BY year(o_orderdate), o_orderkey) AS rn FROM orders) WHERE rn <= 50
""")
def table_sort_iso_date(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return tables.sorted_page(orders, "day", "o_orderkey")


@query("table_page_info", "SELECT count(*) AS total_rows, least(count(*), 100) AS shown_rows, CAST(ceil(least(count(*), 100) / 50) AS BIGINT) AS pages FROM orders")
def table_page_info(spark, d):
    return tables.page_info(table(spark, d, "orders"))


@query("search_multi_key", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'mach') OR contains(lower(c_mktsegment), 'mach')")
def search_multi_key(spark, d):
    return search.search(table(spark, d, "customer"), "MACH").select("c_custkey", "c_name")


@query("search_with_filters", """
SELECT p_partkey, p_name, p_brand, greatest((SELECT count(*) FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(p_brand), '1')) - 10, 0) AS more
FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(p_brand), '1') ORDER BY p_partkey LIMIT 10
""")
def search_with_filters(spark, d):
    found = search.search(table(spark, d, "part"), "a", ["p_name"], {"p_brand": "1", "p_type": ""})
    return search.first_results(found.select("p_partkey", "p_name", "p_brand"), "p_partkey")


@query("search_falsy_cells", "SELECT count(*) AS n FROM lineitem WHERE l_tax <> 0 AND contains(CAST(l_tax AS VARCHAR), '0')")
def search_falsy_cells(spark, d):
    return search.search(table(spark, d, "lineitem"), "0", ["l_tax"]).agg(F.count("*").alias("n"))


@query("search_indexed", """
SELECT item_id, doc_id FROM (SELECT item_id, substring(text, 1, 40) AS needle FROM benchmark) AS b JOIN documents AS d ON contains(lower(d.text), lower(needle)) WHERE needle <> ''
""")
def search_indexed(spark, d):
    """The documents that hold the beginning of each benchmark item, by a substring index."""
    index = text_index.build(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")
    needles = table(spark, d, "benchmark").select("item_id", F.substring("text", 1, 40).alias("needle"))
    return index.search(needles).select("needle", "doc_id").join(needles, "needle").select("item_id", "doc_id")


@query("search_counts", "SELECT count(*) FILTER (contains(lower(text), 'data')) AS shown, count(*) AS total FROM documents")
def search_counts(spark, d):
    return search.shown_of(table(spark, d, "documents"), F.contains(F.lower("text"), F.lit("data")))


@query("filter_keys", "SELECT unnest(['p_name', 'p_brand', 'p_type']) AS name")
def filter_keys(spark, d):
    return spark.createDataFrame([(n,) for n in search.filter_columns(table(spark, d, "part"))], "name string")


_PROFILED = ("event_id", "ts", "event_type", "props")
_TS = profiling.TIMESTAMP.replace("'", "''")


@query("profile_events", " UNION ALL ".join(f"""
SELECT '{c}' AS field, count(*) AS n, count(*) FILTER (t IS NULL) AS nulls,
  count(*) FILTER (regexp_matches(t, '{profiling.BOOLEAN}')) AS n_boolean, count(*) FILTER (regexp_matches(t, '{profiling.NUMBER}')) AS n_number,
  count(*) FILTER (regexp_matches(t, '{_TS}')) AS n_timestamp, count(*) FILTER (regexp_matches(t, '{profiling.IP}')) AS n_ip,
  count(*) FILTER (regexp_matches(t, '{profiling.URL}')) AS n_url, '{kind}' AS type FROM (SELECT CAST({c} AS VARCHAR) AS t FROM events)
""" for c, kind in zip(_PROFILED, ("number", "timestamp", "string", "string"))))
def profile_events(spark, d):
    return profiling.profile(table(spark, d, "events"), list(_PROFILED))


@query("profile_urls", "SELECT 'url' AS field, count(*) FILTER (regexp_matches(url, '^https?://[^ ]+$')) AS n_url, count(*) AS n, 'url' AS type FROM pages")
def profile_urls(spark, d):
    return profiling.profile(table(spark, d, "pages"), ["url"]).select("field", "n_url", "n", "type")


@query("profile_samples", """
WITH v AS (SELECT DISTINCT event_type AS v FROM events)
SELECT (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT v FROM v ORDER BY v LIMIT 3)) AS samples, greatest(count(*) - 3, 0) AS more FROM v
""")
def profile_samples(spark, d):
    return profiling.samples(table(spark, d, "events"), "event_type")


@query("relation_parent_child", "SELECT DISTINCT event_type AS value, CAST(user_id AS VARCHAR) AS child FROM events")
def relation_parent_child(spark, d):
    return profiling.children(table(spark, d, "events"), "event_type", "user_id")


@query("relation_cardinality", """
WITH p AS (SELECT DISTINCT p_brand, p_type FROM part), a AS (SELECT count(*) AS n FROM p GROUP BY p_brand), b AS (SELECT count(*) AS n FROM p GROUP BY p_type),
m AS (SELECT (SELECT max(n) FROM a) AS children_per_parent, (SELECT max(n) FROM b) AS parents_per_child)
SELECT *, CASE WHEN children_per_parent > 1 AND parents_per_child > 1 THEN 'many-to-many' WHEN children_per_parent > 1 THEN 'one-to-many' WHEN parents_per_child > 1 THEN 'many-to-one' ELSE 'one-to-one' END AS cardinality FROM m
""")
def relation_cardinality(spark, d):
    return profiling.cardinality(table(spark, d, "part"), "p_brand", "p_type")


@query("active_users", "SELECT count(DISTINCT user_id) AS active_connections FROM events")
def active_users(spark, d):
    return table(spark, d, "events").agg(F.count_distinct("user_id").alias("active_connections"))


#: Columns of the given tables; those of numbers with a fraction are left out, as engines print them differently.
PLAIN = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_mktsegment", "supplier": "s_suppkey s_name s_nationkey",
    "part": "p_partkey p_name p_brand p_type p_size", "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority", "lineitem": "l_orderkey l_partkey l_linenumber l_returnflag l_linestatus",
    "events": "event_id ts user_id event_type props", "documents": "doc_id text lang source n_chars", "embeddings": "vec_id label", "pages": "page_id url html",
    "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}
_KIND = " ".join(f"WHEN n > nulls AND n_{k} = n - nulls THEN '{k}'" for k, _ in profiling.PROBES)
_KNOWN = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in profiling.CATEGORIES.items())
_DESCRIBED = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in profiling.DESCRIPTIONS.items())
_PROFILE = " UNION ALL ".join(f"""
SELECT '{t}' AS tab, '{c}' AS field, count(*) AS n, count(*) FILTER (v IS NULL) AS nulls, {", ".join(f"count(*) FILTER (regexp_matches(v, '{p.replace(chr(39), chr(39) * 2)}')) AS n_{k}" for k, p in profiling.PROBES)},
  list_sort(list(DISTINCT CASE WHEN length(v) <= 200 THEN v ELSE left(v, 200) || '…' || md5(v) END) FILTER (v IS NOT NULL)) AS vs FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {t})
""" for t, cs in PLAIN.items() for c in cs.split())


@query("profile_every_table", f"""
WITH p AS ({_PROFILE}), k AS (SELECT *, CASE {_KIND} ELSE 'string' END AS type FROM p)
SELECT tab, field, n, nulls, type, coalesce(CASE field {_DESCRIBED} END, 'Field ' || field || ' contains data related to the event') AS description,
  coalesce(CASE lower(field) {_KNOWN} END, CASE type WHEN 'timestamp' THEN 'Time' WHEN 'ip' THEN 'Network' END) AS category,
  coalesce(array_to_string(vs[1:3], ','), '') AS samples, CAST(greatest(coalesce(len(vs), 0) - 3, 0) AS BIGINT) AS more
FROM k
""")
def profile_every_table(spark, d):
    """Types, three samples and how many more of all columns, a scan a table."""
    out = None
    for name, columns in PLAIN.items():
        found = profiling.full_profile(table(spark, d, name), columns.split()).select(F.lit(name).alias("tab"), "*")
        out = found if out is None else out.unionByName(found)
    return out


_RELATED = {"events": ("event_id", "user_id", "event_type", "props"), "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size")}


_PAIRS = " UNION ALL ".join(f"""
SELECT '{t}' AS tab, '{a}' AS parent, '{b}' AS child, (SELECT max(n) FROM (SELECT count(DISTINCT {b}) AS n FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a})) AS children_per_parent,
  (SELECT max(n) FROM (SELECT count(DISTINCT {a}) AS n FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {b})) AS parents_per_child
""" for t, cs in _RELATED.items() for i, a in enumerate(cs) for b in cs[i + 1 :])


@query("relations_of_all_pairs", f"""
SELECT *, CASE WHEN children_per_parent > 1 AND parents_per_child > 1 THEN 'many-to-many' WHEN children_per_parent > 1 THEN 'one-to-many' WHEN parents_per_child > 1 THEN 'many-to-one' ELSE 'one-to-one' END AS cardinality FROM ({_PAIRS})
""")
def relations_of_all_pairs(spark, d):
    first, *rest = (profiling.pair_relations(table(spark, d, t), list(cs)).select(F.lit(t).alias("tab"), "*") for t, cs in _RELATED.items())
    return first.unionByName(rest[0])
