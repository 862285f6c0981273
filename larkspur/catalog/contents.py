"""Catalogues, lists, trees, blocks and labels over rows of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.catalog.registry import literal, query, table, values
from larkspur.functions import scalars
from larkspur.operators import blocks, conversations as conv, documents as docs, profiling, search, views

# parts as the entries of a catalogue
_CATALOG = "(SELECT p_partkey AS pos, p_name AS name, p_type AS description, p_brand AS category, CASE WHEN p_size > 45 THEN true WHEN p_size > 5 THEN false END AS featured, string_split(p_name, ' ') AS tags FROM part)"


def _catalog(spark, d):
    featured = F.when(F.col("p_size") > 45, True).when(F.col("p_size") > 5, False)
    return table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("category"), featured.alias("featured"), F.split("p_name", " ").alias("tags"))


@query("catalog_tag_search", f"""
SELECT pos, name, array_to_string(tags[1:2], ',') AS shown_tags FROM {_CATALOG}
WHERE (contains(lower(name), 'widget') OR contains(lower(description), 'widget') OR len([1 FOR t IN tags IF contains(lower(t), 'widget')]) > 0) AND category = 'Brand#13'
""")
def catalog_tag_search(spark, d):
    return search.catalog_search(_catalog(spark, d), "WIDGET", "Brand#13").select("pos", "name", F.array_join(F.slice("tags", 1, 2), ",").alias("shown_tags"))


@query("catalog_featured", f"""
SELECT pos, 'featured' AS list FROM {_CATALOG} WHERE coalesce(featured, false)
UNION ALL SELECT pos, 'other' FROM {_CATALOG} WHERE NOT coalesce(featured, false) AND (contains(lower(name), 'wid') OR contains(lower(description), 'wid'))
""")
def catalog_featured(spark, d):
    first, other = search.featured(_catalog(spark, d), "wid")
    return first.select("pos", F.lit("featured").alias("list")).unionByName(other.select("pos", F.lit("other").alias("list")))


@query("catalog_featured_shown", f"SELECT 'all' AS asked, pos FROM {_CATALOG} WHERE featured")
def catalog_featured_shown(spark, d):
    asked = [("all", "", "All"), ("query", "s", "All"), ("category", "", "Brand#1")]
    first, *rest = (search.featured_shown(_catalog(spark, d), q, c).select(F.lit(name).alias("asked"), "pos") for name, q, c in asked)
    for more in rest:
        first = first.unionByName(more)
    return first


@query("catalog_categories", f"SELECT 'All' AS category, CAST(-1 AS BIGINT) AS pos UNION ALL SELECT category, CAST(min(pos) AS BIGINT) FROM {_CATALOG} GROUP BY category")
def catalog_categories(spark, d):
    return search.categories(_catalog(spark, d), "pos")


@query("documentation_search", "SELECT p_partkey, p_name AS name FROM part WHERE p_brand = 'Brand#3' AND (contains(lower(p_name), 'co') OR contains(lower(p_type), 'co') OR contains(lower(p_brand), 'co'))")
def documentation_search(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("type"), F.col("p_brand").alias("category"))
    return views.documentation_search(parts, "CO", "Brand#3").select("p_partkey", "name")


@query("tag_lists", "SELECT p_partkey, p_name || '|' || p_brand || '|' || p_type AS tags FROM part")
def tag_lists(spark, d):
    text = F.concat(F.lit(" "), "p_name", F.lit(", "), "p_brand", F.lit(" ,, "), "p_type", F.lit(" ,"))
    return table(spark, d, "part").select("p_partkey", F.array_join(scalars.split_tags(text), "|").alias("tags"))


_POINTS = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS time, CASE WHEN event_id % 5 <> 0 THEN 'u' || user_id END AS name, CASE WHEN event_id % 4 <> 0 THEN value END AS value FROM events"


def _points(spark, d):
    e = F.col("event_id")
    time, name = F.when(e % 3 == 0, "").otherwise(F.col("event_type")), F.when(e % 5 != 0, F.concat(F.lit("u"), "user_id"))
    return table(spark, d, "events").select("event_id", time.alias("time"), name.alias("name"), F.when(e % 4 != 0, F.col("value")).alias("value"))


@query("chart_labels", f"SELECT coalesce(nullif(time, ''), name, '') AS label, coalesce(value, 0) AS value, CAST(event_id AS DOUBLE) AS event_id FROM ({_POINTS})")
def chart_labels(spark, d):
    return docs.chart_series(_points(spark, d), "time", ["value", "event_id"])


@query("chart_number_labels", "SELECT CASE WHEN l_quantity % 10 <> 0 THEN CAST(CAST(l_quantity % 10 AS BIGINT) AS VARCHAR) ELSE l_returnflag END AS label, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY l_quantity % 10, l_returnflag")
def chart_number_labels(spark, d):
    """A label that is the number 0 is skipped for the name."""
    time = (F.col("l_quantity") % 10).cast("long")
    return docs.chart_series(table(spark, d, "lineitem").groupBy(time.alias("time"), F.col("l_returnflag").alias("name")).agg(F.count("*").alias("n")), "time", ["n"])


@query("chart_pie_labels", f"SELECT coalesce(nullif(time, ''), name, CAST(CAST(value * 100 AS BIGINT) AS VARCHAR)) AS label, coalesce(CAST(value * 100 AS BIGINT), 0)::DOUBLE AS value FROM ({_POINTS})")
def chart_pie_labels(spark, d):
    cents = F.round(F.col("value") * 100).cast("long")
    return blocks.pie_slices(_points(spark, d).withColumn("value", cents), "time")


@query("chart_palette", f"SELECT p_partkey, CAST(p_size % 9 AS INT) AS idx, {literal(docs.PALETTE)}[p_size % 9 % 6 + 1] AS series, CASE WHEN p_size % 9 < 6 THEN {literal(docs.PALETTE)}[p_size % 9 + 1] END AS slice FROM part")
def chart_palette(spark, d):
    idx = (F.col("p_size") % 9).cast("int")
    return table(spark, d, "part").select("p_partkey", idx.alias("idx"), docs.series_color(idx).alias("series"), docs.slice_color(idx).alias("slice"))


@query("alert_icons", "SELECT event_type, CASE event_type WHEN 'error' THEN '✗' ELSE '' END AS icon, count(*) AS n FROM events GROUP BY event_type")
def alert_icons(spark, d):
    return table(spark, d, "events").groupBy("event_type", docs.lookup(F.col("event_type"), docs.ALERT_ICONS, "").alias("icon")).agg(F.count("*").alias("n"))


# an event as a JSON text of every kind of value, with lists of 0 to 2 entries, five levels deep
_DOC = """SELECT event_id, json_object(
    'user', json_object('id', user_id, 'name', 'u' || user_id, 'email', 'u' || user_id || '@example.com', 'preferences', json_object('theme', event_type, 'notifications', value > 100), 'tags', [event_type, 'u' || user_id][:event_id % 3]),
    'metadata', json_object('created', CAST(ts AS VARCHAR), 'updated', NULL, 'history', [json_object('value', value, 'props', TRY_CAST(props AS JSON))]),
    'props', TRY_CAST(props AS JSON)) AS doc FROM events"""


def _docs(spark, d):
    props, name = F.try_parse_json("props").alias("props"), F.concat(F.lit("u"), "user_id")
    preferences = F.struct(F.col("event_type").alias("theme"), (F.col("value") > 100).alias("notifications"))
    tags = F.slice(F.array("event_type", name), 1, (F.col("event_id") % 3).cast("int"))
    user = F.struct(F.col("user_id").alias("id"), name.alias("name"), F.concat(name, F.lit("@example.com")).alias("email"), preferences.alias("preferences"), tags.alias("tags"))
    history = F.array(F.struct("value", props))
    metadata = F.struct(F.col("ts").cast("string").alias("created"), F.lit(None).cast("string").alias("updated"), history.alias("history"))
    doc = F.struct(user.alias("user"), metadata.alias("metadata"), props)
    return table(spark, d, "events").select("event_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("doc"))


@query("json_tree_counts", f"""
WITH RECURSIVE d AS ({_DOC}), tree AS (
  SELECT event_id, '$' AS path, 0 AS depth, doc AS value FROM d
  UNION ALL SELECT t.event_id, t.path || '.' || e.key, t.depth + 1, e.value FROM tree AS t, json_each(t.value) AS e WHERE json_type(t.value) IN ('OBJECT', 'ARRAY')
)
SELECT event_id, path, depth,
  CASE json_type(value) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
  CAST(CASE json_type(value) WHEN 'OBJECT' THEN len(json_keys(value)) WHEN 'ARRAY' THEN json_array_length(value) ELSE 0 END AS INT) AS children FROM tree
""")
def json_tree_counts(spark, d):
    return docs.json_tree(_docs(spark, d), "doc", keys=["event_id"])


# conversations as lists of their messages, ticked where a user wrote
_ITEMS = """
SELECT 'c' || conv_id AS id, NULL AS parent_id, conv_id % 3 = 0 AS checked FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT DISTINCT 'c' || conv_id || '-' || turn, 'c' || conv_id, role = 'user' FROM conversations
"""


def _items(spark, d):
    said = table(spark, d, "conversations").select("conv_id", "turn", "role").distinct()
    key = F.concat(F.lit("c"), "conv_id")
    lists = said.select("conv_id").distinct().select(key.alias("id"), F.lit(None).cast("string").alias("parent_id"), (F.col("conv_id") % 3 == 0).alias("checked"))
    return lists.unionByName(said.select(F.concat(key, F.lit("-"), "turn").alias("id"), key.alias("parent_id"), (F.col("role") == "user").alias("checked")).distinct())


@query("checklist_progress", f"""
WITH i AS ({_ITEMS}), below AS (
  SELECT parent_id AS id, count(*) AS n, floor(100.0::DOUBLE * count(*) FILTER (checked) / count(*) + 0.5) AS progress FROM i WHERE parent_id IS NOT NULL GROUP BY parent_id
)
SELECT (SELECT count(*) FROM i) AS total, (SELECT count(*) FILTER (checked) FROM i) AS checked,
  CAST(floor(100.0::DOUBLE * sum(CASE WHEN checked THEN 1 ELSE 0 END + coalesce(progress / 100 * n, 0)) / count(*) + 0.5) AS BIGINT) AS progress
FROM i LEFT JOIN below USING (id) WHERE parent_id IS NULL
""")
def checklist_progress(spark, d):
    return docs.checklist_totals(_items(spark, d))


@query("checklist_toggle", f"SELECT id, parent_id, checked OR id = 'c1' OR id = 'c1-0' AS checked FROM ({_ITEMS})")
def checklist_toggle(spark, d):
    return conv.toggled(conv.toggled(_items(spark, d), "c1", True), "c1-0", True)


@query("file_accept", """
SELECT page_id, size > 10485760 AS too_large, lower(string_split(name, '.')[-1]) AS extension,
  size <= 10485760 AND ('.' || lower(string_split(name, '.')[-1]) IN ('.log', '.json', '.pdf') OR coalesce(regexp_matches(type, 'image/.*'), false)) AS accepted
FROM (SELECT page_id, regexp_extract(url, '//([^/]*)', 1) || ['.log', '.JSON', '.tar.pdf', '.csv', ''][page_id % 5 + 1] AS name, strlen(html) * 2000 AS size, CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/plain' END AS type FROM pages)
""")
def file_accept(spark, d):
    page = F.col("page_id")
    ending = F.get(F.array(*[F.lit(e) for e in (".log", ".JSON", ".tar.pdf", ".csv", "")]), (page % 5).cast("int"))
    files = table(spark, d, "pages").select(
        "page_id", F.concat(F.regexp_extract("url", "//([^/]*)", 1), ending).alias("name"), (F.octet_length("html").cast("long") * 2000).alias("size"),
        F.when(page % 3 == 0, "image/png").when(page % 3 == 1, "text/plain").alias("type"),
    )
    large = F.col("size") > 10_485_760
    ok = scalars.accepts(F.col("name"), F.col("type"), ".log, .json, .pdf, image/*")
    return files.select("page_id", large.alias("too_large"), scalars.file_extension(F.col("name")).alias("extension"), (~large & ok).alias("accepted"))


@query("diagram_edges", r"""
WITH l AS (SELECT item_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS line FROM benchmark
), n AS (SELECT item_id, line, regexp_replace(x, '^\s+|\s+$', '', 'g') AS node FROM l
), i AS (SELECT item_id, node, (row_number() OVER (PARTITION BY item_id ORDER BY line) - 1)::INT AS idx FROM n WHERE node <> '')
SELECT item_id, idx, node, lead(node) OVER (PARTITION BY item_id ORDER BY idx) AS next, 100 + idx % 3 * 200 AS x, 100 + idx // 3 * 150 AS y,
  CASE WHEN idx < 6 THEN ['Presentation', 'Application', 'Data'][idx // 2 + 1] END AS layer FROM i
""")
def diagram_edges(spark, d):
    return docs.diagram(table(spark, d, "benchmark"), "item_id", "text")


# a message as a row of blocks: code without a language, an alert of its role's kind, and its text in a section
def _message_blocks(spark, d):
    said = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").distinct()
    code = F.struct(F.lit("code").alias("type"), F.struct(F.col("text").alias("code")).alias("data"))
    alert = F.struct(F.lit("alert").alias("type"), F.struct(F.col("role").alias("type")).alias("data"))
    inner = F.struct(F.lit("markdown").alias("type"), F.struct(F.col("text").alias("content")).alias("data"))
    section = F.struct(F.lit("collapsible").alias("type"), F.struct(F.when(F.col("role") != "user", F.col("role")).alias("title"), F.array(inner).alias("children")).alias("data"))
    waiting = F.struct(F.lit("async-placeholder").alias("type"), F.struct(F.concat(F.lit("j"), "conv_id").alias("jobId")).alias("data"))
    text = F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(b) for b in (code, alert, section, waiting)]), F.lit("]"))
    return said.select(F.concat("conv_id", F.lit("-"), "turn", F.lit("-"), F.md5("text")).alias("id"), text.alias("blocks"))


_SAID = "SELECT DISTINCT conv_id, turn, role, text, conv_id || '-' || turn || '-' || md5(text) AS id FROM conversations"


@query("block_dispatch", f"""
WITH m AS ({_SAID})
SELECT id, '0' AS pos, 0 AS depth, 'code' AS type, 'text' AS shown FROM m UNION ALL SELECT id, '1', 0, 'alert', role FROM m
UNION ALL SELECT id, '2', 0, 'collapsible', CASE WHEN role <> 'user' THEN role ELSE 'Section' END FROM m UNION ALL SELECT id, '2.0', 1, 'markdown', text FROM m
""")
def block_dispatch(spark, d):
    return blocks.rendered_blocks(_message_blocks(spark, d), "id", "blocks").where("type <> 'async-placeholder'")


@query("block_job_results", f"""
WITH m AS ({_SAID})
SELECT id, pos, depth, type FROM m, (VALUES ('0', 0, 'code'), ('1', 0, 'alert'), ('2', 0, 'collapsible'), ('2.0', 1, 'markdown'), ('3', 0, 'async-placeholder')) AS t(pos, depth, type)
UNION ALL SELECT id, pos, depth, type FROM m, (VALUES ('3.0', 1, 'collapsible'), ('3.0.0', 2, 'alert')) AS t(pos, depth, type) WHERE conv_id % 2 = 0
""")
def block_job_results(spark, d):
    """Jobs of even conversations are completed with a section that holds an alert; the others failed."""
    even = F.col("conv_id") % 2 == 0
    result = '{"blocks": [{"type": "collapsible", "data": {"children": [{"type": "alert"}]}}]}'
    known = table(spark, d, "conversations").select("conv_id").distinct()
    jobs = known.select(F.concat(F.lit("j"), "conv_id").alias("job_id"), F.when(even, "completed").otherwise("failed").alias("status"), F.lit(result).alias("result"))
    return blocks.nested_blocks(_message_blocks(spark, d), "id", "blocks", jobs).drop("value")


@query("set_toggle", """
SELECT user_id, array_to_string(CASE WHEN list_contains(ids, 'error') THEN [x FOR x IN ids IF x <> 'error'] ELSE list_append(ids, 'error') END, ',') AS toggled
FROM (SELECT user_id, list_sort(list(DISTINCT event_type)) AS ids FROM events GROUP BY user_id)
""")
def set_toggle(spark, d):
    ids = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("ids"))
    return ids.select("user_id", F.array_join(conv.symmetric_toggle(F.col("ids"), "error"), ",").alias("toggled"))


@query("timeline_order", """
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS BIGINT) AS pos, event_type AS type, 'e' || event_id AS title,
  CASE event_type WHEN 'error' THEN '✗' ELSE '●' END AS icon, CASE event_type WHEN 'error' THEN '#ef4444' ELSE '#0088FE' END AS color FROM events
""")
def timeline_order(spark, d):
    """Events of a user as a JSON array by value, and shown as they stand there and not by time."""
    one = F.struct("value", "event_id", F.struct(F.col("event_type").alias("type"), F.concat(F.lit("e"), "event_id").alias("title"), F.col("ts").cast("string").alias("timestamp")).alias("e"))
    users = table(spark, d, "events").groupBy("user_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["e"])).alias("events"))
    shown, kind = blocks.timeline(users, "user_id", "events"), F.col("type")
    return shown.withColumn("pos", F.col("pos").cast("long")).withColumn("icon", docs.lookup(kind, docs.EVENT_ICONS, "●")).withColumn("color", docs.lookup(kind, docs.EVENT_COLORS, "#0088FE"))


@query("job_read_view", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(json_extract(props, '$.k') AS INT) END AS days, event_id % 2 = 0 AS no_result FROM events")
def job_read_view(spark, d):
    e = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.when(e % 3 != 0, F.col("props")).otherwise("").alias("params"), F.when(e % 2 == 0, "").otherwise(F.col("props")).alias("result"))
    return views.job_view(rows).select("event_id", F.try_variant_get("params", "$.k", "int").alias("days"), F.col("result").isNull().alias("no_result"))


# customers as the fields of a form, a section a market segment
@query("form_sections", """
SELECT c_mktsegment AS section, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) - 1 AS INT) AS pos, c_name AS name, lower(c_name) AS label,
  CASE c_custkey % 3 WHEN 0 THEN CAST(c_nationkey AS VARCHAR) WHEN 1 THEN CASE WHEN c_nationkey = 0 THEN '✗ No' ELSE '✓ Yes' END ELSE CASE WHEN c_nationkey = 0 THEN '-' ELSE CAST(c_nationkey AS VARCHAR) END END AS shown FROM customer
""")
def form_sections(spark, d):
    people, key = table(spark, d, "customer"), F.col("c_custkey") % 3
    kind = F.when(key == 0, "number").when(key == 1, "boolean").otherwise("text")
    fields = people.select(F.col("c_custkey").alias("field_pos"), F.col("c_name").alias("name"), F.lower("c_name").alias("label"), F.col("c_nationkey").cast("string").alias("value"), kind.alias("type"), F.lit(None).cast("string").alias("link"))
    sections = people.groupBy(F.col("c_mktsegment").alias("title")).agg(F.array_append(F.array_sort(F.collect_list("c_name")), F.lit("missing")).alias("fields"))
    return docs.form_sections(sections, fields)


@query("section_fields", "SELECT p_brand, string_agg(p_name || ',' || p_type, ',' ORDER BY p_partkey) AS fields FROM part GROUP BY p_brand")
def section_fields(spark, d):
    one = F.struct("p_partkey", F.array("p_name", "p_type").alias("fields"))
    brands = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(one)).alias("sections"))
    return brands.select("p_brand", F.array_join(docs.section_fields(F.col("sections")), ",").alias("fields"))


_NAMED = "SELECT DISTINCT event_type AS name FROM events UNION SELECT 'status' UNION SELECT 'path'"


@query("field_descriptions", f"""
SELECT name, CASE name WHEN 'status' THEN 'HTTP status code returned by the server (e.g., 200 for success, 404 for not found)' WHEN 'path' THEN 'The URL path of the API endpoint that was accessed'
  ELSE 'Field ' || name || ' contains data related to the event' END AS description FROM ({_NAMED})
""")
def field_descriptions(spark, d):
    names = table(spark, d, "events").select(F.col("event_type").alias("name")).distinct()
    more = names.unionByName(spark.createDataFrame([("status",), ("path",)], "name string"))
    return more.select("name", profiling.describe(F.col("name")).alias("description"))


@query("field_patch", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_partkey % 3 = 0 AND p_size > 25 THEN 'large' ELSE p_type END AS p_type, p_brand FROM part
""")
def field_patch(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    some = table(spark, d, "part").where("p_partkey % 3 = 0")
    patch = some.select("p_partkey", F.upper("p_name").alias("p_name"), F.when(F.col("p_size") > 25, "large").alias("p_type"))
    unknown = some.select((-F.col("p_partkey") - 1).alias("p_partkey"), F.lit("x").alias("p_name"), F.lit("y").alias("p_type"))
    return conv.patched(parts, patch.unionByName(unknown), "p_partkey", ["p_name", "p_type"])


@query("form_actions", "SELECT p_partkey, p_name || ':' || p_brand AS action FROM part")
def form_actions(spark, d):
    actions = F.array(F.struct(F.col("p_name").alias("label"), F.col("p_brand").alias("kind"), F.lit("f").alias("onClick")))
    return table(spark, d, "part").select("p_partkey", F.explode(views.without_handlers(actions)).alias("a")).select("p_partkey", F.concat_ws(":", "a.*").alias("action"))


@query("job_created_view", "SELECT event_id AS job_id, event_type AS status, CAST(json_extract(props, '$.k') AS INT) AS days, true AS no_result FROM events")
def job_created_view(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("status"), F.col("props").alias("params"), F.lit("").alias("result"), F.lit(None).cast("string").alias("error"))
    made = views.job_created_view(rows)
    assert "error" not in made.columns
    return made.select("job_id", "status", F.try_variant_get("params", "$.k", "int").alias("days"), F.col("result").isNull().alias("no_result"))


_NAME = "'--' || replace(lower(p_name), ' ', '-')"


def _variables(spark, d):
    return table(spark, d, "part").withColumn("name", F.concat(F.lit("--"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("-"))))


def _css(name, value):
    return F.concat(F.lit(":root {\n  "), name, F.lit(": "), value, F.lit(" ;\n  color: red;\n  --h1: 2px;\n}"))


@query("css_variables", f"""
SELECT name, coalesce(new, old) AS value FROM (SELECT {_NAME} AS name, min(p_type) AS old FROM part GROUP BY 1)
LEFT JOIN (SELECT {_NAME} AS name, max(p_brand) || ' solid' AS new FROM part WHERE p_size > 25 AND p_type <> 'PROMO' GROUP BY 1) USING (name)
""")
def css_variables(spark, d):
    """Variables take the values of a text that was edited."""
    parts = _variables(spark, d)
    edits = parts.where("p_size > 25 AND p_type <> 'PROMO'").groupBy("name").agg(F.max("p_brand").alias("value"))
    edited = docs.css_variables(edits.select(_css("name", F.concat("value", F.lit(" solid"))).alias("css")), "css")
    return conv.patched(parts.groupBy("name").agg(F.min("p_type").alias("value")), edited, "name", ["value"])


@query("css_round_trip", "SELECT '--' || lower(p_type) AS name, min(p_brand) || ' ' || count(*) AS value FROM part GROUP BY p_type")
def css_round_trip(spark, d):
    kinds = table(spark, d, "part").groupBy("p_type").agg(F.concat(F.min("p_brand"), F.lit(" "), F.count("*")).alias("value"))
    rows = kinds.select(F.col("p_type").alias("pos"), F.concat(F.lit("--"), F.lower("p_type")).alias("name"), "value")
    return docs.css_variables(docs.css_text(rows, "pos"), "css")


SIZES = [(0, "0 Bytes"), (1, "1 Bytes"), (1023, "1023 Bytes"), (1536, "1.5 KB"), (2048, "2 KB"), (1048576, "1 MB"), (5242880, "5 MB"), (1610612736, "1.5 GB"), (1099511627776, None)]


@query("file_size_format", f"SELECT p_partkey, size, shown FROM part JOIN (VALUES {values([(i, *s) for i, s in enumerate(SIZES)])}) AS t(i, size, shown) ON i = p_partkey % {len(SIZES)}")
def file_size_format(spark, d):
    size = F.get(F.array(*[F.lit(s).cast("long") for s, _ in SIZES]), (F.col("p_partkey") % len(SIZES)).cast("int"))
    return table(spark, d, "part").select("p_partkey", size.alias("size"), scalars.file_size(size).alias("shown"))
