"""Text classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.catalog.registry import literal, query, table, values
from larkspur.operators import classify as rules

PROMPTS = [
    "Hello there", "this is fine", "help me please", "Draw a bar chart of errors", "Is it down?", "plain words",
    "show me the sql query for users", "index=web_logs | stats count by status", "timechart of requests over time",
    "python code example", "show table of data", "view json data", "timeline of events", "search and filter items",
    "warning: important alert", "open change request CR123", "upload a file", "deployment checklist", "aws architecture diagram",
    "what time is it", "who are you", "weather tomorrow", "thanks a lot", "goodbye now", "success notification", "sequence diagram", "flowchart of work",
]
QUERY_TEXTS = [
    "index=web_logs | stats count by status | sort -count", "index=web_logs | timechart count", "select * from users", "index=a | stats sum(x)",
    "show gauge of load", "percent of errors", "pie by status", "stats max(x)", "bar of values", "SELECT id FROM t WHERE a = 1", "index=a | stats count | gauge",
]
_PROMPTS = f"(SELECT prompt, lower(prompt) AS p FROM (SELECT prompt FROM (VALUES {values([(p,) for p in PROMPTS])}) AS t(prompt) UNION SELECT text FROM conversations))"


def _frame(spark, d, texts, name):
    """All texts of the conversations, and texts that hit every rule."""
    said = table(spark, d, "conversations").select(F.col("text").alias(name))
    return said.unionByName(spark.createDataFrame([(t,) for t in texts], f"{name} string")).distinct()


def _words(column: str, table: list, default: str) -> str:
    arms = " ".join(f"WHEN {' OR '.join(f'contains({column}, {literal(w)})' for w in words)} THEN '{name}'" for name, words in table)
    return f"CASE {arms} ELSE '{default}' END"


def _patterns(column: str, table: list, default: str) -> str:
    arms = " ".join(f"WHEN regexp_matches({column}, {literal(p)}) THEN '{name}'" for name, p in table)
    return f"CASE {arms} ELSE '{default}' END"


@query("intent_first_match", f"SELECT prompt, {_words('p', rules.SERVER_REPLY, 'echo')} AS intent FROM {_PROMPTS}")
def intent_first_match(spark, d):
    return _frame(spark, d, PROMPTS, "prompt").select("prompt", rules.server_reply(F.col("prompt")).alias("intent"))


@query("intent_conversations", f"SELECT intent, count(*) AS n FROM (SELECT {_words('lower(text)', rules.SERVER_REPLY, 'echo')} AS intent FROM conversations) GROUP BY intent")
def intent_conversations(spark, d):
    return table(spark, d, "conversations").groupBy(rules.server_reply(F.col("text")).alias("intent")).agg(F.count("*").alias("n"))


_LABELS = ", ".join(f"CASE WHEN regexp_matches(p, {literal(p)}) THEN '{n}' END" for n, p in rules.BLOCKS)


@query("intent_multi_label", f"SELECT prompt, array_to_string([x FOR x IN [{_LABELS}] IF x IS NOT NULL], ',') AS labels FROM {_PROMPTS}")
def intent_multi_label(spark, d):
    return _frame(spark, d, PROMPTS, "prompt").select("prompt", F.array_join(rules.block_labels(F.col("prompt")), ",").alias("labels"))


# The rules written out by hand, so that a wrong rule in the tables shows.
@query("intent_by_hand", f"""
SELECT prompt, array_to_string([x FOR x IN [
    CASE WHEN regexp_matches(p, 'show.*sql|sql query|select.*from|create table|insert into') THEN 'sql,sql-table' END,
    CASE WHEN regexp_matches(p, 'splunk|spl query|index=.*[|]|stats count|timechart') THEN 'spl' END,
    CASE WHEN contains(p, 'chart') OR contains(p, 'graph') OR contains(p, 'visualization') OR contains(p, 'plot') OR regexp_matches(p, 'visualize.*data') THEN 'chart' END,
    CASE WHEN regexp_matches(p, 'show.*code|code example|python code|javascript code|example.*code') THEN 'code' END,
    CASE WHEN regexp_matches(p, 'show.*table|(display|list|table).*data') THEN 'table' END,
    CASE WHEN contains(p, 'json') OR regexp_matches(p, 'explore.*data') THEN 'json' END,
    CASE WHEN contains(p, 'timeline') OR contains(p, 'events') OR regexp_matches(p, 'log.*view|event.*history') THEN 'timeline' END,
    CASE WHEN contains(p, 'search') OR contains(p, 'filter') OR contains(p, 'lookup') OR regexp_matches(p, 'find.*data') THEN 'search' END,
    CASE WHEN contains(p, 'alert') OR contains(p, 'warning') OR contains(p, 'error') OR contains(p, 'notification') OR contains(p, 'important') THEN 'alert' END,
    CASE WHEN contains(p, 'change request') OR contains(p, 'servicenow') OR contains(p, 'ticket') OR contains(p, 'form') OR regexp_matches(p, 'cr[0-9]|inc[0-9]') THEN 'form' END,
    CASE WHEN regexp_matches(p, '(upload|download|share|attach).*file|file.*(upload|download)') THEN 'file' END,
    CASE WHEN contains(p, 'checklist') OR regexp_matches(p, 'task.*list|todo.*list|action.*items|steps.*to.*complete') THEN 'checklist' END,
    CASE WHEN contains(p, 'diagram') OR contains(p, 'architecture') OR contains(p, 'workflow') OR contains(p, 'flowchart') OR regexp_matches(p, 'system.*design') THEN 'diagram' END
  ] IF x IS NOT NULL], ',') AS blocks,
  CASE WHEN contains(p, 'bar') THEN 'bar' WHEN contains(p, 'pie') THEN 'pie' WHEN contains(p, 'area') THEN 'area' WHEN contains(p, 'time') THEN 'timechart' ELSE 'line' END AS chart,
  CASE WHEN contains(p, 'error') THEN 'error' WHEN contains(p, 'warning') THEN 'warning' WHEN contains(p, 'success') THEN 'success' ELSE 'info' END AS alert,
  CASE WHEN contains(p, 'change') OR contains(p, 'cr') THEN 'change_request' ELSE 'incident' END AS form,
  CASE WHEN contains(p, 'aws') THEN 'aws' WHEN contains(p, 'workflow') OR contains(p, 'flowchart') THEN 'flowchart' WHEN contains(p, 'sequence') THEN 'sequence'
    WHEN contains(p, 'architecture') THEN 'architecture' ELSE 'mermaid' END AS diagram
FROM {_PROMPTS}
""")
def intent_by_hand(spark, d):
    p = F.col("prompt")
    return _frame(spark, d, PROMPTS, "prompt").select(
        "prompt", F.array_join(rules.emitted_blocks(F.concat(F.lit("  "), p, F.lit(" "))), ",").alias("blocks"),
        rules.chart_kind(p).alias("chart"), rules.alert_kind(p).alias("alert"), rules.form_kind(p).alias("form"), rules.diagram_kind(p).alias("diagram"),
    )


@query("intent_reply_class", f"SELECT prompt, {_patterns('p', rules.CLIENT_REPLY, 'default')} AS reply FROM {_PROMPTS}")
def intent_reply_class(spark, d):
    return _frame(spark, d, PROMPTS, "prompt").select("prompt", rules.client_reply(F.col("prompt")).alias("reply"))


@query("subtype_classify", f"""
SELECT prompt, {_words('p', rules.CHART_KINDS, 'line')} AS chart, {_words('p', rules.ALERT_KINDS, 'info')} AS alert,
  {_words('p', rules.FORM_KINDS, 'incident')} AS form, {_words('p', rules.DIAGRAM_KINDS, 'mermaid')} AS diagram FROM {_PROMPTS}
""")
def subtype_classify(spark, d):
    p = F.col("prompt")
    return _frame(spark, d, PROMPTS, "prompt").select(
        "prompt", rules.chart_kind(p).alias("chart"), rules.alert_kind(p).alias("alert"), rules.form_kind(p).alias("form"), rules.diagram_kind(p).alias("diagram")
    )


@query("viz_classify", f"""
SELECT q, CASE WHEN contains(p, 'timechart') THEN 'timechart'
  WHEN (contains(p, 'stats count') OR contains(p, 'stats sum') OR contains(p, 'stats avg')) AND NOT (contains(p, 'gauge') OR contains(p, 'percent')) THEN 'single-value'
  WHEN contains(p, 'gauge') OR contains(p, 'percent') THEN 'gauge'
  WHEN contains(p, 'by') AND (contains(p, 'pie') OR regexp_matches(p, 'stats.*count.*by')) THEN 'pie'
  WHEN contains(p, 'bar') OR contains(p, 'stats') THEN 'bar' ELSE 'table' END AS visualization
FROM (SELECT q, lower(q) AS p FROM (SELECT q FROM (VALUES {values([(q,) for q in QUERY_TEXTS])}) AS t(q) UNION SELECT text FROM conversations))
""")
def viz_classify(spark, d):
    return _frame(spark, d, QUERY_TEXTS, "q").select("q", rules.visualization(F.col("q")).alias("visualization"))
