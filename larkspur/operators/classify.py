"""Rule engines over text, as CASE chains and label lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from larkspur.functions.scalars import trim_all

# The words and patterns of each rule, in the order in which rules apply.
SERVER_REPLY = [
    ("greeting", ["hello", "hi", "hey"]),
    ("help", ["help", "what can you do"]),
    ("chart", ["chart", "graph"]),
    ("question", ["?"]),
]
BLOCKS = [
    ("sql", r"(show.*sql|sql query|select.*from|create table|insert into)"),
    ("spl", r"(splunk|spl query|index=.*\||stats count|timechart)"),
    ("chart", r"(chart|graph|visualization|plot|timechart|bar chart|line chart|show.*chart|create.*chart|visualize.*data)"),
    ("code", r"(show.*code|code example|python code|javascript code|example.*code)"),
    ("table", r"(show.*table|display.*data|list.*data|table.*data)"),
    ("json", r"(json|show.*json|explore.*data|view.*json|json.*data)"),
    ("timeline", r"(timeline|events|log.*view|event.*history|show.*events)"),
    ("search", r"(search|filter|find.*data|lookup)"),
    ("alert", r"(alert|warning|error|notification|important)"),
    ("form", r"(change request|servicenow|ticket|form|cr[0-9]|inc[0-9]|show.*form|display.*form)"),
    ("file", r"(upload.*file|download.*file|file.*upload|file.*download|share.*file|attach.*file)"),
    ("checklist", r"(checklist|task.*list|todo.*list|deployment.*checklist|action.*items|steps.*to.*complete)"),
    ("diagram", r"(diagram|architecture|workflow|aws.*architecture|system.*design|flowchart|sequence.*diagram)"),
]
CLIENT_REPLY = [
    ("greeting", r"^(hi|hello|hey|greetings|good morning|good afternoon|good evening)"),
    ("help", r"help|what can you do|capabilities"),
    ("chart", r"chart|graph|visualization|plot"),
    ("question", r"\?"),
    ("time", r"(what.*time|current time|what.*date|current date)"),
    ("identity", r"(who are you|what are you|your name|what.*you.*called)"),
    ("weather", r"weather|temperature|forecast"),
    ("thanks", r"(thank|thanks|appreciate|grateful)"),
    ("goodbye", r"(bye|goodbye|see you|farewell|exit|quit)"),
    ("data", r"(data|numbers|statistics|stats|analyze|analysis)"),
    ("sql", r"(sql|show.*query|select.*from|database query)"),
    ("spl", r"(splunk|spl query|index=)"),
    ("code", r"(code|programming|script|function|algorithm|syntax)"),
    ("example", r"(example|sample|demo|show me|demonstrate)"),
]
CHART_KINDS = [("bar", ["bar"]), ("pie", ["pie"]), ("area", ["area"]), ("timechart", ["time"])]
ALERT_KINDS = [("error", ["error"]), ("warning", ["warning"]), ("success", ["success"])]
FORM_KINDS = [("change_request", ["change", "cr"])]
DIAGRAM_KINDS = [("aws", ["aws"]), ("flowchart", ["workflow", "flowchart"]), ("sequence", ["sequence"]), ("architecture", ["architecture"])]


def _holds(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def first_match(c: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The name of the first rule with a word in the lower-cased text."""
    low = F.lower(c)
    out = None
    for name, words in rules:
        out = F.when(_holds(low, words), name) if out is None else out.when(_holds(low, words), name)
    return out.otherwise(default)


def first_pattern(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    low = F.lower(c)
    out = None
    for name, pattern in rules:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise(default)


def all_labels(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Names of all rules that match, in rule order."""
    low = F.lower(c)
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in rules]))


def emitted_blocks(c: Column) -> Column:
    """The blocks that a text asks for: one a rule that matches, and two, a code and a table, for SQL."""
    return F.flatten(F.transform(block_labels(c), lambda x: F.when(x == "sql", F.array(F.lit("sql"), F.lit("sql-table"))).otherwise(F.array(x))))


def server_reply(c: Column) -> Column:
    return first_match(c, SERVER_REPLY, "echo")


def client_reply(c: Column) -> Column:
    return first_pattern(trim_all(c), CLIENT_REPLY, "default")


def block_labels(c: Column) -> Column:
    return all_labels(trim_all(c), BLOCKS)


def chart_kind(c: Column) -> Column:
    return first_match(c, CHART_KINDS, "line")


def alert_kind(c: Column) -> Column:
    return first_match(c, ALERT_KINDS, "info")


def form_kind(c: Column) -> Column:
    return first_match(c, FORM_KINDS, "incident")


def diagram_kind(c: Column) -> Column:
    return first_match(c, DIAGRAM_KINDS, "mermaid")


def visualization(query: Column) -> Column:
    """What a query's text suggests: a time series, one value, a gauge, slices, bars, or a table."""
    q = F.lower(query)

    def has(*words: str) -> Column:
        return _holds(q, list(words))

    share = has("gauge", "percent")
    return (
        F.when(has("timechart"), "timechart")
        .when(has("stats count", "stats sum", "stats avg") & ~share, "single-value")
        .when(share, "gauge")
        .when(has("by") & (has("pie") | q.rlike("stats.*count.*by")), "pie")
        .when(has("bar", "stats"), "bar")
        .otherwise("table")
    )


def visualization_of(query: str) -> str:
    """The same for a text that is at hand, without a query of its own."""
    q = query.lower()
    share = "gauge" in q or "percent" in q
    if "timechart" in q:
        return "timechart"
    if any(w in q for w in ("stats count", "stats sum", "stats avg")) and not share:
        return "single-value"
    if share:
        return "gauge"
    if "by" in q and ("pie" in q or re.search("stats.*count.*by", q)):
        return "pie"
    return "bar" if "bar" in q or "stats" in q else "table"


def job_display(status: Column, has_blocks: Column) -> Column:
    """What a placeholder shows: a missing job is loading, a completed one without blocks still shows progress."""
    return F.when(status.isNull(), "loading").when((status == "completed") & has_blocks, "blocks").when(status == "failed", "error").otherwise("progress")
