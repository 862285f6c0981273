"""Charts, checklists, forms, JSON trees, diagrams, blocks and style text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.functions.scalars import given, locale_number, round_half_up, trim_all

# The palette (without its transparency), badge, event, alert and priority icons and colours.
PALETTE = ["25,195,125", "0,136,254", "0,196,159", "255,187,40", "255,128,66", "136,132,216"]
EVENT_ICONS = {"success": "✓", "warning": "⚠", "error": "✗"}
ALERT_ICONS = {"info": "ℹ️", "success": "✓", "warning": "⚠️", "error": "✗"}
EVENT_COLORS = {"success": "#19c37d", "warning": "#FFBB28", "error": "#ef4444"}
PRIORITY_COLORS = {"critical": "#dc2626", "high": "#ea580c", "medium": "#f59e0b", "low": "#10b981"}


def lookup(c: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c), F.lit(default))


def series_color(index: Column) -> Column:
    """Series reuse the palette from its start."""
    return F.element_at(F.array(*[F.lit(c) for c in PALETTE]), F.pmod(index, F.lit(len(PALETTE))) + 1)


def slice_color(index: Column) -> Column:
    """Slices beyond the palette have no colour."""
    return F.get(F.array(*[F.lit(c) for c in PALETTE]), index)


def chart_series(df: DataFrame, x: str, series: list[str] | None = None, exclude: tuple[str, ...] = ("time", "name")) -> DataFrame:
    """The label and one number a series; missing labels fall back to ``name``, missing numbers to 0."""
    series = series or [c for c in df.columns if c not in (x, *exclude)]
    label = given(df, x)
    if "name" in df.columns:
        label = F.coalesce(label, given(df, "name"))
    return df.select(F.coalesce(label, F.lit("")).alias("label"), *[F.coalesce(F.nanvl(F.col(s).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(s) for s in series])


def wide_counts(df: DataFrame, x: Column, kind: str, kinds: list[str]) -> DataFrame:
    """Counts of each kind as a series a column."""
    return df.groupBy(x.alias("label")).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def checklist_totals(items: DataFrame, key: str = "id", parent: str = "parent_id", max_depth: int = 32) -> DataFrame:
    """total, checked, progress of a tree given as (id, parent_id, checked).

    A list's progress is round(100 * sum(checked + progress of the sub-list / 100 * its length) / length), rounded at
    every level; so levels are folded from the deepest up, a join a level. A checked parent counts beside its children,
    so it can exceed 100. A tree deeper than ``max_depth`` is an error, as is a circle of parents below a root.
    """
    spark = items.sparkSession
    nodes = items.select(F.col(key).alias("id"), F.col(parent).alias("up"), F.coalesce("checked", F.lit(False)).alias("checked"))
    if nodes.isEmpty():
        return spark.createDataFrame([(0, 0, 0)], "total long, checked long, progress long")
    levels, front = [], nodes.where("up IS NULL").withColumn("depth", F.lit(0))
    while not front.isEmpty():
        if len(levels) == max_depth:
            raise ValueError(f"the tree is deeper than {max_depth}")
        levels.append(front)
        front = nodes.join(front.select(F.col("id").alias("up"), "depth"), "up").select("id", "up", "checked", (F.col("depth") + 1).alias("depth"))
    below = spark.createDataFrame([], "id string, part double")
    for level in reversed(levels):
        own = level.join(below, "id", "left").withColumn("points", F.col("checked").cast("double") + F.coalesce("part", F.lit(0.0)))
        per = own.groupBy(F.col("up").alias("id")).agg(F.sum("points").alias("points"), F.count("*").alias("n"))
        per = per.withColumn("progress", round_half_up(F.col("points") / F.col("n") * 100))
        below = per.select("id", (F.col("progress") / 100 * F.col("n")).alias("part"))
    top = per.select(F.col("progress").cast("long").alias("progress"))
    return nodes.agg(F.count("*").alias("total"), F.count_if("checked").alias("checked")).join(F.broadcast(top))  # one row


def json_children(value: Column) -> tuple[Column, Column]:
    """(fields, items): how many an object or a list has, null for others. No field of an entry is asked for, so they are only counted."""
    return F.array_size(F.map_keys(F.try_variant_get(value, "$", "map<string,struct<>>"))), F.array_size(F.try_variant_get(value, "$", "array<struct<>>"))


def json_kind(value: Column) -> Column:
    (fields, items), schema = json_children(value), F.schema_of_variant(value)
    return (
        F.when(fields.isNotNull(), "object").when(items.isNotNull(), "array").when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null").otherwise("number")
    )


def json_nesting(text: Column) -> Column:
    """How deep the brackets of a JSON text are nested; those inside its strings do not count."""
    plain = F.regexp_replace(text, r"(?s)\\.", "")  # no escapes, so every quote left begins or ends a string
    brackets = F.regexp_replace(plain, r'"[^"]*"|[^\[\]{}"]+', "")

    def step(seen: Column, c: Column) -> Column:
        now = seen["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(seen["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda seen: seen["most"])


def json_subtree(path: Column, depth: Column, value: Column, levels: int | None = None) -> Column:
    """A node and all below it, or so many levels below, as a list of (path, depth, kind, children); a level a step."""

    def node(path: Column, depth: Column, value: Column) -> Column:
        return F.struct(path.alias("path"), depth.alias("depth"), value.alias("value"))

    def below(n: Column) -> Column:
        def child(name: Column, value: Column) -> Column:
            return node(F.concat(n["path"], F.lit("."), name), n["depth"] + 1, value)

        fields = F.transform(F.map_entries(F.try_variant_get(n["value"], "$", "map<string,variant>")), lambda e: child(e["key"], e["value"]))
        items = F.transform(F.try_variant_get(n["value"], "$", "array<variant>"), lambda e, i: child(i.cast("string"), e))
        return F.coalesce(fields, items, F.array().cast(nodes))

    def step(s: Column, _: Column) -> Column:
        last = F.slice(s["nodes"], s["done"] + 1, F.size(s["nodes"]) - s["done"])
        further = F.struct(F.concat(s["nodes"], F.flatten(F.transform(last, below))).alias("nodes"), F.size(s["nodes"]).alias("done"))
        return F.when(s["done"] < F.size(s["nodes"]), further).otherwise(s)

    def shown(n: Column) -> Column:
        return F.struct(n["path"].alias("path"), n["depth"].alias("depth"), json_kind(n["value"]).alias("kind"), F.coalesce(*json_children(n["value"]), F.lit(0)).alias("children"))

    nodes = "array<struct<path:string,depth:int,value:variant>>"
    steps = F.coalesce(json_nesting(F.to_json(value)), F.lit(0))
    if levels is not None:
        steps = F.least(steps, F.lit(levels))
    begin = F.struct(F.array(node(path, depth, value)).cast(nodes).alias("nodes"), F.lit(0).alias("done"))
    return F.aggregate(F.array_repeat(F.lit(0), steps), begin, step, lambda s: F.transform(s["nodes"], shown))


def json_tree(df: DataFrame, column: str, max_depth: int | None = None, keys: Sequence[str] = (), by_rows: int = 6) -> DataFrame:
    """(keys, path, depth, kind, children): all nodes of JSON texts, or those down to a depth, where 0 stands for 3.

    Texts are read and parsed once. Down to the level ``by_rows`` nodes are rows: each level gives a kind to the new ones
    and puts their children beside them. What lies deeper is walked in its row, so no depth makes the plan longer.
    """
    limit = None if max_depth is None else max_depth or 3
    explode = df.sparkSession.tvf.variant_explode_outer
    new, below, value = F.col("kind").isNull(), F.col("below"), F.col("value")
    found = [
        F.when(new, json_kind(value)).otherwise(F.col("kind")).alias("kind"),
        F.when(new, F.coalesce(*json_children(value), F.lit(0))).otherwise(F.col("children")).alias("children"),
    ]
    carried, root = (["keys"], [F.struct(*keys).alias("keys")]) if keys else ([], [])
    tree = df.select(*root, F.lit("$").alias("path"), F.lit(0).alias("depth"), F.parse_json(column).alias("value"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("children"))
    for _ in range(by_rows if limit is None else min(limit, by_rows)):
        tree = tree.select(*carried, "path", "depth", "value", *found, new.alias("new"))
        # a node with children stands twice: for itself and for them
        rows = F.when(F.col("new") & (F.col("children") > 0), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
        tree = tree.select(*carried, "path", "depth", "value", "kind", "children", F.explode(rows).alias("below"))
        held = tree.select(*carried, "path", "depth", "kind", "children", "below", F.when(below, value).alias("held"))
        path = F.concat("path", F.lit("."), F.coalesce("name", F.col("n").cast("string")))
        tree = held.lateralJoin(explode(F.col("held").outer()).toDF("n", "name", "value")).select(
            *carried, F.when(below, path).otherwise(F.col("path")).alias("path"), (F.col("depth") + below.cast("int")).alias("depth"), "value",
            F.when(~below, F.col("kind")).alias("kind"), F.when(~below, F.col("children")).alias("children"),
        )
    shown = ["path", "depth", "kind", "children"]
    if limit is None or limit > by_rows:
        rest = F.when(new, json_subtree(F.col("path"), F.col("depth"), value, None if limit is None else limit - by_rows))
        tree = tree.select(*carried, *shown, rest.alias("rest")).select(*carried, *shown, F.explode_outer("rest").alias("node"))
        found = [F.coalesce(F.col("node")[c], F.col(c)).alias(c) for c in shown]
    else:
        found = ["path", "depth", *found]
    return tree.select(*(["keys.*"] if keys else []), *found)


def form_value(kind: Column, value: Column, link: Column) -> Column:
    """A field's value as shown; zero and empty values of plain fields show a dash."""
    return (
        F.when(kind == "link", F.concat(F.coalesce(value, F.lit("")), F.when(link.isNotNull() & (link != ""), " ↗").otherwise(" ")))
        .when(kind == "boolean", F.when(value.isNull() | value.isin("", "false", "0"), "✗ No").otherwise("✓ Yes"))
        .when(kind == "number", locale_number(value.try_cast("double")))
        .when(kind == "date", F.date_format(value.try_cast("timestamp"), "M/d/yyyy, h:mm:ss a"))
        .when(kind.isin("badge", "multiline", "json"), value)
        .otherwise(F.when(value.isNull() | value.isin("", "0", "false"), "-").otherwise(value))
    )


def form_sections(sections: DataFrame, fields: DataFrame) -> DataFrame:
    """(section, pos, name, label, shown): a section's fields in its order; the first field of a name counts, unknown names go."""
    first = fields.groupBy("name").agg(F.min_by(F.struct("label", "value", "type", "link"), "field_pos").alias("f"))
    placed = sections.select(F.col("title").alias("section"), F.posexplode("fields").alias("pos", "name"))
    return placed.join(first, "name").select("section", "pos", "name", "f.label", form_value(F.col("f.type"), F.col("f.value"), F.col("f.link")).alias("shown"))


def diagram_lines(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), trim_all), lambda x: x != "")


def diagram(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, node, next, x, y, layer): edges to the following node, places on a grid of 3, layers of 2 for 3 layers."""
    nodes = df.select(key, F.posexplode(diagram_lines(F.col(text))).alias("idx", "node"))
    following = F.lead("node").over(Window.partitionBy(key).orderBy("idx"))
    layer = F.when(F.col("idx") < 6, F.element_at(F.array(F.lit("Presentation"), F.lit("Application"), F.lit("Data")), F.floor(F.col("idx") / 2).cast("int") + 1))
    return nodes.select(key, "idx", "node", following.alias("next"), (100 + F.col("idx") % 3 * 200).alias("x"), (100 + F.floor(F.col("idx") / 3) * 150).cast("int").alias("y"), layer.alias("layer"))


def css_variables(df: DataFrame, text: str) -> DataFrame:
    """(name, value) of lines such as ``--name: value;``; names hold letters and dashes only."""
    lines = df.select(F.explode(F.split(text, "\n")).alias("line"))
    pattern = r"--([a-z-]+):\s*([^;]+);"
    return lines.where(F.col("line").rlike(pattern)).select(F.concat(F.lit("--"), F.regexp_extract("line", pattern, 1)).alias("name"), trim_all(F.regexp_extract("line", pattern, 2)).alias("value"))


def css_text(df: DataFrame, position: str) -> DataFrame:
    """(css): (name, value) lines in their order, as css_variables reads them."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), F.concat(F.lit("  "), "name", F.lit(": "), "value", F.lit(";")).alias("line"))))
    return df.agg(F.concat(F.lit(":root {\n"), F.array_join(lines["line"], "\n"), F.lit("\n}")).alias("css"))


def section_fields(sections: Column) -> Column:
    """The fields of all sections in one list."""
    return F.flatten(F.transform(sections, lambda s: s["fields"]))
