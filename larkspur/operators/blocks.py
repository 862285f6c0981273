"""Content blocks: nested blocks level by level, what each kind shows, its fields with their defaults, small series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur.functions.scalars import given

# The kinds of blocks, and of each its fields with what an empty, zero or false value falls back to.
FIELDS = {
    "markdown": {"content": ""},
    "list": {"items": "[]"},
    "chart": {},
    "splunk-chart": {"type": "line", "data": "[]", "height": "300", "allowChartTypeSwitch": "false", "isTimeSeries": "false"},
    "code": {"code": "", "language": "text"},
    "query": {"query": "", "language": "sql", "autoExecute": "false"},
    "table": {"columns": "[]", "rows": "[]"},
    "json-explorer": {"data": "{}", "collapsed": "false", "maxDepth": "3"},
    "timeline": {"events": "[]", "orientation": "vertical"},
    "search-filter": {"data": "[]"},
    "alert": {"type": "info", "message": "", "dismissible": "false"},
    "collapsible": {"title": "Section", "defaultExpanded": "false"},
    "form-viewer": {"fields": "[]"},
    "file-upload-download": {"mode": "both", "files": "[]"},
    "checklist": {"items": "[]", "allowEdit": "false", "collapsible": "false"},
    "diagram": {"type": "mermaid", "diagram": "", "theme": "light"},
    "async-placeholder": {},
    "plugin-widget": {},
}
# Fields that are true unless they are given as false.
SWITCHES = {
    "splunk-chart": ["showLegend"],
    "code": ["showCopyButton"],
    "table": ["showRowNumbers", "sortable"],
    "timeline": ["showTime"],
    "search-filter": ["showResultsCount"],
    "file-upload-download": ["multiple", "showFileList"],
    "checklist": ["showProgress", "showPriority", "showDueDate"],
    "diagram": ["interactive", "showControls"],
}
#: A field that takes another one's value where it is missing itself.
FALLS_BACK = {"allowChartTypeSwitch": "isTimeSeries"}
# Sample series.
SLICES = [("Success", 1250), ("Warning", 150), ("Error", 75), ("Info", 200)]
WEEK = [("Mon", 1200), ("Tue", 1350), ("Wed", 1100), ("Thu", 1450), ("Fri", 1300), ("Sat", 980), ("Sun", 1050)]
#: The field by which a block is shown in short, where that is not the first of its fields.
SHORT = {"code": "language", "query": "language"}


def nested_blocks(df: DataFrame, key: str, blocks: str, jobs: DataFrame | None = None, max_depth: int = 32) -> DataFrame:
    """(key, pos, depth, type, value): blocks of a JSON array, those within collapsible ones, and the result blocks of
    completed jobs (job_id, status, result) in their placeholders. A join a level; deeper than ``max_depth`` is an error.
    """
    spark = df.sparkSession

    def level(held: DataFrame, depth: int) -> DataFrame:
        each = held.lateralJoin(spark.tvf.variant_explode(F.col("held").outer()).toDF("n", "name", "value"))
        kind = F.try_variant_get("value", "$.type", "string")
        return each.select("k", F.concat("at", F.col("n").cast("string")).alias("pos"), F.lit(depth).alias("depth"), kind.alias("type"), "value")

    levels = [level(df.select(F.col(key).alias("k"), F.lit("").alias("at"), F.try_parse_json(blocks).alias("held")), 0)]
    while True:
        front = levels[-1].select("k", F.concat("pos", F.lit(".")).alias("at"), "type", "value")
        held = front.where("type = 'collapsible'").select("k", "at", F.try_variant_get("value", "$.data.children", "variant").alias("held"))
        if jobs is not None:
            done = jobs.where("status = 'completed'").select(F.col("job_id").cast("string").alias("job"), F.try_variant_get(F.try_parse_json("result"), "$.blocks", "variant").alias("held"))
            waiting = front.where("type = 'async-placeholder'").withColumn("job", F.try_variant_get("value", "$.data.jobId", "string"))
            held = held.unionByName(waiting.join(done, "job").select("k", "at", "held"))
        held = held.where("held IS NOT NULL")
        if held.isEmpty():
            break
        if len(levels) > max_depth:
            raise ValueError(f"blocks are nested deeper than {max_depth}")
        levels.append(level(held, len(levels)))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("k", key)


def _given(name: str) -> Column:
    """A field's text, null where it counts as missing: absent, null, empty text, the number 0, false."""
    value = F.try_variant_get("value", f"$.data.{name}", "variant")
    kind, text = F.schema_of_variant(value), F.try_variant_get("value", f"$.data.{name}", "string")
    empty = (kind == "VOID") | ((kind == "STRING") & (text == "")) | ((kind == "BOOLEAN") & (text == "false"))
    zero = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (F.try_variant_get("value", f"$.data.{name}", "double") == 0)
    return F.when(value.isNotNull() & ~empty & ~zero, text)


def _field(name: str, default: str | None) -> Column:
    """A field or what it falls back to; without a default a switch, which only false turns off."""
    if default is None:
        value = F.try_variant_get("value", f"$.data.{name}", "variant")
        off = (F.schema_of_variant(value) == "BOOLEAN") & (F.try_variant_get("value", f"$.data.{name}", "string") == "false")
        return F.when(off, "false").otherwise("true")
    # a chart over time can always be switched
    also = [_given(FALLS_BACK[name])] if name in FALLS_BACK else []
    return F.coalesce(_given(name), *also, F.lit(default))


def rendered_blocks(df: DataFrame, key: str, blocks: str, jobs: DataFrame | None = None) -> DataFrame:
    """(key, pos, depth, type, shown): a block's leading field or its default; unknown kinds show their raw JSON."""
    shown = None
    for kind, fields in FIELDS.items():
        if fields:
            name = SHORT.get(kind, next(iter(fields)))
            value = _field(name, fields[name])
            shown = F.when(F.col("type") == kind, value) if shown is None else shown.when(F.col("type") == kind, value)
    return nested_blocks(df, key, blocks, jobs).select(key, "pos", "depth", "type", shown.otherwise(F.to_json("value")).alias("shown"))


def block_fields(df: DataFrame, key: str, blocks: str, jobs: DataFrame | None = None) -> DataFrame:
    """(key, pos, type, field, value): every field of each block, as given or by default."""
    none = F.create_map().cast("map<string,string>")
    fields = None
    for kind, defaults in FIELDS.items():
        pairs = [x for name, default in defaults.items() for x in (F.lit(name), _field(name, default))]
        pairs += [x for name in SWITCHES.get(kind, []) for x in (F.lit(name), _field(name, None))]
        of = F.create_map(*pairs) if pairs else none
        fields = F.when(F.col("type") == kind, of) if fields is None else fields.when(F.col("type") == kind, of)
    return nested_blocks(df, key, blocks, jobs).select(key, "pos", "type", F.explode(fields.otherwise(none)).alias("field", "value"))


def hour_series(spark: SparkSession, seed: int = 1) -> DataFrame:
    """A day by hours: (time, count from 500 to 1499, avg from 50 to 150)."""
    time = F.concat(F.lpad(F.col("id").cast("string"), 2, "0"), F.lit(":00"))
    return spark.range(24).select(time.alias("time"), (F.floor(F.rand(seed) * 1000) + 500).cast("int").alias("count"), (F.rand(seed + 1) * 100 + 50).alias("avg"))


def sample_series(spark: SparkSession, kind: str, seed: int = 1) -> DataFrame:
    """What a chart shows before it has data: hours for a time chart, slices for a pie, else a week."""
    if kind == "timechart":
        hours = hour_series(spark, seed)
        return hours.select("time", F.col("count").alias("requests"), (F.floor(F.rand(seed + 2) * 50) + 10).cast("int").alias("errors"))
    return spark.createDataFrame(SLICES if kind == "pie" else WEEK, "name string, value int")


def pie_slices(df: DataFrame, x: str, y: str = "value") -> DataFrame:
    """(label, value): the label falls back to ``name`` and then to the number itself, a missing number to 0."""
    labels = [given(df, c) for c in (x, "name") if c in df.columns]
    return df.select(F.coalesce(*labels, F.col(y).cast("string")).alias("label"), F.coalesce(F.nanvl(F.col(y).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("value"))


def timeline(df: DataFrame, key: str, events: str) -> DataFrame:
    """(key, pos, type, title): events of a JSON array in the order they are given, not by time."""
    each = df.select(F.col(key).alias("k"), F.try_parse_json(events).alias("held")).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("held").outer()).toDF("n", "name", "value"))
    return each.select(F.col("k").alias(key), F.col("n").alias("pos"), F.try_variant_get("value", "$.type", "string").alias("type"), F.try_variant_get("value", "$.title", "string").alias("title"))
