"""Field profiles and parent-to-child relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.sources.work import written

# Descriptions of well-known fields.
DESCRIPTIONS = {
    "timestamp": "The timestamp when the event occurred, in ISO 8601 format",
    "status": "HTTP status code returned by the server (e.g., 200 for success, 404 for not found)",
    "method": "HTTP method used for the request (GET, POST, PUT, DELETE, etc.)",
    "path": "The URL path of the API endpoint that was accessed",
    "user_id": "Unique identifier for the user who made the request",
    "ip_address": "IP address of the client that made the request",
    "response_time": "Time taken to process the request in milliseconds",
}
IP = r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"
URL = r"^https?://[^ ]+$"
BOOLEAN = r"^(?i:true|false)$"
TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
PROBES = (("boolean", BOOLEAN), ("number", NUMBER), ("timestamp", TIMESTAMP), ("ip", IP), ("url", URL))


def describe(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in DESCRIPTIONS.items() for x in pair])
    return F.coalesce(F.element_at(known, name), F.concat(F.lit("Field "), name, F.lit(" contains data related to the event")))


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row a column: n, nulls, and how many values each type's probe accepts, with the type that accepts all.

    One scan for all columns: the probes are counts of one aggregate, unpivoted afterwards.
    """
    columns = columns or df.columns
    counts = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        text = F.col(c).cast("string")
        counts.append(F.count_if(text.isNull()).alias(f"null_{i}"))
        counts += [F.count_if(text.rlike(p)).alias(f"{kind}_{i}") for kind, p in PROBES]
    wide = df.agg(*counts)
    rows = [
        F.struct(F.lit(c).alias("field"), F.col("n").alias("n"), F.col(f"null_{i}").alias("nulls"), *[F.col(f"{kind}_{i}").alias(f"n_{kind}") for kind, _ in PROBES])
        for i, c in enumerate(columns)
    ]
    long = wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    full = F.col("n") - F.col("nulls")
    kind = reduce(lambda acc, k: acc.when((full > 0) & (F.col(f"n_{k[0]}") == full), k[0]), PROBES[1:], F.when((full > 0) & (F.col(f"n_{PROBES[0][0]}") == full), PROBES[0][0]))
    return long.withColumn("type", kind.otherwise("string"))


def samples(df: DataFrame, column: str, shown: int = 3) -> DataFrame:
    """The first distinct values in order, and how many more there are."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct()
    first = values.orderBy("v").limit(shown).agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("samples"))
    return first.join(F.broadcast(values.agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("more"))))  # one row


# Categories of well-known fields.
CATEGORIES = {"timestamp": "Time", "status": "HTTP", "method": "HTTP", "path": "HTTP", "user_id": "User", "ip_address": "Network", "response_time": "Performance"}
#: Characters of a value that are shown; longer ones go on with 128 bits of their hash, so that they are told apart.
SHOWN = 200


def full_profile(df: DataFrame, columns: list[str] | None = None, shown: int = 3) -> DataFrame:
    """A row a column: n, nulls, the type that all values accept, description, category, the first distinct values in
    order (joined by commas), and how many more there are.

    One scan for all columns: every row gives a short value a column, equal ones are counted in each task before they are
    shuffled, and the distinct values are written once. Probes, counts and first values are made of those; a column of
    many values is cut down to ``shown`` in each task before its first ones are ranked.
    """
    columns = columns or df.columns
    text = [F.col("`" + c.replace("`", "``") + "`").cast("string") for c in columns]
    short = [F.when(F.length(t) <= SHOWN, t).otherwise(F.concat(F.left(t, F.lit(SHOWN)), F.lit("…"), F.md5(t.cast("binary")))) for t in text]
    kinds = [F.array_compact(F.array(*[F.when(t.rlike(p), k) for k, p in PROBES])) for t in text]
    cells = F.array(*[F.struct(F.lit(i).alias("at"), v.alias("value"), F.when(t.isNotNull(), k).alias("kinds")) for i, (v, t, k) in enumerate(zip(short, text, kinds))])
    values = written(df.select(F.explode(cells).alias("x")).groupBy("x.at", "x.value", "x.kinds").agg(F.count("*").alias("n")), "profile-values")
    counts = [F.sum(F.when(F.array_contains("kinds", k), F.col("n")).otherwise(0)).alias(f"n_{k}") for k, _ in PROBES]
    found = values.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("value").alias("distinct"), *counts)
    first = values.where("value IS NOT NULL").withColumn("nth", F.row_number().over(Window.partitionBy("at").orderBy("value"))).where(F.col("nth") <= shown)
    samples = first.groupBy("at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "value"))), lambda x: x["value"]), ",").alias("samples"))
    full = F.col("n") - F.col("nulls")
    kind = F.lit("string")
    for k, _ in reversed(PROBES):
        kind = F.when((full > 0) & (F.col(f"n_{k}") == full), k).otherwise(kind)
    names = F.array(*[F.lit(c) for c in columns])
    named = found.join(samples, "at", "left").withColumn("field", F.get(names, F.col("at"))).withColumn("type", kind)
    known = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    category = F.coalesce(F.element_at(known, F.lower("field")), F.when(F.col("type") == "timestamp", "Time").when(F.col("type") == "ip", "Network"))
    more = F.greatest(F.col("distinct") - shown, F.lit(0))
    return named.select("field", "n", "nulls", "type", describe(F.col("field")).alias("description"), category.alias("category"), F.coalesce("samples", F.lit("")).alias("samples"), more.alias("more"))


def pair_relations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(parent, child, children_per_parent, parents_per_child, cardinality) of every pair of columns, from one scan.

    Each row gives its pairs; equal pairs of values are counted in each task before they are shuffled, and the distinct
    ones are written once, as 64 bits a value. Both counts of a pair of columns are made of those, by value and then by
    columns. Columns without a row that has both are left out.
    """
    columns = columns or df.columns
    quoted = ["`" + c.replace("`", "``") + "`" for c in columns]
    held = [F.xxhash64(F.col(q).cast("string")) for q in quoted]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    cells = [F.when(F.col(quoted[i]).isNotNull() & F.col(quoted[j]).isNotNull(), F.struct(F.lit(n).alias("pair"), held[i].alias("x"), held[j].alias("y"))) for n, (i, j) in enumerate(pairs)]
    met = written(df.select(F.explode(F.array_compact(F.array(*cells))).alias("p")).select("p.*").distinct(), "relation-pairs")
    # values of both sides at once: side 0 counts the y of an x, side 1 the x of a y
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("v")), F.struct(F.lit(1).alias("side"), F.col("y").alias("v")))
    per = met.select("pair", F.explode(sides).alias("s")).groupBy("pair", "s.side", "s.v").agg(F.count("*").alias("n"))
    most = per.groupBy("pair").agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("down"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("up"))
    names = F.array(*[F.struct(F.lit(columns[i]).alias("parent"), F.lit(columns[j]).alias("child")) for i, j in pairs])
    kind = F.when((F.col("down") > 1) & (F.col("up") > 1), "many-to-many").when(F.col("down") > 1, "one-to-many").when(F.col("up") > 1, "many-to-one").otherwise("one-to-one")
    named = most.select(F.get(names, F.col("pair")).alias("of"), F.col("down").alias("children_per_parent"), F.col("up").alias("parents_per_child"), kind.alias("cardinality"))
    return named.select("of.*", "children_per_parent", "parents_per_child", "cardinality")


def children(df: DataFrame, parent: str, child: str) -> DataFrame:
    """(value, child): the distinct child values of each parent value, a row each, so a parent may have any number."""
    full = df.where(F.col(parent).isNotNull() & F.col(child).isNotNull())
    return full.select(F.col(parent).cast("string").alias("value"), F.col(child).cast("string").alias("child")).distinct()


def cardinality(df: DataFrame, parent: str, child: str) -> DataFrame:
    """(children_per_parent, parents_per_child, cardinality)."""
    pairs = df.select(parent, child).where(F.col(parent).isNotNull() & F.col(child).isNotNull()).distinct()
    down = pairs.groupBy(parent).agg(F.count("*").alias("n")).agg(F.max("n").alias("children_per_parent"))
    up = pairs.groupBy(child).agg(F.count("*").alias("n")).agg(F.max("n").alias("parents_per_child"))
    many_down, many_up = F.col("children_per_parent") > 1, F.col("parents_per_child") > 1
    kind = F.when(many_down & many_up, "many-to-many").when(many_down, "one-to-many").when(many_up, "many-to-one").otherwise("one-to-one")
    return down.join(F.broadcast(up)).withColumn("cardinality", kind)  # one row each
