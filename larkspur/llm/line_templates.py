"""Line dedup by a log-template tree of fixed depth: lines of templates that recur across documents are dropped.

A line is its tokens (runs without white space); tokens with a digit are variable, ``<*>``. The tree routes a line by
its number of tokens and then by its first ``depth`` tokens to a leaf. In a leaf a token stays constant at its place
where ``min_docs`` texts have it there, and is generalised to ``<*>`` elsewhere; the line's template is what remains.
Templates with constants at half their places at least, found in ``min_docs`` different texts, recur, and their lines
are dropped, in every document. A line with fewer constants is tried once more: variable places count as constants too
where ``min_docs`` texts of the leaf have the same token there, digits and all. So lines that recur word for word always
have a template, also those that are nothing but numbers; lines that have one without this keep it.

A template's texts are among its leaf's, so lines of leaves that fewer texts reach are kept without a further look.
Texts are counted, not rows: exact copies count once, and are known by 128 bits of their text. All counting is by key
with sums in each task first; the lines of frequent leaves alone are taken apart; leaves, constants and templates are
written and joined back by broadcast up to ``MANY``, beyond by joins that adaptive execution can split.

Defined cases: a null or empty text has no lines to drop and is kept as it is; blank lines are kept and have no
template; very long texts and lines are read to the end; doc_id is not read, so rows with any or no doc_id are judged by
their text, and repeated rows alike; a template of exactly ``min_docs`` texts recurs; an empty table gives an empty
result; other columns, whatever their names, are carried along, unless they are named like an output (n_lines,
n_dropped, kept_text), which then replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.llm.common import Carried, if_small, release, remove, written

VARIABLE = "<*>"
#: Leaves, constants and templates up to which they are broadcast, of 8 to 24 bytes each.
MANY = 300_000

#: White space within a line, and a token with a digit: it begins where a token begins, and nothing is tried twice.
GAP = r"[ \t\r\x0b\f]"
WITH_DIGIT = r"(?<![^ \t\r\x0b\f])[^ \t\r\x0b\f0-9]*+[0-9][^ \t\r\x0b\f]*+"


def raw_tokens(line: Column) -> Column:
    """Tokens of a line as they are. One empty token without any."""
    return F.split(F.btrim(line, F.lit(" \t\r\x0b\f")), f"{GAP}+")


def tokens(line: Column) -> Column:
    """Tokens of a line; those with a digit are variable."""
    return raw_tokens(F.when(line.rlike("[0-9]"), F.regexp_replace(line, WITH_DIGIT, VARIABLE)).otherwise(line))


def leaf(t: Column, depth: int) -> Column:
    """Null for a blank line."""
    return F.when(F.get(t, F.lit(0)) != "", F.xxhash64(F.size(t), *[F.get(t, F.lit(i)) for i in range(depth)]))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def text_hashes(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def recurring(texts: DataFrame, min_docs: int, depth: int) -> DataFrame:
    """(h1, h2, lines) as a written table: of each text of the column ``text``, the numbers of the lines to drop, from 0."""
    spark = texts.sparkSession
    texts = texts.where(F.col("text").isNotNull()).select(*text_hashes("text"), "text")
    # tokens are a lambda's variable when the leaf uses them, so they are made once a line
    taken_apart = F.transform(_lines(F.col("text")), lambda body: F.struct(body.alias("body"), tokens(body).alias("t")))
    leaves = F.transform(taken_apart, lambda x: F.struct(leaf(x["t"], depth).alias("leaf"), x["body"].alias("body")))
    placed = texts.select("h1", "h2", F.posexplode(leaves).alias("line", "x")).where("x.leaf IS NOT NULL").select("h1", "h2", "line", "x.leaf", "x.body")
    placed = written(placed, "lines-placed")
    frequent = written(placed.groupBy("leaf").agg(F.count_distinct("h1").alias("n")).where(F.col("n") >= min_docs).select("leaf"), "lines-leaves")
    # the lines of frequent leaves, of each text once
    taken = placed.join(if_small(frequent, MANY), "leaf", "left_semi").dropDuplicates(["h1", "h2", "line"])
    taken = written(taken.select("h1", "h2", "line", "leaf", raw_tokens(F.col("body")).alias("raw")), "lines-taken")
    remove(placed, spark)
    release(spark)
    single = taken.select("h1", "h2", "line", "leaf", F.size("raw").alias("size"), F.posexplode("raw").alias("p", "token"))
    constant = single.groupBy("leaf", "p", "token").agg(F.count_distinct("h1").alias("n")).where(F.col("n") >= min_docs)
    # tokens with a digit are in a template only where it has too few constants without them
    plain = ~F.col("token").rlike("[0-9]") & (F.col("token") != VARIABLE)
    constant = written(constant.select(F.xxhash64("leaf", "p", "token").alias("constant"), F.xxhash64("p", "token").alias("h"), plain.alias("plain")), "lines-constants")
    fixed = single.select("h1", "h2", "line", "leaf", "size", F.xxhash64("leaf", "p", "token").alias("constant")).join(if_small(constant, MANY), "constant")
    fixed = fixed.groupBy("h1", "h2", "line", "leaf", "size")
    fixed = fixed.agg(F.count_if("plain").alias("some"), F.count("*").alias("all"), F.bit_xor(F.when(F.col("plain"), F.col("h"))).alias("of_some"), F.bit_xor("h").alias("of_all"))
    enough = F.col("some") * 2 >= F.col("size")
    fixed = fixed.where(F.col("all") * 2 >= F.col("size")).select(
        "h1", "h2", "line", "leaf", F.when(enough, F.col("some")).otherwise(F.col("all")).alias("constants"), F.when(enough, F.col("of_some")).otherwise(F.col("of_all")).alias("template")
    )
    fixed = written(fixed, "lines-templates")
    again = fixed.groupBy("leaf", "template", "constants").agg(F.count_distinct("h1").alias("n")).where(F.col("n") >= min_docs).drop("n")
    again = written(again, "lines-again")
    dropped = fixed.join(if_small(again, MANY), ["leaf", "template", "constants"])
    out = written(dropped.groupBy("h1", "h2").agg(F.collect_list("line").alias("lines")), "lines-dropped")
    for done in (frequent, taken, constant, fixed, again):
        remove(done, spark)
    release(spark)
    return out


def dedup(docs: DataFrame, min_docs: int = 8, depth: int = 3) -> DataFrame:
    """``docs`` (text, ...) with n_lines, n_dropped and kept_text."""
    held = Carried(docs, ("n_lines", "n_dropped", "kept_text"))
    found = recurring(docs.select("text"), min_docs, depth)
    text = F.col(held["text"])
    joined = held.df.select("*", *text_hashes(held["text"])).join(found, ["h1", "h2"], "left")
    every = _lines(text)
    # the lines are a lambda's variable, so the text is split once
    left = F.transform(F.array(every), lambda e: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(e) - 1), "lines"), lambda i: F.get(e, i)), "\n"))
    return held.back(
        joined,
        F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(every)).cast("long").alias("n_lines"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_dropped"),
        F.when(F.col("lines").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.element_at(left, 1)).alias("kept_text"),
    )
