"""License scans: phrases, and an exact set-similarity join with license templates. DataFrame functions only.

Words are runs of lower-case ASCII letters, digits and non-ASCII characters, after lower-casing A to Z.

Phrases: every place where the words of a phrase stand consecutively counts and gives the phrase's label.

Set-similarity join: a text block matches a template if it holds at least ``threshold`` of the template's distinct
words. Blocks are runs of ceil(n / threshold) consecutive words, n being the template's number of words, so neither line
ends nor the length of a line matter, and words strewn over a long line are no statement. A block must also hold those
of the template's words that tell its label apart (``TELLING``), and none that make it a relative's (``FOREIGN``).
``matches`` holds whole lines against the templates.
Template words are ordered by the number of lines of the whole corpus that hold them, rarest first. With t distinct
words and o = ceil(threshold * t) needed:

* prefix filter: a matching block holds one of the template's first t - o + 1 words; only those are probed;
* length filter: a matching block has o distinct words at least;
* positional filter: a word found at place p of the template and place q of the block's template words leaves at most
  1 + min(words of the template after p, template words of the block after q), which must reach o.

Blocks are cut out around the words of any prefix only, so all that can match are; a cutting is as far to both sides as
the longest block, is filtered as one, and its own runs are then tried one by one. The filters only skip pairs that
cannot match, so every match is found. Templates are a parameter; their words and prefixes, not the corpus, are what is
broadcast (``MAX_WORDS`` is checked).

A first pass takes each text apart once, for its phrases and for the words of its lines, and writes a row of figures a
text. Whole texts are joined with the templates by the same filters; only those that hold enough of one are read and
taken apart again, for their blocks.

Defined cases: a null or empty text has no words, no label and score 0; very long texts and lines are scanned to the
end; rows are judged one by one, so repeated rows give repeated results; an empty table gives an empty result; other
columns, whatever their names, are carried along, unless they are named like an output, which then replaces them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.llm.common import Carried, if_small, written

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Lines by which texts state their license, and the labels these give.
TEMPLATES = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
    "Licensed under the Apache License, Version 2.0.": "apache",
    "Released under the MIT License.": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License": "agpl",
    "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "lgpl",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "cc-by-nd",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "cc-by-nc-sa",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "cc-by-nc-nd",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License": "mpl",
    "All rights reserved.": "all-rights-reserved",
}

#: Words without which a template's other words do not give its label.
TELLING = {"apache", "gnu", "mit", "mozilla", "nc", "affero", "lesser", "sharealike", "noderivatives", "noncommercial"}

#: Words that make a statement one of a label's relatives, and so must not stand in it.
FOREIGN = {
    "gpl": {"affero", "lesser", "library"},
    "agpl": {"lesser"},
    "lgpl": {"affero"},
    "cc-by": {"noncommercial", "sharealike", "noderivatives", "nc", "sa", "nd"},
    "cc-by-nc": {"sharealike", "noderivatives", "sa", "nd"},
    "cc-by-sa": {"noncommercial", "noderivatives", "nc", "nd"},
    "cc-by-nd": {"noncommercial", "sharealike", "nc", "sa"},
    "cc-by-nc-sa": {"noderivatives", "nd"},
    "cc-by-nc-nd": {"sharealike", "sa"},
}

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_WORDS = 20_000
#: Texts with a match up to which they are broadcast.
FEW = 200_000


def lower(text: Column) -> Column:
    """A to Z, as the words' rule asks; letters beyond ASCII too, which makes no word begin or end elsewhere.

    Two letters would turn into ASCII ones (the Kelvin sign and the dotted capital I); texts with them are translated
    letter by letter.
    """
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    return F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def spaced(text: Column) -> Column:
    """The words with one space between; empty if there is none."""
    return F.btrim(F.regexp_replace(lower(F.coalesce(text, F.lit(""))), GAPS, " "))


def _words(text: str) -> list[str]:
    out, word = [], ""
    for ch in [*text, " "]:
        ch = ch.lower() if "A" <= ch <= "Z" else ch
        if ch > "\x7f" or "0" <= ch <= "9" or "a" <= ch <= "z":
            word += ch
        elif word:
            out.append(word)
            word = ""
    return out


def starts(all_words: Column, phrase: str) -> Column:
    """Places of the phrase's first word, from 0."""
    parts = phrase.split(" ")
    size = F.size(all_words)
    places = F.sequence(F.lit(0), F.greatest(size - len(parts), F.lit(0)))

    def here(i: Column) -> Column:
        found = F.get(all_words, i).eqNullSafe(F.lit(parts[0]))
        for k, part in enumerate(parts[1:], 1):
            found = found & F.get(all_words, i + k).eqNullSafe(F.lit(part))
        return found

    return F.filter(places, here)


def figures(docs: DataFrame, table: Mapping[str, str], vocabulary: list[str], least: int, key: list[str]) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base, known, blocks): of each text, its words, its phrases, its words
    of the vocabulary if they are ``least`` or more, and of its lines that hold so many of them (block, size, known):
    number, distinct words, and those of the vocabulary.

    Places of words are made only in texts that hold a phrase's words in a row.
    """
    known = F.array(*[F.lit(w) for w in vocabulary]).cast("array<string>")
    # generators of one row: what they make is not computed again in each expression that uses it
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), spaced)
    df = docs.select(*key, F.explode(F.array(lines)).alias("lines"))
    df = df.select(*key, "lines", F.explode(F.array(F.array_join(F.filter("lines", lambda x: x != ""), " "))).alias("plain"))
    plain = F.col("plain")
    padded = F.concat(F.lit(" "), plain, F.lit(" "))
    n_words = F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1)
    hit = F.lit(False)
    for phrase in table:
        hit = hit | F.contains(padded, F.lit(f" {phrase} "))
    # the words are the lambda's variable, so they are taken apart once a text
    places = F.element_at(F.transform(F.array(F.split(plain, " ")), lambda w: F.flatten(F.array(*[starts(w, p) for p in table]).cast("array<array<int>>"))), 1)
    labels = F.array_compact(F.array(*[F.when(F.contains(padded, F.lit(f" {p} ")), F.lit(label)) for p, label in table.items()]))
    words = F.transform("lines", lambda x: F.split(x, " "))
    sets = F.transform(words, lambda w, i: F.struct(i.alias("block"), w.alias("words"), F.array_intersect(w, known).alias("known")))
    df = df.select("*", F.explode(F.array(F.filter(sets, lambda x: F.size(x["known"]) > 0))).alias("sets"))
    every = F.array_distinct(F.flatten("sets.known"))
    blocks = F.transform(F.filter("sets", lambda x: F.size(x["known"]) >= least), lambda x: F.struct(x["block"].alias("block"), F.size(F.array_distinct(x["words"])).alias("size"), x["known"].alias("known")))
    df = df.select(
        *key, n_words.cast("long").alias("n_words"), F.when(hit, places).otherwise(F.array().cast("array<int>")).alias("places"),
        F.when(hit, F.array_sort(F.array_distinct(labels.cast("array<string>")))).otherwise(F.array().cast("array<string>")).alias("base"),
        F.get(F.filter(F.array(every), lambda x: F.size(x) >= least), F.lit(0)).alias("known"), blocks.alias("blocks"),
    )
    return df.select(*key, "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"), "base", "known", "blocks")


class Templates:
    """Templates as word sets, and, once the words' frequencies are known, their order and prefixes."""

    def __init__(self, templates: Mapping[str, str], threshold: float):
        split = {i: (_words(t), label) for i, (t, label) in enumerate(templates.items())}
        self.sets = {i: (set(w), label) for i, (w, label) in split.items() if w}
        self.vocabulary = sorted(set().union(*[s for s, _ in self.sets.values()])) if self.sets else []
        if len(self.vocabulary) > MAX_WORDS:
            raise ValueError(f"templates hold more than {MAX_WORDS} words")
        self.need = {i: max(1, math.ceil(threshold * len(s) - 1e-9)) for i, (s, _) in self.sets.items()}
        self.least = min(self.need.values(), default=1)
        self.spans = {i: math.ceil(len(split[i][0]) / threshold - 1e-9) for i in self.sets}

    def order(self, blocks: DataFrame) -> None:
        """By the lines of ``blocks`` (known) that hold each word; a row a word of the vocabulary comes back."""
        spark = blocks.sparkSession
        counts = {r.w: r.n for r in blocks.select(F.explode("known").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
        self.ranked = sorted(self.vocabulary, key=lambda w: (counts.get(w, 0), w))
        rank = {w: i for i, w in enumerate(self.ranked)}
        prefix, bodies = [], []
        for i, (s, label) in self.sets.items():
            ordered = sorted(s, key=rank.__getitem__)
            bodies.append((i, label, ordered, len(ordered), self.need[i], self.spans[i], sorted(s & TELLING), sorted(FOREIGN.get(label, set()) - s)))
            prefix += [(w, i, p) for p, w in enumerate(ordered[: len(ordered) - self.need[i] + 1])]
        self.prefix = spark.createDataFrame(prefix, "w string, template int, p int")
        self.bodies = spark.createDataFrame(bodies, "template int, label string, body array<string>, t int, need int, span int, telling array<string>, strange array<string>")
        self.anchors = sorted({w for w, _, _ in prefix})

    def pairs(self, blocks: DataFrame) -> DataFrame:
        """``blocks`` (size, known, ...) with the templates of which they hold as many words as needed."""
        # an intersection keeps the order of its first side
        order = F.array(*[F.lit(w) for w in self.ranked]).cast("array<string>")
        ordered = blocks.withColumn("known", F.array_intersect(order, "known"))
        probes = ordered.select("*", F.posexplode("known").alias("q", "w")).join(F.broadcast(self.prefix), "w").join(F.broadcast(self.bodies), "template")
        bound = 1 + F.least(F.col("t") - 1 - F.col("p"), F.size("known") - 1 - F.col("q"))
        probes = probes.where((F.col("size") >= F.col("need")) & (bound >= F.col("need")))
        # a pair is kept at the first of the prefix words that its block holds
        first = F.element_at(F.array_intersect("known", F.slice("body", F.lit(1), F.col("t") - F.col("need") + 1)), 1)
        shared = F.size(F.array_intersect("known", "body"))
        return probes.where((F.col("w") == first) & (shared >= F.col("need"))).withColumn("shared", shared)


def cuttings(docs: DataFrame, anchors: list[str], reach: int, vocabulary: list[str], least: int, key: list[str]) -> DataFrame:
    """(key, run, size, known): the words up to ``reach`` around each anchor word."""
    known = F.array(*[F.lit(w) for w in vocabulary]).cast("array<string>")

    texts = docs.select(*key, F.explode(F.array(spaced(F.col("text")))).alias("plain"))

    def around(w: Column) -> Column:
        at = F.array_compact(F.transform(w, lambda x, i: F.when(x.isin(anchors), i)))
        return F.transform(at, lambda i: F.slice(w, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + reach + 1))

    runs = F.element_at(F.transform(F.array(F.split("plain", " ")), around), 1)
    found = texts.select(*key, F.explode(runs).alias("run")).withColumn("known", F.array_intersect("run", known))
    return found.where(F.size("known") >= least).select(*key, "run", F.size(F.array_distinct("run")).alias("size"), "known")


def matches(docs: DataFrame, templates: Mapping[str, str], threshold: float, key: list[str]) -> DataFrame:
    """(key, block, template, label, containment, told) of every line and template that meet the threshold.

    told: the line holds the words that tell the label apart.
    """
    sets = Templates(templates, threshold)
    lines = written(figures(docs, {}, sets.vocabulary, sets.least, key).select(*key, F.explode("blocks").alias("x")).select(*key, "x.*"), "license-lines")
    sets.order(lines)
    told = F.size(F.array_except("telling", "known")) == 0
    return sets.pairs(lines).select(*key, "block", "template", "label", (F.col("shared") / F.col("t")).alias("containment"), told.alias("told"))


def statements(docs: DataFrame, per: DataFrame, sets: Templates, key: list[str]) -> DataFrame:
    """(key, labels, best): the labels of the templates that a text's blocks match, and the largest containment.

    per: the figures of the texts.
    """
    spark = docs.sparkSession
    if not sets.anchors:
        return spark.createDataFrame([], docs.select(*key).schema.add("labels", "array<string>").add("best", "double"))
    told = F.size(F.array_except("telling", "known")) == 0
    wide = sets.pairs(per.where(F.col("known").isNotNull()).select(*key, "known", F.size("known").alias("size"))).where(told).select(*key).distinct()
    docs = docs.join(if_small(written(wide, "license-texts"), FEW), key, "left_semi")
    cut = cuttings(docs, sets.anchors, max(sets.spans.values()) - 1, sets.vocabulary, sets.least, key)
    pairs = sets.pairs(written(cut, "license-cuttings")).where(told)
    # the most that a run of the template's length holds, of those with the telling words and no strange one
    places = F.sequence(F.lit(1), F.greatest(F.size("run") - F.col("span") + 1, F.lit(1)))
    plain = F.filter(places, lambda i: ~F.arrays_overlap("strange", F.slice("run", i, F.col("span"))))
    windows = F.transform(plain, lambda i: F.array_intersect("body", F.slice("run", i, F.col("span"))))
    best = F.array_max(F.transform(F.filter(windows, lambda x: F.size(F.array_except("telling", x)) == 0), F.size))
    found = pairs.withColumn("most", best).where(F.col("most") >= F.col("need"))
    return found.groupBy(*key).agg(F.array_sort(F.collect_set("label")).alias("labels"), F.max(F.col("most") / F.col("t")).alias("best"))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.8, table: Mapping[str, str] = PHRASES) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score.

    labels: of phrases and templates; score: 1 if a phrase stands in the text, else the largest containment that meets
    the threshold, else 0.
    """
    held = Carried(docs, ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))
    # a text is known by its id and hash, so rows repeated with both are one key
    key = ["id", "hash"]
    keyed = held.df.withColumn("id", F.coalesce(F.col(held["doc_id"]).cast("string"), F.lit(""))).withColumn("hash", F.xxhash64(F.coalesce(held["text"], F.lit(""))))
    texts = keyed.select(*key, F.col(held["text"]).alias("text"))
    sets = Templates(templates, threshold)
    per = written(figures(texts, table, sets.vocabulary, sets.least, key).dropDuplicates(key), "license-figures")
    sets.order(per.select(F.explode("blocks").alias("x")).select("x.known"))
    found = if_small(written(statements(texts, per, sets, key), "license-statements"), FEW)
    out = keyed.join(per.drop("blocks", "known"), key).join(found, key, "left")
    none = F.array().cast("array<string>")
    return held.back(
        out, "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("labels", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
