"""Ranked search against scores of every document, odd rows, small parts and small blocks included."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, n_words = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    queries: dict = {}
    for i, t in items:
        queries.setdefault(i, set()).update(terms(t))
    out = []
    for item, asked in queries.items():
        scores = []
        for i, c in found:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def ranked(spark, docs, items, k=50):
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    return sorted(map(tuple, lexical.rank(df, spark.createDataFrame(items, ITEMS), k).collect()), key=repr)


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    word = lambda: rng.choice(vocabulary)
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(400)]
    docs += [(None, "w1 w2 W3"), (None, None), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (1000, ""), (1001, "?!"), (1002, "Ärger-w1_w2 ÄRGER"), (1003, "w5 " * 20_000)]
    items = [(i, " ".join({word() for _ in range(rng.choice([1, 3, 30]))})) for i in range(12)]
    items += [(0, "w2 w9"), (None, "w1 w4"), (50, None), (51, "nowhere"), (52, "Ärger ärger"), (53, "W5, w5; w5")]
    return docs, items


@pytest.mark.parametrize("bounds", [{}, {"DOCUMENTS": 16, "FIRST": 1}, {"CELLS": 500, "FIRST": 3}, {"BLOCK": 40}])
def test_ranks_equal_scores_of_every_document(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(lexical, name, value)
    docs, items = made(1)
    assert ranked(spark, docs, items) == brute(docs, items, 50)
    assert ranked(spark, docs, items, 3) == brute(docs, items, 3)


def test_ties_go_by_the_smaller_id(spark):
    docs = [(i, "same words here") for i in range(300)] + [(i, "other") for i in range(300, 320)]
    assert ranked(spark, docs, [(1, "same words")], 5) == brute(docs, [(1, "same words")], 5)
    assert [r[2] for r in ranked(spark, docs, [(1, "words")], 5)] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None), (2, " ")], [(1, "a")]), ([(1, "b")], [(1, "a")])])
def test_empty_tables(spark, docs, items):
    assert ranked(spark, docs, items) == []


def test_a_search_stops_before_the_ends_of_its_lists():
    """Strictly below the k-th score: equal scores further down are still met, and far ones are not."""
    rng = np.random.default_rng(3)
    n = 4000
    tf = np.where(np.arange(n) < 60, 50, rng.integers(1, 4, n))
    row, term = np.repeat(np.arange(n), 2), np.tile([0, 1], n)
    part = lexical.Part(np.arange(n), np.full(n, 100), row, term, np.repeat(tf, 2), np.array([900, 700]))
    best = lexical.Best(1, 50)
    read = part.search(0, np.array([0, 1]), best)
    assert read < n and best.ids[0].tolist() == list(range(50))
    # the best of earlier documents let later ones be left at the first look
    later = lexical.Part(np.arange(n, 2 * n), np.full(n, 100), row, term, np.ones(2 * n, np.int64), np.array([900, 700]))
    assert later.search(0, np.array([0, 1]), best) == 2 * lexical.FIRST and best.ids[0].tolist() == list(range(50))


def test_other_columns_are_not_read(spark):
    df = spark.createDataFrame([(1, "a b", 9, "x")], "DOC_ID long, text string, score long, terms string")
    items = spark.createDataFrame([(1, "a", 5)], "item_id long, text string, rank int")
    assert [tuple(r)[:3] for r in lexical.rank(df, items).collect()] == [(1, 1, 1)]
