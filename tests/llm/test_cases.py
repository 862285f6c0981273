"""Cases that each operator defines: clashing names, both sides of size bounds, extreme values, placements and margins."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from larkspur.llm import common, decontaminate, licenses, line_templates, mixing, ngram_join, sharding, substrings, textops, topk, toxicity

from test_corpus import brute_substrings

DOCS = "doc_id long, text string"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# 1


def test_simhash_counts_in_full(spark):
    many = spark.range(1).select(F.array_repeat(F.lit(1).cast("long"), 70_000).alias("s"))
    assert many.select(decontaminate.simhash(F.col("s"))).first()[0] == 1
    rng = random.Random(1)
    sets = [[rng.getrandbits(63) - 2**62 for _ in range(n)] for n in (1, 2, 7, 100)]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, s array<long>").orderBy("i").select(decontaminate.simhash(F.col("s"))).collect()]
    for s, print_ in zip(sets, got):
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in s) > len(s))
        assert print_ % 2**64 == want


def test_planted_windows_lie_within_the_radius(spark):
    rng = random.Random(2)
    pairs = []
    for i in range(2000):
        m = 1 + i % 50
        item = [rng.getrandbits(63) for _ in range(m)]
        window = [*item]
        for at in rng.sample(range(m), m // 9):  # (m - d) / (m + d) is 0.8 at least up to here
            window[at] = rng.getrandbits(63)
        pairs.append((item, window))
    df = spark.createDataFrame(pairs, "x array<long>, y array<long>").repartition(4)
    apart = F.bit_count(decontaminate.simhash(F.col("x")).bitwiseXOR(decontaminate.simhash(F.col("y"))))
    found = df.select(apart.alias("bits"), decontaminate.similarity(F.col("x"), F.col("y")).alias("s")).agg(F.max("bits"), F.min("s")).first()
    assert found[0] <= decontaminate.RADIUS and found[1] >= 0.8


@pytest.mark.parametrize("bounds", [{}, {"INLINE": 3}, {"MAX_ITEMS": 0, "MAX_KEYS": 0}])
def test_decontamination_is_the_same_on_either_side_of_its_bounds(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(decontaminate, name, value)
    rng = random.Random(3)
    item = [f"w{rng.randrange(300)}" for _ in range(40)]
    other = [f"v{i}" for i in range(60)]
    docs = [(None, " ".join(item))] * 3 + [(1, " ".join(other[:30] + item + other[30:]))] * 2 + [(1, "clean"), (None, "clean"), (2, " ".join(item[:20] + other)), (3, ""), (4, None), (5, "a " * 400)]
    bench = spark.createDataFrame([(10, " ".join(item)), (10, " ".join(item)), (11, "a " * 390), (12, "")], "item_id long, text string")
    df = spark.createDataFrame(docs, DOCS)
    assert rows(decontaminate.leaks(df, bench), "doc_id", "item_id") == sorted([(None, 10), (1, 10), (5, 11)], key=repr)
    assert rows(decontaminate.decontaminate(df, bench), "doc_id", F.substring("text", 1, 5)) == sorted([(1, "clean"), (None, "clean"), (2, docs[7][1][:5]), (3, ""), (4, None)], key=repr)


# 4


@pytest.mark.parametrize("case", ["even", "one key", "skewed"])
def test_sharding_equals_a_placement_in_order(spark, case):
    rng = random.Random(4)
    key = {"even": lambda i: rng.getrandbits(50), "one key": lambda i: 7, "skewed": lambda i: 7 if i % 3 else rng.getrandbits(50)}[case]
    data = [(None if i % 50 == 0 else i, rng.choice([1, 5, 300]), key(i)) for i in range(2000)] + [(5, 5, 9)] * 3
    df = spark.createDataFrame(data, "doc_id long, size long, key long").repartition(5)
    got = sharding.shard(df, 7, range_bytes=500)
    total, at, want, first = sum(s for _, s, _ in data), 0, [], {}
    for n, (i, size, k) in enumerate(sorted(data, key=lambda r: (r[2], -1 if r[0] is None else r[0], r[1]))):
        s = min(6, int((at + size - size / 2 if size else at) * 7 / total))
        at += size
        want.append((i, size, k, s, n - first.setdefault(s, n)))
    columns = ["doc_id", "size", "key", "shard", "slot"]
    # rows alike in doc_id, size and key may trade places
    assert rows(got, *columns[:4]) == sorted([w[:4] for w in want], key=repr)
    assert rows(got, "shard", "slot") == sorted([w[3:] for w in want], key=repr)
    assert rows(got.where("doc_id > 5"), *columns) == sorted([w for w in want if (w[0] or 0) > 5], key=repr)


def test_sharding_cuts_groups_at_the_ends_of_shards_only(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sharding.shard(docs, 24, sharding.text_size("text"), sharding.text_key("text", "doc_id")).groupBy(F.md5(F.coalesce("text", F.lit("")))).agg(F.count_distinct("shard").alias("n"), F.min("shard").alias("lo"), F.max("shard").alias("hi"))
    groups = got.collect()
    assert all(r.hi - r.lo == r.n - 1 for r in groups) and sum(r.n > 1 for r in groups) <= 23


# 5


def brute_statements(text, threshold=0.8):
    """(labels, the largest containment) by trying every run of every template's length."""
    w, found = licenses._words(text or ""), {}
    for template, label in licenses.TEMPLATES.items():
        own = licenses._words(template)
        body, span = set(own), -(-len(own) * 10 // 8)
        need = -(-len(body) * 8 // 10)
        for i in range(max(1, len(w) - span + 1)):
            run = set(w[i : i + span])
            n = len(run & body)
            if n >= need and body & licenses.TELLING <= run and not (licenses.FOREIGN.get(label, set()) - body) & run:
                found[label] = max(found.get(label, 0), n / len(body))
    return sorted(found), max(found.values(), default=0.0)


def test_statements_equal_every_run_tried(spark):
    rng = random.Random(5)
    texts = [
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ]
    for i in range(150):
        template = licenses._words(rng.choice(list(licenses.TEMPLATES)))
        for _ in range(rng.randrange(4)):
            template[rng.randrange(len(template))] = rng.choice(["x", "lesser", "nc", "sharealike", "the", "mit"])
        if rng.random() < 0.3:
            rng.shuffle(template)
        around = [[rng.choice(["a", "the", "license", "gnu", "under", "sa", "y"]) for _ in range(rng.randrange(30))] for _ in range(2)]
        texts.append(rng.choice([" ", "\n", " - "]).join([*around[0], *template, *around[1]]))
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    got = {r.doc_id: r for r in licenses.scan(df, table={}).collect()}
    assert [got[i].labels for i in range(3)] == ["cc-by-nc-sa", "agpl", "lgpl"]
    for i, text in enumerate(texts):
        labels, best = brute_statements(text)
        assert (got[i].labels, round(got[i].score, 9)) == (",".join(labels), round(best, 9)), text


# 6


def test_mixing_many_sources_and_a_source_of_one_byte(spark, monkeypatch):
    docs = [(i, "x" * 20, f"s{i}") for i in range(5000)] + [(-1, "y", "tiny")]
    weights = {f"s{i}": 1.0 for i in range(5000)} | {"tiny": 500.0}
    df = spark.createDataFrame(docs, DOCS + ", source string")
    monkeypatch.setattr(mixing, "RUN", 512)
    got = mixing.mix(df, weights)
    tiny = [r.replica for r in got.where("source = 'tiny'").select("replica").collect()]
    assert sorted(tiny) == list(range(len(tiny))) and abs(len(tiny) / (500 / 5500 * 100_001) - 1) < 0.05
    n = got.where("source <> 'tiny'").count()
    assert abs(n / (5000 / 5500 * 100_001 / 20) - 1) < 0.05
    monkeypatch.setattr(mixing, "MOST", 1000.0)
    with pytest.raises(PySparkException, match="tiny"):
        mixing.mix(df, weights)


# 8


def test_large_components_are_exact_or_refused(spark):
    def frame(data):
        return spark.createDataFrame(data, "vec_id long, v array<long>")

    q, v = [2**32, 1, 0], [2**21, 1, 2**32]
    got = topk.top_k(frame([(1, v), (2, [1, 1, 1])]), frame([(0, q)])).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2**53 + 1), (2, 2**32 + 1)]
    with pytest.raises(PySparkException, match="64 bits"):
        topk.top_k(frame([(1, [2**40, 2**40])]), frame([(0, [2**40, 2**40])])).collect()
    wide = spark.createDataFrame([(1, [1e15, -4e15]), (2, [3e38, 1.0])], "vec_id long, embedding array<double>")
    assert topk.integer_vectors(wide.where("vec_id = 1")).first().v == [256 * 10**15, -1024 * 10**15]
    with pytest.raises(PySparkException, match="vector 2"):
        topk.integer_vectors(wide).collect()
    ends = [np.iinfo(np.int64).min, np.iinfo(np.int64).max, 0]
    cells = topk.Cells(np.array(ends[:1]), np.array(ends[1:2]))
    assert cells.of(np.array(ends).reshape(-1, 1)).ravel().tolist() == [0, 255, 128]


def test_cells_spare_exact_vectors_and_lose_none(spark, monkeypatch):
    rng = np.random.default_rng(9)
    v = np.floor(256 * rng.normal(size=(3000, 16))).astype(np.int64)
    v[500:1500] = v[500]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<long>").repartition(3)
    wanted = []
    exact = topk._exact

    def counted(pairs, *rest):
        wanted.append(pairs.select("vec_id", "h1").distinct().count())
        return exact(pairs, *rest)

    monkeypatch.setattr(topk, "_exact", counted)
    monkeypatch.setattr(topk, "FEW", 10)
    got = topk.top_k(df, df.where("vec_id % 300 = 0"), 5, block=4).collect()
    for q in range(0, 3000, 300):
        best = sorted((-int(v[q] @ v[i]), i) for i in range(3000) if i != q)[:5]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(i, -s) for s, i in best]
    assert sum(wanted) < 0.1 * len(v)


@pytest.mark.parametrize("far", [1, 5])
def test_far_vectors_do_not_open_the_cells(spark, monkeypatch, far):
    rng = np.random.default_rng(8)
    v = np.floor(256 * rng.normal(size=(4000, 16))).astype(np.int64)
    v[-far:] = 10**9
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<long>").repartition(3)
    found, candidates = [], topk.candidates

    def counted(*args):
        out = candidates(*args)
        found.append(out.where("query_id < 3990").count())
        return out

    monkeypatch.setattr(topk, "candidates", counted)
    monkeypatch.setattr(topk, "HELD", 1000)
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()
    for q in range(0, 4000, 500):
        best = sorted((-int(v[q] @ v[i]), i) for i in range(4000) if i != q)[:5]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(i, -s) for s, i in best]
    assert sum(found) < 0.02 * 80 * len(v)


def test_very_long_texts_are_read_to_their_ends(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    data = [(1, long, "a"), (2, long + " more", "a"), (3, "short text of a few words", "b")]
    docs = spark.createDataFrame(data, DOCS + ", source string").repartition(2)
    joined = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()}
    assert joined == {1: (149_996, 1), 2: (149_997, 1), 3: (2, 3)}
    kept = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.dedup(docs).select("doc_id", "n_words", "n_removed").collect()}
    assert kept == {1: (150_000, 0), 2: (150_001, 150_000), 3: (6, 0)}
    placed = sharding.shard(docs, 3, sharding.text_size("text"), sharding.text_key("text", "doc_id"))
    assert sorted(r[0] for r in placed.select(F.length("text")).collect()) == sorted(len(t) for _, t, _ in data)
    mixed = mixing.mix(docs, {"a": 1.0, "b": 1.0}).where("source = 'a'").select(F.md5("text").alias("h"), "doc_id").distinct().collect()
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.md5("text").alias("h")).collect()}
    assert all(hashes[r.doc_id] == r.h for r in mixed)


# all


def test_carried_columns_keep_their_names(spark):
    df = spark.createDataFrame([(1, "a", 2, 3)], ["doc_id", "Text", "a.b`c", "Made"])
    held = common.Carried(df, ("made",))
    back = held.back(held.df.withColumn("doc_id", F.lit(9)), F.lit(5).alias("made"))
    assert back.columns == ["doc_id", "Text", "a.b`c", "made"] and tuple(back.first()) == (1, "a", 2, 5)
    assert held["TEXT"] == "c1"


def test_a_cluster_needs_a_shared_folder():
    class Session:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Session)


# 5


def test_words_strewn_over_a_long_line_are_no_statement(spark):
    far = " and so on with many more words of any kind " * 3
    texts = [f"all {far} rights {far} reserved", f"released {far} under {far} the mit {far} license", "x " * 500 + "All rights reserved. " + "y " * 500, "Copyright. All rights reserved by us"]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got == {0: ("", 0.0), 1: ("", 0.0), 2: ("all-rights-reserved", 1.0), 3: ("all-rights-reserved", 1.0)}


# 7


def test_templates_at_the_bound_and_in_long_texts(spark, monkeypatch):
    footer = "read more on the site"
    docs = [(None, f"text {chr(97 + i)} says\n{footer}") for i in range(7)] + [(None, f"text a says\n{footer}")] * 3
    assert {r.n_dropped for r in line_templates.dedup(spark.createDataFrame(docs, DOCS)).collect()} == {0}
    docs += [(5, "\n".join(f"own line number {i} {chr(97 + i % 26)}x" for i in range(3000)) + f"\n{footer}")]
    for many in (300_000, 0):
        monkeypatch.setattr(line_templates, "MANY", many)
        got = line_templates.dedup(spark.createDataFrame(docs, DOCS)).collect()
        assert len(got) == 11 and all(r.n_dropped >= 1 and footer not in r.kept_text for r in got)


# 3


def test_rows_of_one_doc_id_and_different_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    df = spark.createDataFrame([(5, a), (5, b), (2, a), (3, b), (9, c), (9, c), (9, c + " more"), (7, c + " other"), (None, a)], DOCS)
    assert rows(ngram_join.join(df), "doc_id", "component_id") == sorted([(5, 2), (5, 2), (2, 2), (3, 2), (9, 7), (9, 7), (9, 7), (7, 7), (None, None)], key=repr)
    assert rows(ngram_join.one_of_each(df), "doc_id", "text") == sorted([(2, a), (7, c + " other"), (None, a)], key=repr)
    own = spark.createDataFrame([(1, a), (1, b), (1, a), (4, c)], DOCS)
    assert rows(ngram_join.one_of_each(own), "doc_id", "text") == sorted([(1, a), (1, b), (4, c)], key=repr)


# 9


def test_sketches_never_count_too_little(spark):
    texts = [" ".join(f"w{(i * 7 + j) % 90}" for j in range(80)) for i in range(40)]
    data, offsets = textops.buffers(textops.binary(pa.array(texts)))
    row, _, anchor = substrings.anchors(textops.words(data, offsets), 50, 16)
    bits = substrings.repeated_anchors(spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3), 20, 50, 16)
    n = Counter(a for _, a in {(r, int(a)) for r, a in zip(row, anchor)})
    repeated = np.array([a for a, k in n.items() if k > 1], np.uint64)
    single = np.array([a for a, k in n.items() if k == 1], np.uint64)
    assert len(repeated) and substrings._repeated(bits, repeated, 20).all() and not substrings._repeated(bits, single, 20).any()


@pytest.mark.parametrize("longer", [False, True])
def test_texts_of_one_id_are_told_apart_by_all_of_their_hash(spark, longer):
    """Two texts of one doc_id whose hashes share 23 bits: only the words of the one that is covered go."""
    rng = random.Random(1)
    size = {0: 60, 1: 95 if longer else 60}
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(size[i % 2])) for i in range(12_000)]
    low = spark.createDataFrame(list(enumerate(texts)), DOCS).select("doc_id", F.hash("text").bitwiseAND((1 << 23) - 1).alias("low"), F.xxhash64("text").bitwiseAND((1 << 23) - 1).alias("low64"))
    held: dict = {}
    met = []
    for r in low.collect():
        for kind in ("low", "low64"):
            other = held.setdefault((kind, r[kind]), r.doc_id)
            if other != r.doc_id and other % 2 != r.doc_id % 2:
                met.append((other, r.doc_id))
    assert met
    docs = []
    for n, (a, b) in enumerate(met):
        short, other = (a, b) if a % 2 == 0 else (b, a)
        docs += [(10 * n, texts[short]), (10 * n + 7, texts[short]), (10 * n + 7, texts[other]), (10 * n + 7, texts[other])]
    got = substrings.dedup(spark.createDataFrame(docs, DOCS)).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=repr) == brute_substrings(docs, 50)


# 10


def test_margins_equal_the_sum_over_pairs():
    rng = np.random.default_rng(10)
    fm = toxicity.FactorizationMachine(np.arange(50, dtype=np.int32), 0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    texts = [np.sort(rng.choice(50, n, replace=False)) for n in (0, 1, 2, 9, 30)]
    got = fm.margins(5, np.repeat(np.arange(5), [len(t) for t in texts]), np.concatenate(texts))
    for z, t in zip(got, texts):
        want = fm.bias + sum(fm.w[i] for i in t) + sum(float(fm.v[i] @ fm.v[j]) for n, i in enumerate(t) for j in t[:n])
        assert abs(z - want) < 1e-9


def test_pairs_that_no_linear_weights_separate(spark):
    rng, docs, labels = random.Random(11), [], []
    for i in range(1600):
        kind = rng.randrange(4)
        w = [f"w{rng.randrange(60)}" for _ in range(4)] + {0: ["calm"], 1: ["insult"], 2: ["group"], 3: ["insult", "group"]}[kind]
        docs.append((i, " ".join(w)))
        labels.append((i, int(kind in (0, 3))))
    df, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    # without "calm" the two words alone say nothing: both and neither are 1, one of them is 0
    df = df.withColumn("text", F.replace("text", F.lit("calm"), F.lit("")))
    model = toxicity.fit(df, lab, epochs=20, min_chi2=0.0, min_support=300)
    got = toxicity.score(df, model).join(lab, "doc_id").where(toxicity.held_out()).toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.95
    linear = toxicity.FactorizationMachine(model.known, model.bias, model.w, model.v * 0)
    got = toxicity.score(df, linear).join(lab, "doc_id").where(toxicity.held_out()).toPandas()
    assert (got["predicted"] == got["toxic"]).mean() < 0.8


def test_toxicity_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"  # the smaller folders hold too few labels to learn from
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs.withColumn("predicted", F.lit("old")), toxicity.fit(docs, labels)).join(labels, "doc_id").where(toxicity.held_out()).toPandas()
    yes, no = (got[got["toxic"] == x]["score"].to_numpy() for x in (1, 0))
    auc = (yes[:, None] > no[None, :]).mean() + 0.5 * (yes[:, None] == no[None, :]).mean()
    assert len(yes) >= 50 and auc >= 0.95


def test_toxicity_of_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(i, "bad word" if i % 2 else "good word") for i in range(200)] + [(None, "bad word"), (1, "bad word")], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert len(got) == 202 and all(r.predicted == int("bad" in r.text) for r in got)


CLASHING = ["c0", "c1", "id", "hash", "row", "n", "size", "key", "range", "to", "middle", "at", "source", "rate", "draws", "cdf", "run", "order", "h1", "h2", "line", "lines", "leaf", "body", "doc", "tag", "cell", "starts", "sizes", "plain", "blocks", "base", "known", "best", "_source", "_hash", "_id", "_mine"]


@pytest.mark.parametrize("name", ["decontaminate", "shard", "scan", "mix", "lines", "dedup", "score", "one_of_each"])
def test_columns_of_any_name_are_carried(spark, name):
    df = spark.createDataFrame([(i, f"mit license of {i} words", "a") for i in range(20)] + [(20, None, None)], DOCS + ", source string")
    df = df.withColumns({c: F.lit(f"kept {c}") for c in CLASHING if c != "source"})
    bench = spark.createDataFrame([(1, "nothing like it at all here")], "item_id long, text string")
    fm = toxicity.FactorizationMachine(np.full(1 << toxicity.BITS, -1, np.int32), 0.0, np.zeros(0), np.zeros((0, 2)))
    got = {
        "decontaminate": lambda: decontaminate.decontaminate(df, bench), "shard": lambda: sharding.shard(df, 3, sharding.text_size("text"), sharding.text_key("text", "doc_id")),
        "scan": lambda: licenses.scan(df), "mix": lambda: mixing.mix(df, {"a": 1.0}), "lines": lambda: line_templates.dedup(df), "dedup": lambda: substrings.dedup(df),
        "score": lambda: toxicity.score(df, fm), "one_of_each": lambda: ngram_join.one_of_each(df),
    }[name]()
    assert got.columns[: len(df.columns)] == df.columns
    found = got.collect()
    assert found and all(r[c] == f"kept {c}" for r in found for c in CLASHING if c != "source")
