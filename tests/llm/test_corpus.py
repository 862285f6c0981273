"""Corpus operators against brute force, SQL and hand-made edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import components, decontaminate, licenses, line_templates, mixing, ngram_join, sharding, substrings, textops, topk, toxicity, warc
from larkspur.llm.queries import ORACLE_SQL, QUERIES

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels"]
DOCS = "doc_id long, text string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(name, spark, duck, sf_dir):
    df, want = QUERIES[name](spark, sf_dir), duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


# words and n-grams


def test_words_and_grams():
    texts = ["", " a b\tc ", "É x  y\n", "one", "a b c a b c"]
    data, offsets = textops.buffers(textops.binary(pa.array([*texts, None])))
    w = textops.words(data, offsets)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in [*texts, ""]]
    got = [bytes(w.data[s:e]).decode() for s, e in zip(w.start, w.end)]
    assert got == sum(want, []) and w.counts.tolist() == [len(x) for x in want]
    for k in (2, 3, 9):
        g, n = textops.grams(w.hash, w.first, k)
        assert n.tolist() == [max(0, len(x) - k + 1) for x in want]
    g, _ = textops.grams(w.hash, w.first, 3)
    last = g[-4:]
    assert last[0] == last[3] and len(set(last.tolist())) == 3


def test_pieces_cover_every_row_once():
    column = pa.array(["x" * 10, "", "y" * 50, None, "z"])
    assert [i for a, b, _, _ in textops.pieces(column, 12) for i in range(a, b)] == [0, 1, 2, 3, 4]


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 100, 200)
    for k in (1, 2, 3, 8, 35):
        assert substrings.sliding_min(x, k).tolist() == [x[i : i + k].min() for i in range(len(x) - k + 1)]


# 1


def test_decontamination_edges(spark):
    rng = random.Random(1)
    item = prose(rng, 30)
    near = [*item]
    near[0] = "other"
    far = [w if i % 4 else "other" for i, w in enumerate(item)]
    docs = [(1, " ".join(prose(rng, 50) + item + prose(rng, 20))), (2, " ".join(prose(rng, 40) + near)), (3, " ".join(far)), (4, None), (5, ""), (6, "tiny item"), (7, " ".join(prose(rng, 4000) + item)), (None, " ".join(item)), (8, ", ".join(item).upper())]
    bench = frame(spark, [(10, " ".join(item)), (11, "Tiny item!"), (12, None), (13, "")], "item_id long, text string")
    df = frame(spark, [(i, t, "x") for i, t in docs], DOCS + ", similarity string")
    found = rows(decontaminate.leaks(df, bench), "doc_id", "item_id")
    assert found == sorted([(1, 10), (2, 10), (6, 11), (7, 10), (None, 10), (8, 10)], key=repr)
    assert rows(decontaminate.decontaminate(df, bench), "doc_id", "similarity") == [(3, "x"), (4, "x"), (5, "x")]
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_decontamination_beyond_the_inline_bound(spark, sf_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = rows(decontaminate.leaks(docs, bench), "doc_id", "item_id", "similarity")
    monkeypatch.setattr(decontaminate, "INLINE", 3)
    assert rows(decontaminate.leaks(docs, bench), "doc_id", "item_id", "similarity") == want and want


def test_decontamination_edges_beyond_the_inline_bound(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "INLINE", 3)
    test_decontamination_edges(spark)
    text = " ".join(prose(random.Random(2), 30))
    df, bench = frame(spark, [(None, text)] * 3 + [(1, text)] * 3 + [(None, "clean"), (1, "clean")]), frame(spark, [(10, text)], "item_id long, text string")
    assert rows(decontaminate.leaks(df, bench), "doc_id", "item_id") == sorted([(1, 10), (None, 10)], key=repr)
    assert rows(decontaminate.decontaminate(df, bench), "doc_id", "text") == sorted([(1, "clean"), (None, "clean")], key=repr)


def test_multi_index_meets_everything_within_the_radius():
    rng = random.Random(3)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), decontaminate.RADIUS):
            y ^= 1 << b
        assert any((x >> 8 * b & 255) ^ (y >> 8 * b & 255) in decontaminate.NEAR for b in range(8))


# 2


def test_warc_round_trip(spark):
    long = "é" * 700
    pages = [(1, "http://a", long), (2, "http://b", long), (3, None, long), (4, "http://c", "short"), (5, "http://d", "short"), (6, "", None), (7, "http://a b\r\n\r\nX: é", ""), (8, "big", "z" * 300_000), (None, "n", long)]
    df = frame(spark, pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    folder, index = warc.write_archive(df.repartition(3), frame_bytes=2000, bundle_bytes=500)
    back = {r.page_id: r for r in warc.read_archive(folder, index).collect()}
    for i, url, html in pages:
        raw = (html or "").encode()
        assert back[i].url == url
        assert back[i].payload_bytes == len(raw) and back[i].payload_digest == hashlib.sha1(raw).hexdigest()
        revisit = i in (1, 2, None)
        assert (back[i].record_type, back[i].refers_to) == (("revisit", 3) if revisit else ("response", None))
        assert back[i].payload is None if revisit else bytes(back[i].payload) == raw
    for r in index.collect():
        head, body = warc.fetch(folder, r.bundle, r.frame, r.record_offset)
        assert head["WARC-Record-ID"] == f"<urn:page:{'none' if r.page_id is None else r.page_id}>"
        assert len(body) == (0 if head["WARC-Type"] == "revisit" else back[r.page_id].payload_bytes)
    folder, index = warc.write_archive(df.limit(0))
    assert warc.read_archive(folder, index).count() == 0


def test_warc_joins_by_shuffle_too(spark, sf_dir, monkeypatch):
    want = rows(QUERIES["op2_warc"](spark, sf_dir), "*")
    monkeypatch.setattr(warc, "REPEATED", 0)
    assert rows(QUERIES["op2_warc"](spark, sf_dir), "*") == want


def test_bundles_are_plain_zstandard(tmp_path):
    import zstandard

    out = warc.Bundles(f"file://{tmp_path}", 100, 10_000, 3)
    for i in range(5):
        out.add(i, warc.record(i, "u", b"x" * 60, "d", 60, "response", None))
    out.end_bundle()
    data = next(tmp_path.iterdir()).read_bytes()
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert plain.count(b"WARC/1.1") == 5


# 3


def brute_components(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed: int) -> dict[int, str | None]:
    rng, out = random.Random(seed), {}
    passage = prose(rng, 25)
    for g in range(12):
        base = prose(rng, rng.choice([4, 5, 9, 60, 150]))
        for _ in range(rng.choice([1, 2, 5, 40 if g == 0 else 3])):
            w = [*base]
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
            out[len(out)] = " ".join(w + (passage if rng.random() < 0.3 else []))
    out |= {len(out) + i: t for i, t in enumerate([None, "", "  ", "One", "one", "a b", "A  B"])}
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [1, 16])
def test_join_equals_brute_force(spark, seed, small, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    texts = near_copies(seed)
    df = frame(spark, [(i, t, 5) for i, t in texts.items()], DOCS + ", component_id int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
    assert got == brute_components(texts)


def test_join_edges(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = frame(spark, [(5, text), (5, text), (None, text), (9, text), (7, "other words here")])
    assert rows(ngram_join.join(df), "*") == sorted([(5, 26, 5), (5, 26, 5), (9, 26, 5), (7, 1, 7), (None, 26, None)], key=repr)
    assert rows(ngram_join.one_of_each(df), "doc_id") == sorted([(5,), (7,), (None,)], key=repr)
    assert ngram_join.join(df.limit(0)).count() == 0


def test_prefixes_keep_every_link():
    rng, sim = np.random.default_rng(5), ngram_join.Similarity(4, 5)
    kind = rng.integers(0, 3, 500).astype(np.int8)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = np.sort(rng.choice(500, n, replace=False))
        y = x.copy()
        k = int(rng.integers(0, max(1, n // 8) + 1))
        y[rng.choice(n, k, replace=False)] = 500 + np.arange(k)
        y = np.unique(y)
        both = len(np.intersect1d(x, y))
        if 5 * both < 4 * len(np.union1d(x, y)):
            continue
        classes = np.r_[kind, np.zeros(100, np.int8)]
        px, lx = ngram_join.chosen_prefix(x, classes[x], sim)
        py, ly = ngram_join.chosen_prefix(y, classes[y], sim)
        met = len(np.intersect1d(x[px], y[py]))
        assert met >= min(lx, ly)
        beyond = max(sim.overlap(len(x)) - lx, sim.overlap(len(y)) - ly) + 1
        assert met + beyond >= both


@pytest.mark.parametrize("links", [[], [(1, 2), (2, 3), (9, 8)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(3, 1), (2, 1), (4, 2), (7, 7)]])
@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, links, few, monkeypatch):
    monkeypatch.setattr(components, "FEW", few)
    up = {x: x for l in links for x in l if l[0] != l[1]}
    for _ in range(len(up)):
        for a, b in links:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert {r.node: r.component for r in components.components(frame(spark, links, "a long, b long")).collect()} == up


# 4


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_sharding_law(spark, shards):
    rng = random.Random(4)
    texts = [(i, "same" * 50 if i % 3 == 0 else "é" * rng.randrange(300)) for i in range(3000)] + [(3000, None), (3001, None), (1, "same"), (1, "same")]
    df = frame(spark, texts).select("doc_id", sharding.text_size("text").alias("size"), sharding.text_key("text", "doc_id").alias("key"), F.lit("old").alias("slot"))
    got = sharding.shard(df, shards, range_bytes=2000).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(got) == len(texts) and size.max() - size.min() <= 2 * got["size"].max()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert sharding.shard(df.limit(0), shards).count() == 0
    few = sharding.shard(df.limit(3), shards).toPandas()
    assert len(few) == 3


def test_sharding_query(spark, sf_dir):
    got = QUERIES["op4_sharding"](spark, sf_dir).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().sort_values("doc_id")
    raw = [(t or "").encode() for t in docs["text"]]
    assert got["size"].tolist() == [len(r) + 8 for r in raw] and got["text_crc32"].tolist() == [zlib.crc32(r) for r in raw]


# 5


def test_license_edges(spark):
    texts = ["MIT License, mit-license; the MIT  licensed", None, "", "x " * 20_000 + "CC BY", "Released under the MIT Licence.", "Licenced under the Apache License, Version 2.0.", "GNU\nGeneral Public\tLicense", "K MIT License İ", "mité license"]
    df = frame(spark, [(i, t, "old") for i, t in enumerate(texts)], DOCS + ", labels string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (7, 2, 0, 2, "mit")
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (0, 0, None, "", 0.0)
    assert got[2].n_words == 0 and got[3].first_word == 20_000
    assert (got[4].base_labels, got[4].labels) == ("", "mit") and 0.8 <= got[4].score < 1
    assert (got[5].base_labels, got[6].labels, got[7].n_words, got[7].n_base, got[8].n_base) == ("apache", "gpl", 4, 1, 0)
    assert licenses.scan(df.limit(0)).count() == 0
    assert len(licenses.scan(df.unionAll(df)).collect()) == 2 * len(texts)


def test_license_matches_equal_brute_force(spark):
    rng = random.Random(6)
    lines = []
    for _ in range(300):
        t = licenses._words(rng.choice(list(licenses.TEMPLATES)))
        rng.shuffle(t)
        lines.append(" ".join([w for w in t if rng.random() < 0.9] + prose(rng, rng.randrange(4))))
    df = frame(spark, [(i, x) for i, x in enumerate(lines)])
    got = rows(licenses.matches(df, licenses.TEMPLATES, 0.8, ["doc_id"]), "doc_id", "template")
    sets = [set(licenses._words(t)) for t in licenses.TEMPLATES]
    assert got == sorted([(i, k) for i, x in enumerate(lines) for k, s in enumerate(sets) if len(set(licenses._words(x)) & s) >= 0.8 * len(s) - 1e-9], key=repr)


def test_license_statements_over_several_lines(spark):
    bsd, cc = (next(t for t, label in licenses.TEMPLATES.items() if label == x) for x in ("bsd", "cc-by"))
    gpl = "This program is free software: you can redistribute\n * it and/or modify it\n * under the terms of the\n *\n * GNU General Public License"
    texts = [
        (bsd.replace("without ", "without\n"), "bsd", 1.0), ("# " + cc.replace("Commons ", "Commons\n# "), "cc-by", 1.0), ("x\n" * 3000 + gpl, "gpl", 1.0),
        ("\n".join(f"{w} " for w in bsd.split()[:-1]) + "\nend", "bsd", 12 / 13), ("All rights\nreserved.", "all-rights-reserved", 1.0),
        (bsd.replace("without ", "without\n" + "much else " * 20), "", 0.0), ("Released under\nthe BSD License.", "", 0.0), ("Released under the BSD License.", "", 0.0),
        ("Licensed under\nCC-BY 4.0.", "cc-by", 1.0), ("Licensed under CC BY-\nNC 4.0", "cc-by,cc-by-nc", 1.0), ("Licensed under CC-SA BY\n4.0", "", 0.0),
    ]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, [(i, t) for i, (t, _, _) in enumerate(texts)])).collect()}
    for i, (text, labels, score) in enumerate(texts):
        assert (got[i].labels, round(got[i].score, 9)) == (labels, round(score, 9)), text[-100:]


# 6


def test_mixing_rates(spark):
    docs = [(i, "x" * 10, "hot" if i % 3 else f"s{i % 9}") for i in range(6000)] + [(-1, None, None), (-2, "abc", None), (None, "n" * 10, "hot")]
    df = frame(spark, docs, DOCS + ", source string").withColumn("replica", F.lit("old"))
    weights = {"hot": 2.0, "s0": 1.0, "s3": 1.0, "s6": 0.0}
    got = mixing.mix(df, weights, other=0.0).toPandas()
    n = Counter(got["source"])
    assert n["s6"] == 0 and abs(n["hot"] / 3000 - 1) < 0.07 and abs(n["s0"] / 1500 - 1) < 0.1
    assert got["shuffle_key"].is_monotonic_increasing
    for _, part in got.groupby("doc_id"):
        assert sorted(part["replica"]) == list(range(len(part)))
    assert mixing.mix(df.limit(0), weights).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, {"hot": -1.0})


def test_mixing_counts_are_poisson_and_salted_joins_agree(spark, monkeypatch):
    docs = [(i, "abcd", "a" if i % 10 else "b") for i in range(8000)]
    df = frame(spark, docs, DOCS + ", source string")
    got = mixing.mix(df, {"a": 1.0, "b": 9.0}).toPandas()
    n = got[got["source"] == "b"].groupby("doc_id").size().reindex([i for i, _, s in docs if s == "b"], fill_value=0)
    assert abs(n.mean() - 9) < 0.4 and abs(n.var() - 9) < 1.5
    monkeypatch.setattr(mixing, "MANY", 1)
    assert rows(mixing.mix(df, {"a": 1.0, "b": 9.0}), "doc_id", "replica") == sorted([(r.doc_id, r.replica) for r in got.itertuples()], key=repr)


# 7


def test_line_templates_of_numbers_equal_sql(spark, tmp_path):
    rng = random.Random(5)
    shared = ["Tel. 555-0100 555-0101", "2024-01-01", "call 1 or 2", "<*> 7 <*>", "page 3 of the guide"]
    docs = []
    for i in range(60):
        lines = [line for line in shared if rng.random() < 0.3]
        lines += [f"page {rng.randrange(4)} of the guide", f"{rng.randrange(12)} {rng.randrange(3)}", f"Tel. {rng.randrange(99)} 555-0101", f"text {i}x", ""]
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines)))
    docs += [(60, None), (61, ""), (62, docs[0][1])]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    got = rows(QUERIES["op7_line_templates"](spark, str(tmp_path)), *columns)
    assert got == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['op7_line_templates']})").fetchall(), key=repr)
    assert sum(r[2] for r in got) > 100


def test_line_templates(spark):
    docs = [(i, f"Visited page {i} at {i}:00 today\nunique words of text number {chr(97 + i)} only\n\nshared footer line of the site") for i in range(12)]
    docs += [(20, None), (21, ""), (22, "shared footer line of the site"), (23, "plain"), (23, "plain")]
    got = {r.doc_id: r for r in line_templates.dedup(frame(spark, docs).withColumn("n_lines", F.lit("old"))).collect()}
    assert got[3].kept_text == "" or got[3].kept_text.count("\n") <= 1
    assert got[3].n_lines == 4 and "footer" not in got[3].kept_text and "Visited" not in got[3].kept_text
    assert (got[20].n_lines, got[20].kept_text, got[21].n_lines, got[22].kept_text, got[22].n_dropped, got[23].kept_text) == (0, "", 0, "", 1, "plain")
    assert line_templates.dedup(frame(spark, docs).limit(0)).count() == 0


def test_lines_of_digits_that_recur_word_for_word(spark):
    footers = ["2024-01-01", "Tel. 555-0100 555-0101", "<*> 7"]
    docs = [(i, "\n".join([f"text {chr(97 + i)} stays", *footers, f"{i} {i}9 no{i}", f"Order {i} of 7 in {2 * i} weeks for {3 * i}"])) for i in range(9)]
    docs += [(20 + i, "1999-12-31") for i in range(7)]
    got = {r.doc_id: r for r in line_templates.dedup(frame(spark, docs)).collect()}
    for i in range(9):
        assert got[i].n_dropped == 4 and got[i].kept_text == f"text {chr(97 + i)} stays\n{i} {i}9 no{i}"
    assert all(got[20 + i].n_dropped == 0 for i in range(7))


# 8


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(size=(700, 8)), 1)
    v[::3] = v[0]
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 8), (903, []), (904, [1.0, 2.0]), (0, v[0].tolist())]
    df = frame(spark, data, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(3)
    ints = topk.integer_vectors(df)
    got = defaultdict(list)
    for r in topk.top_k(ints, ints.where("vec_id % 50 = 0"), 5, block=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    w = np.floor(256 * v).astype(np.int64)
    for q in range(0, 700, 50):
        best = sorted((-int(w[q] @ w[i]), i) for i in range(700) if i != q)[:5]
        assert got[q] == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert topk.top_k(ints.limit(0), ints.limit(0)).count() == 0
    assert topk.top_k(ints.where("vec_id < 3"), ints.where("vec_id = 0"), 5).count() == 2


def test_large_products_stay_whole():
    q, v = np.full((1, 3), 2**30), np.array([[2**30, 1, 0]])
    assert topk._dot(q, v).tolist() == [2**60 + 2**30]


# 9


def brute_substrings(docs, window):
    first = {}
    words = [(i, (t or "").split()) for i, t in docs]
    for i, w in words:
        for j in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[j : j + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cells", [1 << 16, 1 << 28])
def test_substrings_equal_brute_force(spark, cells):
    rng = random.Random(9)
    passage, docs = prose(rng, 70), []
    for i in range(60):
        w = prose(rng, rng.randrange(120))
        kind = rng.randrange(5)
        if kind == 1:
            w[len(w) // 2 : len(w) // 2] = passage[rng.randrange(20) :]
        if kind == 2 and docs:
            w = (docs[rng.randrange(len(docs))][1] or "").split()
            if w:
                w[rng.randrange(len(w))] = "edit"
        docs.append((i, " ".join(w)))
    docs += [(100, "ha " * 200), (101, "ha " * 60), (102, None), (103, ""), (None, " ".join(passage)), (7, " ".join(passage)), (7, " ".join(passage)), (3, docs[3][1])]
    got = substrings.dedup(frame(spark, docs).withColumn("n_words", F.lit("old")), window=50, gram=16, max_cells=cells)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_text") == brute_substrings(docs, 50)
    assert substrings.dedup(frame(spark, docs).limit(0)).count() == 0


# 10


def test_toxicity_learns_pairs(spark):
    rng = random.Random(10)
    docs, labels = [], []
    for i in range(1500):
        w, kind = prose(rng, 15, 40), rng.randrange(4)
        w += {0: [], 1: ["insult"], 2: ["group"], 3: ["insult", "group"]}[kind]
        rng.shuffle(w)
        docs.append((i, " ".join(w)))
        labels.append((i, int(kind == 3)))
    df, lab = frame(spark, docs), frame(spark, labels, "doc_id long, toxic int")
    model = toxicity.fit(df, lab, epochs=8)
    got = toxicity.score(df.withColumn("score", F.lit("old")), model).join(lab, "doc_id").where(toxicity.held_out()).toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.97


def test_toxicity_edges(spark, sf_dir):
    df = frame(spark, [(1, None), (1, None), (2, ""), (3, "word " * 30_000)])
    none = frame(spark, [], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.fit(df, none)).collect()
    assert len(got) == 4 and {r.score for r in got} == {got[0].score} and {r.predicted for r in got} == {0}
    one = toxicity.fit(df, frame(spark, [(1, 1), (1, None), (2, None)], "doc_id long, toxic int"))
    assert toxicity.score(df.limit(0), one).count() == 0
    scored = QUERIES["op10_toxicity"](spark, sf_dir).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)


# pipeline


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf_dir)
        assert out.columns == docs.columns, name
        before, after = [r.doc_id for r in seen.select("doc_id").collect()], [r.doc_id for r in out.select("doc_id").collect()]
        assert set(after) <= set(before) and after
        if name == "ngram_join":
            texts = {r.doc_id: r.text for r in seen.collect()}
            assert sorted(after) == sorted(i for i, (_, c) in brute_components(texts).items() if i == c)
        if name == "decontamination":
            bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            gone = {r.doc_id for r in decontaminate.leaks(seen, bench).collect()}
            assert sorted(after) == sorted(set(before) - gone)
        if name == "mixing":
            n = Counter(after)
            assert max(n.values()) > 1
        seen = spark.createDataFrame(out.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, seen, sf_dir)
    assert last.count() == seen.count() and {"shard", "slot"} <= set(last.columns)


def test_empty_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
