"""Ids and texts against the library, over a folder's documents, odd texts, and vocabularies made to be awkward."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from larkspur.llm import piece_tokens, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  a", "a  ", "\n", "a\tb", "▁x▁", "<s></s><unk>", "\x00\x01", "ﬁ ½ Ａ", "é", "é", "​", "日本語", "🤗🤗 x", "<0x41>", " " * 300 + "a", "x9Q" * 60_000, "the " * 30_000, "Ａ" * 500]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return piece_tokens.Vocabulary.load(MODEL)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_the_library(spark, sf_dir, library):
    got = {r.doc_id: r for r in queries.op12_piece_tokens(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "")
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_odd_texts_and_clashing_columns(spark, library):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(ODD + ODD[:3])], "doc_id long, text string, Decoded string, `c0` string")
    out = piece_tokens.decode(piece_tokens.encode(df, MODEL), MODEL)
    assert out.columns == ["doc_id", "text", "c0", "ids", "decoded"]
    for r in out.collect():
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
    assert piece_tokens.decode(piece_tokens.encode(df.limit(0), MODEL), MODEL).count() == 0


def test_decoding_of_any_ids(spark, library):
    rng = random.Random(5)
    rows = [[rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(30))] for _ in range(300)]
    df = spark.createDataFrame([(r,) for r in rows if library.decode(r).count("�") == 0] + [(None,), ([1, 2, None],)], "ids array<int>")
    for r in piece_tokens.decode(df, MODEL).collect():
        assert r.decoded == library.decode([i for i in r.ids or [] if i is not None])


def test_made_up_texts(library, vocabulary):
    encoder, rng, pieces = piece_tokens.Encoder(vocabulary), random.Random(6), list(vocabulary.scores)
    for k in range(4000):
        kind = [lambda: "".join(rng.choice("ab cde \n\tfoosthe  ing") for _ in range(rng.randrange(60))), lambda: "".join(rng.choice(pieces) for _ in range(rng.randrange(12))).replace("▁", " "), lambda: "".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(1, 0x3000), 32])) for _ in range(rng.randrange(40)))][k % 3]
        text = kind()
        assert encoder.text(text) == library.encode(text)


def test_few_words_remembered_change_nothing(library, vocabulary, monkeypatch):
    monkeypatch.setattr(piece_tokens, "KNOWN", 3)
    encoder = piece_tokens.Encoder(vocabulary)
    text = "some words that are told apart, some words that are not " * 20
    assert encoder.text(text) == library.encode(text) and len(encoder.words) <= 3 and len(encoder.pairs) <= 3


@pytest.mark.parametrize("seed", range(6))
def test_vocabularies_with_ties_and_odd_orders(seed):
    """Parts that score worse than what they make up, equal scores, and pieces that merging doesn't reach."""
    rng = random.Random(seed)
    made = {c: -9.0 for c in "abc▁"} | {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))): -float(rng.randrange(1, 8)) for _ in range(25)}
    ids = {p: i for i, p in enumerate(made)}
    vocabulary = piece_tokens.Vocabulary.of(made, ids, [1000 + b for b in range(256)], [])
    encoder, back = piece_tokens.Encoder(vocabulary), list(ids)
    for _ in range(800):
        word = "▁" + "".join(rng.choice("abc") for _ in range(rng.randrange(14)))
        assert [back[i] for i in encoder.word(word)] == piece_tokens.merged(list(word), made)[0]
    assert encoder.word("▁añb") == (*encoder.word("▁a"), 1000 + 0xC3, 1000 + 0xB1, *encoder.word("b"))


def test_texts_are_cut_where_no_piece_goes_on(library, vocabulary):
    """Words that stand beside many signs and line ends are encoded once; a text without spaces was one word before."""
    encoder, calls = piece_tokens.Encoder(vocabulary), []
    word = encoder.word
    encoder.word = lambda w: calls.append(w) or word(w)
    text = "".join(f"erheed{a}\nthnting{b}" for a in ".,!?" for b in ".,!?")
    assert encoder.text(text) == library.encode(text)
    assert len(calls) <= 20 and all(len(w) <= 12 for w in calls)


def test_texts_side_by_side(library, vocabulary, monkeypatch):
    """Texts of one batch, some of them null or empty, slices of it, and batches that are taken in several runs."""
    texts = [*ODD, None, "", "a", " ", "a ", " a", "  ", "", None, "▁", "é▁", "\n", "x\n\n y"]
    held = pa.array([None, "zz", *texts, "zz"], pa.string()).slice(2, len(texts))
    want = [library.encode(t or "") for t in texts]
    encoder = piece_tokens.Encoder(vocabulary)
    ids = encoder.texts(held)
    assert ids.to_pylist() == want
    assert piece_tokens.texts_of(ids, pa.array([*vocabulary.texts, b""], pa.binary())).to_pylist() == [library.decode(w) for w in want]
    assert encoder.texts(held.slice(3, 5)).to_pylist() == want[3:8]
    monkeypatch.setattr(piece_tokens, "SENT", 10)
    sizes = np.array([len((t or "").encode()) for t in texts])
    runs = list(piece_tokens.spans(sizes))
    assert len(runs) > 10 and [i for first, n in runs for i in range(first, first + n)] == list(range(len(texts)))
    assert all(sizes[first + 1 : first + n].sum() < 10 for first, n in runs) and not list(piece_tokens.spans(sizes[:0]))


def test_nothing_but_nulls_and_bytes_that_are_no_text(vocabulary):
    texts = pa.array([*vocabulary.texts, b""], pa.binary())
    rows = [None, [], [None], [vocabulary.byte_ids[0xFF], vocabulary.ids["▁a"]], [vocabulary.ids["▁a"], None, vocabulary.byte_ids[0xC3]]]
    held = pa.array(rows, pa.list_(pa.int32()))
    assert piece_tokens.texts_of(held, texts).to_pylist() == ["", "", "", "� a", "a�"]
    assert piece_tokens.texts_of(held.slice(0, 3), texts).to_pylist() == ["", "", ""]
    assert piece_tokens.Encoder(vocabulary).texts(pa.array([None, ""], pa.string())).to_pylist() == [[], []]


def test_bigger_table_of_odd_texts(spark, library):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else "" if i % 5 == 0 else f"some {i} words\nof {i % 13}.  and") for i in range(5000)], "doc_id long, text string").coalesce(1)
    for r in piece_tokens.decode(piece_tokens.encode(df, MODEL), MODEL).collect():
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)


def test_words_of_late_stay_remembered(library, vocabulary, monkeypatch):
    monkeypatch.setattr(piece_tokens, "KNOWN", 8)
    encoder, calls = piece_tokens.Encoder(vocabulary), []
    word = encoder.word
    encoder.word = lambda w: calls.append(w) or word(w)
    for i in range(60):
        assert encoder.text(f"often w{i}x") == library.encode(f"often w{i}x")
        assert len(encoder.words) + len(encoder.older) <= 8
    assert calls.count("▁often") == 1
