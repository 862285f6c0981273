"""SentencePiece BPE: texts to ids and back, by the last token of every prefix.

Merging is greedy: of the neighbouring symbols whose concatenation is a piece, those with the best score merge first, the
leftmost of equals. What a stretch of text ends up as, if nothing merges across its ends, depends on the stretch alone.
So a row of tokens is the encoding of its text exactly if every two neighbours are the encoding of theirs, and the
encoding of a prefix ends in exactly one token that fits behind the encoding of what is before it.

1. Table, made once from the vocabulary: for each piece the pieces that it is merged from, followed down its right end
   and its left end. Pieces that greedy merging of their own characters doesn't reach never occur and are left out.
2. Pairs. Two tokens fit if at no time while both are made does a merge across their border come first: their ends are
   gone through in the order of scores, which is the order of merges as parts score better than what they make up. Where
   a vocabulary has a piece for which that fails, its pairs are merged in full.
3. Prefixes. An automaton of all pieces finds those that end at each character; the one that fits behind the last token
   of the prefix before it is stored. Ids are recovered backwards from the end. Time is linear in the text.
4. Characters in no piece are bytes; nothing merges with them. Nothing merges across two characters that no piece has side
   by side, so texts are cut there, by a table of pairs of bytes: before spaces, as no piece goes on behind its leading
   spaces with another (checked when the table is made), around line ends and most punctuation. Arrow tells the words of
   a megabyte of text apart, a task remembers up to ``KNOWN`` of them, and the others are encoded.

Decoding puts the pieces' bytes one after the other and takes the space away that encoding had put in front.

Defined cases: a null or empty text has no ids and decodes to an empty text; spaces only, control characters and the
strings of special tokens are ordinary text; U+2581 is the sign for a space and comes back as a space; texts and words
of any length are encoded whole; ids that stand for no text (control tokens) and null ids decode to nothing, and bytes
that are not UTF-8 to U+FFFD; an empty table gives an empty result; other columns, whatever their names, are carried along,
unless they are named like the output, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, types as T

from larkspur.llm.common import Carried, small_batches

SPACE = "▁"
#: Words that a task remembers, and bytes of text that it takes at a time.
KNOWN, SENT = 1 << 18, 1 << 20
Part = tuple[str, float]


def merged(symbols: list[str], scores: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """Symbols after greedy merging, and the two that were merged last. For short texts: every merge looks at all."""
    last = None
    while True:
        found = [(-scores[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in scores]
        if not found:
            return symbols, last
        _, i = min(found)
        last = symbols[i], symbols[i + 1]
        symbols = [*symbols[:i], "".join(last), *symbols[i + 2 :]]


@dataclass
class Vocabulary:
    """Pieces by text with score and id; ends[piece]: what grows into it at its right and at its left end, from the first
    character on, with scores; odd: pieces with a part that scores worse than they do; beside: for two bytes (256 times
    the first and the second), whether they may stand in one piece."""

    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]
    texts: list[bytes]
    rights: dict[str, list[Part]]
    lefts: dict[str, list[Part]]
    odd: set[str]
    beside: np.ndarray

    @staticmethod
    def load(model_file: str) -> Vocabulary:
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        kinds = [(i, sp.id_to_piece(i)) for i in range(sp.get_piece_size())]
        special = {i for i, _ in kinds if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        byte = {int(p[3:5], 16): i for i, p in kinds if sp.is_byte(i)}
        plain = {p: i for i, p in kinds if i not in special and not sp.is_byte(i)}
        if len(byte) < 256 or any(SPACE in p.lstrip(SPACE) for p in plain) or {c for p in plain for c in p} - set(plain):
            raise ValueError(f"no vocabulary of the supported kind: {model_file}")
        texts = [p.replace(SPACE, " ").encode() if p in plain else b"" for _, p in kinds]
        for value, i in byte.items():
            texts[i] = bytes([value])
        return Vocabulary.of({p: sp.get_score(i) for p, i in plain.items()}, plain, [byte[b] for b in range(256)], texts)

    @staticmethod
    def of(scores: dict[str, float], ids: dict[str, int], byte_ids: list[int], texts: list[bytes]) -> Vocabulary:
        rights: dict[str, list[Part]] = {}
        lefts: dict[str, list[Part]] = {}
        odd = set()
        for piece in sorted(scores, key=len):
            symbols, last = merged(list(piece), scores)
            if len(symbols) > 1:
                continue
            own = [(piece, scores[piece])]
            if last is None:
                rights[piece] = lefts[piece] = own
                continue
            left, right = last
            rights[piece], lefts[piece] = rights[right] + own, lefts[left] + own
            if any(p in odd or (len(p) > 1 and scores[p] < scores[piece]) for p in last):
                odd.add(piece)
        beside = np.zeros((256, 256), np.bool_)
        beside[:, 0x80:0xC0] = True  # inside a character
        for piece in scores:
            data = np.frombuffer(piece.replace(SPACE, " ").encode(), np.uint8)
            beside[data[:-1], data[1:]] = True
        return Vocabulary(scores, ids, byte_ids, texts, rights, lefts, odd, beside.ravel())

    def fits(self, a: str, b: str) -> bool:
        """Whether greedy merging of the two tokens' text gives the two tokens."""
        scores = self.scores
        if a in self.odd or b in self.odd:
            return merged(list(a + b), scores)[0] == [a, b]
        right, left = self.rights[a], self.lefts[b]
        i = j = 0
        while True:
            across = scores.get(right[i][0] + left[j][0])
            grows_left = right[i + 1][1] if i + 1 < len(right) else None
            grows_right = left[j + 1][1] if j + 1 < len(left) else None
            if grows_left is None and grows_right is None:
                return across is None
            # of equal scores the leftmost comes first: the left token's growth, the merge across, the right token's growth
            if grows_left is not None and (grows_right is None or grows_left >= grows_right):
                if across is not None and across > grows_left:
                    return False
                i += 1
            else:
                if across is not None and across >= grows_right:
                    return False
                j += 1


class Encoder:
    """Words to ids, with what a task remembers of words and pairs."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece in vocabulary.rights:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def last_tokens(self, word: str) -> list[str | None]:
        """The last token of each prefix, from one character on; null where that is a character in no piece."""
        last: list[str | None] = [None] * len(word)
        pairs = self.pairs
        for end, piece in self.automaton.iter(word):
            if last[end] is None:
                before = end - len(piece)
                if before >= 0 and (left := last[before]) is not None:
                    fits = pairs.get((left, piece))
                    if fits is None:
                        fits = self._fits(left, piece)
                    if not fits:
                        continue
                last[end] = piece
        return last

    def _fits(self, a: str, b: str) -> bool:
        if len(self.pairs) >= KNOWN:
            self.pairs.clear()
        found = self.pairs[a, b] = self.v.fits(a, b)
        return found

    def word(self, word: str) -> tuple[int, ...]:
        last, at, ids = self.last_tokens(word), len(word), []
        while at:
            piece = last[at - 1]
            if piece is None:
                ids += [self.v.byte_ids[b] for b in reversed(word[at - 1].encode())]
                at -= 1
            else:
                ids.append(self.v.ids[piece])
                at -= len(piece)
        return tuple(reversed(ids))

    def known(self, word: str) -> tuple[int, ...]:
        """The ids of a word with plain spaces. Of the words looked up before, those of late are kept."""
        found = self.words.get(word)
        if found is not None:
            return found
        found = self.older.pop(word, None) or self.word(word.replace(" ", SPACE))
        if len(word) <= 64:
            if len(self.words) >= max(KNOWN // 2, 1):
                self.words, self.older = {}, self.words
            self.words[word] = found
        return found

    def texts(self, texts: pa.StringArray) -> pa.ListArray:
        """The ids of each text. Equal words of them are looked up once."""
        plain = pc.replace_substring(texts.fill_null(""), SPACE, " ")
        spaced = pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise(" ", plain, ""))
        _, offsets, data = spaced.buffers()
        at = np.frombuffer(offsets, np.int32)[spaced.offset : spaced.offset + len(spaced) + 1]
        if at[0] == at[-1]:
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))
        held = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        begins = np.zeros(len(held) + 1, np.bool_)
        begins[1:-1] = ~self.v.beside[held[:-1].astype(np.uint16) << 8 | held[1:]]
        begins[at] = True
        starts = np.flatnonzero(begins[:-1])
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(held)).astype(np.int32)), pa.py_buffer(held)).dictionary_encode()
        found = [self.known(w) for w in words.dictionary.to_pylist()]
        ends = np.zeros(len(found) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, found), np.int32, len(found)), out=ends[1:])
        each = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(found), np.int32, ends[-1]))).take(words.indices)
        return pa.ListArray.from_arrays(pa.array(np.asarray(each.offsets)[np.searchsorted(starts, at)]), each.values)

    def text(self, text: str) -> list[int]:
        return self.texts(pa.array([text], pa.string()))[0].as_py()


def spans(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, count) of runs of rows that have fewer than ``SENT`` bytes beside their first row."""
    if not len(sizes):
        return
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // SENT)) + 1
    for first, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
        yield first, end - first


def encode(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of a text, array<int>, without begin and end ids."""
    small_batches(docs.sparkSession)
    held = Carried(docs, (ids.lower(),), docs["`" + text.replace("`", "``") + "`"].cast("string").alias("_text"))
    # bounded by the vocabulary, whatever the input
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file))
    schema = T.StructType([*held.df.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for first, n in spans(np.asarray(pc.binary_length(batch.column(batch.num_columns - 1)).fill_null(0))):
                *some, texts = batch.slice(first, n).columns
                yield pa.RecordBatch.from_arrays([*some, encoder.texts(texts)], schema.names)

    return held.back(held.df.mapInArrow(run, schema), "ids").withColumnRenamed("ids", ids)


def texts_of(ids: pa.ListArray, texts: pa.BinaryArray) -> pa.StringArray:
    """The texts of lists of ids; the last of ``texts`` is that of a null id."""
    parts = texts.take(ids.flatten().fill_null(len(texts) - 1))
    ends = np.append(0, np.cumsum(np.asarray(pc.list_value_length(ids).fill_null(0))))
    _, offsets, data = parts.buffers()
    at = np.frombuffer(offsets, np.int32, len(parts) + 1)[ends]
    held = np.frombuffer(data or b"", np.uint8)[: at[-1]]
    led = at[:-1] < at[1:]
    led[led] = held[at[:-1][led]] == 32
    held = np.delete(held, at[:-1][led])
    at[1:] -= np.cumsum(led, dtype=np.int32)
    found = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at), pa.py_buffer(held)])
    try:
        return found.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are not UTF-8
        return pa.array([x.decode("utf-8", "replace") for x in found.to_pylist()], pa.string())


def decode(rows: DataFrame, model_file: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids."""
    small_batches(rows.sparkSession)
    held = Carried(rows, (decoded.lower(),))
    at = held.columns.index(held[ids])
    # behind the pieces' bytes those of a null id
    shared = rows.sparkSession.sparkContext.broadcast([*Vocabulary.load(model_file).texts, b""])
    schema = T.StructType([*held.df.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.array(shared.value, pa.binary())
        for batch in batches:
            for first, n in spans(np.asarray(pc.list_value_length(batch.column(at)).fill_null(0)) * 8):
                some = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([*some.columns, texts_of(some.column(at), texts)], schema.names)

    return held.back(held.df.mapInArrow(run, schema), "decoded").withColumnRenamed("decoded", decoded)
