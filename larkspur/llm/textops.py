"""Words and word n-grams of whole Arrow batches of texts, as NumPy arrays over the UTF-8 bytes.

All hashes are 64-bit, stable between processes, and depend on the bytes only. Polynomials modulo 2**64 with an odd
base can be rolled by prefix sums; a finaliser mixes the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD1342543DE82EF95 | 1
#: Bytes of text that are worked on at a time; bounds the memory of a task, not what it reads.
CHUNK = 1 << 18

_bytes = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.int64).view(U) * U(2) + U(1)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U), np.ones(1, U)

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", _inverse(self.base))):
                steps = np.full(size, b, U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U))
        return self.up[:n], self.down[:n]


_of_bytes, _of_words = _Powers(_BASE), _Powers(_GRAM)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of some texts: of text i, words first[i] to first[i + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    sums: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def head_hash(self, n_bytes: int) -> np.ndarray:
        """Of the first bytes of each word."""
        end = np.minimum(self.start + n_bytes, self.end)
        return mix((self.sums[end] - self.sums[self.start]) * _of_bytes.take(len(self.data) + 1)[1][self.start], n_bytes)


def binary(column: pa.Array) -> pa.Array:
    """Any string column as large_binary, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).cast(pa.large_binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())
    return column.fill_null(b"") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a large_binary column without nulls."""
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row from, row to, bytes, offsets) of runs of whole texts; a text longer than size is a run of its own."""
    data, offsets = buffers(binary(column))
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    # what Arrow's pool keeps for later counts against the executor's memory
    pa.default_memory_pool().release_unused()


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = WHITE, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~gaps[data]
    here = inside[1:-1]
    before, after = inside[:-2].copy(), inside[2:].copy()
    cuts = offsets[1:-1]
    before[cuts[cuts < len(data)]] = False
    after[cuts[cuts > 0] - 1] = False
    start, end = np.flatnonzero(here & ~before), np.flatnonzero(here & ~after) + 1
    up, down = _of_bytes.take(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_bytes[data] * up[:-1], out=sums[1:])
    return Words(data, offsets, start, end, np.searchsorted(start, offsets), mix((sums[end] - sums[start]) * down[start]), sums)


def grams(hashes: np.ndarray, first: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k consecutive words at each place where a text has so many, and how many each text has."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    at = np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    h = mix(hashes, salt + 77) if salt else hashes
    if k <= 8:
        out = h[at].copy() if len(at) else np.zeros(0, U)
        for j in range(1, k):
            out *= U(_GRAM)
            out += h[at + j]
    else:
        up, down = _of_words.take(len(h) + 1)
        sums = np.zeros(len(h) + 1, U)
        np.cumsum(h * up[: len(h)], out=sums[1:])
        out = (sums[at + k] - sums[at]) * down[at]
    return mix(out, salt + k), n


def spans(hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """128 bits, as two columns of int64, of runs of ``size`` words from word ``first`` on."""
    up, down = _of_words.take(len(hashes) + 1)
    out = []
    for salt in (1, 2):
        sums = np.zeros(len(hashes) + 1, U)
        np.cumsum(mix(hashes, salt) * up[: len(hashes)], out=sums[1:])
        out.append(mix((sums[first + size] - sums[first]) * down[first] + size.astype(U), salt).view(np.int64))
    return out
