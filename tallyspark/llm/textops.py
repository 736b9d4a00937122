"""Vectorised helpers over Arrow text batches, shared by the llm operators.

A batch of texts is looked at as one UTF-8 buffer. Words are maximal runs of
bytes other than 0x20 and 0x09-0x0D; they never cross a text. Hashes are 64-bit
and depend only on the bytes, never on the batch, so they can be shuffled.
Nulls are treated as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_RAW = _rng.integers(0, 2**64, 256, np.uint64)
_FOLDED = _RAW[LOWER]
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base (or its inverse) modulo 2**64."""
    key = "inv" if inverse else "fwd"
    if key not in _powers or len(_powers[key]) < n:
        size = max(n, 1 << 19)
        p = np.full(size, _M_INV if inverse else _M, np.uint64)
        p[0] = 1
        _powers[key] = np.multiply.accumulate(p)
    return _powers[key][:n]


def release_memory() -> None:
    """Give back what this process no longer uses; Python workers live on between tasks, and an executor holds several."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Chunk:
    """Consecutive texts of a batch: rows first..first+n, their bytes and n+1 offsets."""

    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1


def chunks(column: pa.Array, limit: int = 1 << 18) -> Iterator[Chunk]:
    """Cut a string column into chunks of at most `limit` bytes, or of one longer text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield Chunk(first, last - first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last
    release_memory()


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes that stand for the given values."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=total[1:])
    return mix((total[end] - total[start]) * powers(len(values) + 1, True)[start] + (end - start).astype(np.uint64))


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of the bytes as they are."""
    return span_hashes(_RAW[data], start, end)


@dataclass
class Words:
    """Words of a chunk: byte spans, the text each is in, its 64-bit hash; word_offsets: first word of each text."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    word_offsets: np.ndarray


def words(chunk: Chunk, fold: bool = True, space: np.ndarray = SPACE) -> Words:
    """Find and hash words, runs of bytes not marked in space; with fold, A-Z hash as a-z."""
    data, off = chunk.data, chunk.offsets
    solid = ~space[data]
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edge = off[:-1][off[:-1] < len(data)]
    starts[edge] = solid[edge]
    edge = off[1:][off[1:] > 0] - 1
    ends[edge] = solid[edge]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    h = span_hashes((_FOLDED if fold else _RAW)[data], start, end)
    word_offsets = np.searchsorted(start, off)
    return Words(start, end, np.repeat(np.arange(chunk.n), np.diff(word_offsets)), h, word_offsets)


_K = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, hash) of each run of n words inside one text."""
    size = len(w.hash) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(size, np.uint64)
    for i in range(n):
        h = mix(h + w.hash[i : i + size] * _K[i % len(_K)])
    first = np.flatnonzero(w.text[:size] == w.text[n - 1 :])
    return first, h[first]


def shingles(w: Words, n_texts: int, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles as (text, hash), sorted by both; a text of 1..n-1 words has its whole sequence as one."""
    first, h = ngrams(w, n)
    text = w.text[first]
    counts = np.diff(w.word_offsets)
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        if len(short):
            x = np.full(len(short), size, np.uint64)
            for i in range(size):
                x = mix(x + w.hash[w.word_offsets[short] + i] * _K[i])
            text, h = np.concatenate([text, short]), np.concatenate([h, x])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return text[new], h[new]


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as Spark's long, bit by bit."""
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(np.uint64)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length at the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def list_column(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow list array from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
