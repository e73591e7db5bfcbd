"""Whole-text work on Arrow batches in numpy: bytes, words, hashes and shingles.

Every function looks at the UTF-8 buffer that Arrow holds already, so no Python
object is made for a row or a word. A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes worked on at once; bounds the memory of a Python worker.
PIECE_BYTES = 2 << 20
SHINGLE_WORDS = 5

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEED = 20240613

#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Blank bytes: space and \x09 to \x0D.
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def _series(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; grown by doubling and kept."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, dtype=np.uint64)
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


def series(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of an odd number modulo 2 ** 64, or of its inverse."""
    return _series(_INVERSE if inverse else _BASE, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows back to back, and n + 1 offsets into them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Prefix:
    """Prefix sums that give a 64-bit hash of any byte range at once.

    Long ranges of a special form can collide (sums of powers modulo 2 ** 64), so a
    caller may only use it to bring ranges together that are compared afterwards.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _series(_BASE, n), out=self.sums[1:])
        self.inverse = _series(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start])


#: Words up to so many bytes are hashed eight bytes at a time for all words at once; longer ones each on its own.
SHORT_BYTES = 64


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, without the structure that sums of powers leave.

    Every eight bytes are mixed into the state by a bijection, so ranges of one length that
    differ in their last eight bytes alone never collide, and others as 64 random bits would.
    """
    size = end - start
    out = mix64(size.astype(np.uint64) + np.uint64(_BASE))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    some = np.flatnonzero((size > 0) & (size <= SHORT_BYTES))
    for at in range(0, SHORT_BYTES, 8):
        some = some[size[some] > at]
        if not len(some):
            break
        rest = np.minimum(size[some] - at, 8).astype(np.uint64)
        chunk = eight[start[some] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest))
        out[some] = mix64((out[some] ^ chunk) * np.uint64(_BASE) + np.uint64(at + 1))
    for i in np.flatnonzero(size > SHORT_BYTES):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), _SEED)
    return out


@dataclass
class Words:
    """Words of several texts; `first[d]` is the index of text d's first word."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """Runs of non-blank bytes, cut at text borders, with a hash for each."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~BLANK[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | border))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | border))
    hashed = hash_ranges(LOWER[data] if lower else data, start, end) if n else np.empty(0, np.uint64)
    return Words(np.searchsorted(start, offsets), start, end, hashed)


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k consecutive words of one text, and the index of its first word."""
    n = len(w.hash)
    if n < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total += w.hash[j : n - k + 1 + j] * np.uint64(pow(_BASE, 2 * j + 3, 1 << 64))
    keep = np.ones(n - k + 1, bool)
    for back in range(1, k):
        cut = w.first[1:-1] - back
        keep[cut[(cut >= 0) & (cut <= n - k)]] = False
    at = np.flatnonzero(keep)
    return mix64(total[at]), at


def shingle_sets(w: Words, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, back to back, with n + 1 offsets.

    A text of fewer than k words has its whole word sequence as one shingle; one
    without words has an empty set.
    """
    hashed, at = grams(w, k)
    first = np.searchsorted(at, w.first)
    counts = w.counts()
    short = np.flatnonzero((counts > 0) & (counts < k))
    out: list[np.ndarray] = []
    sizes = np.zeros(len(counts), np.int64)
    single = dict.fromkeys(short.tolist())
    for d in single:
        seq = w.hash[w.first[d] : w.first[d + 1]]
        weights = np.array([pow(_BASE, 2 * j + 3, 1 << 64) for j in range(len(seq))], np.uint64)
        single[d] = mix64(np.array([(seq * weights).sum() + np.uint64(len(seq))], np.uint64))
    for d in range(len(counts)):
        part = single[d] if d in single else np.unique(hashed[first[d] : first[d + 1]])
        out.append(part)
        sizes[d] = len(part)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def give_back() -> None:
    """Returns memory that this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; after each, and at the end, freed memory goes back to the system.

    Python workers outlive their tasks, and what one has freed would still count for the executor.
    """
    for batch in batches:
        yield batch
        del batch
        give_back()
    give_back()


def key_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The same rows, cut so that rows of one key, which come together, stay in one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[-1])
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
        if cut:
            held.append(batch.slice(0, cut))
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
