"""Vectorised word splitting and hashing of Arrow string batches.

All texts of a batch are handled as one byte buffer.  A word's hash is a sum over its
bytes of numbers that depend on the byte and its place in the word without any
structure (a polynomial modulo 2**64 would collide on Thue-Morse words, whatever its
base), so no Python object is made per word; the cost is a few nanoseconds per byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
#: Texts of a batch are processed in runs of about this many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 19

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inv = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            tables = []
            for factor in (_BASE, inv):
                row = np.full(size, factor, np.uint64)
                row[0] = 1
                tables.append(np.cumprod(row, dtype=np.uint64))
            _powers, _inverse = tables
    return _powers, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def lut(word_byte) -> np.ndarray:
    """256 booleans: which bytes belong to words."""
    return np.array([bool(word_byte(b)) for b in range(256)])


#: Bytes of words `[^\x20\x09-\x0D]+`: anything but ASCII white space.
SPACE_WORDS = lut(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: ASCII digits and letters, and all beyond ASCII.
ALNUM_WORDS = lut(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


#: Numbers of bytes at the first places of a word; later places are mixed as they come.
_PLACES = 64


def _byte_numbers() -> np.ndarray:
    return mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_NUMBERS = _byte_numbers()


def placed_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each run start:end of 64-bit values, a sum of mixed values that depends on their places in the run."""
    size = end - start
    at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else start, size) + np.arange(int(size.sum()))
    place = (at - np.repeat(start, size)).astype(np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(at) + 1, np.uint64)
        np.cumsum(mix(values[at] + (place + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)), out=sums[1:])
        stop = np.cumsum(size)
        return sums[stop] - sums[stop - size]


class Words:
    """The words of a run of texts: `start` and `end` are byte offsets in `data`, `doc` the text's number, `hash` a 64-bit hash."""

    __slots__ = ("bounds", "data", "doc", "end", "first", "hash", "offsets", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
        n = len(data)
        self.data = data = _LOWER[data]
        self.offsets = offsets
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = word_bytes[data]
        step = np.diff(inside)
        start = np.flatnonzero(step == 1)
        end = np.flatnonzero(step == -1)
        # a word ends where its text ends, too
        cuts = offsets[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        if len(cuts):
            start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
        self.start, self.end = start, end
        self.doc = np.searchsorted(offsets, start, side="right") - 1
        self.bounds = np.searchsorted(start, offsets)  # words of text i: bounds[i]..bounds[i + 1]
        size = end - start
        first = np.zeros(n, np.int64)
        first[start[1:]] = np.diff(start)
        if len(start):
            first[start[0]] = start[0]
        place = np.arange(n) - np.cumsum(first)  # in a word, the place from its beginning
        with np.errstate(over="ignore"):
            numbers = _NUMBERS[(np.minimum(place, _PLACES - 1) << 8 | data) if len(start) else np.zeros(n, np.int64)]
            for i in np.flatnonzero(size > _PLACES):
                far = np.arange(start[i] + _PLACES - 1, end[i])
                numbers[far] = mix((place[far].astype(np.uint64) << np.uint64(8) | data[far]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(7))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(numbers, out=sums[1:])
            self.hash = mix(sums[end] - sums[start] + size.astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def grams(self, n: int) -> np.ndarray:
        """Hashes of the n words from each word on; one that would pass the last word is left out of the result."""
        return combine(self.hash, n)


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hashes of every n neighbours."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(m, np.uint64(n))
        for k in range(n):
            total = total * np.uint64(_BASE) + hashes[k : k + m]
    return mix(total)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string array; nulls count as empty."""
    column = column.fill_null("") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(column: pa.Array, word_bytes: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """(first text, one past the last, their words) until the column is through."""
    data, offsets = string_buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + RUN_BYTES, side="right")) - 1)
        j = min(j, n)
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], word_bytes)
        i = j
