"""Vectorised word hashing over Arrow text columns.

Texts stay UTF-8 bytes.  A word is a maximal run of bytes outside a delimiter
table, so splitting follows the bytes and never decodes.  Word hashes come from
prefix sums of ``byte * P**i`` modulo 2**64, which makes every word's hash a
difference of two sums: a few NumPy passes over the buffer instead of one
Python object for each word.  Work runs in slices of a few megabytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
P = 0x9E3779B97F4A7C15
P_INV = pow(P, -1, 1 << 64)

#: space and \t \n \v \f \r
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n, kept for the next call."""
    if len(_powers[0]) < n:
        for k, base in enumerate((P, P_INV)):
            grow = np.full(n, base, np.uint64)
            grow[0] = 1
            _powers[k] = np.cumprod(grow, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows become empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, wide, count=len(column) + 1, offset=column.offset * np.dtype(wide).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    row, n = 0, len(off) - 1
    while row < n:
        end = int(np.searchsorted(off, off[row] + limit, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end
        row = end


def word_spans(buf: np.ndarray, off: np.ndarray, delimiter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``buf``, and the first word of each row.

    ``off`` holds row offsets into ``buf`` starting at 0; rows never share a word.
    """
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = ~delimiter[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = off[:-1][off[:-1] < n]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = off[1:][off[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word of ``buf``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(buf)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word windows; with fewer words, of the whole sequence."""
    if not len(words):
        return words
    k = min(k, len(words))
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h = mix64(h * np.uint64(0x9FB21C651E98DF25) + words[i : len(words) - k + 1 + i] + np.uint64(i + 1))
    return h
