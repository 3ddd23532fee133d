"""Words and shingles of Arrow text columns, by NumPy over the bytes: no Python object for a word is made.

A word's hash is the polynomial of its bytes modulo 2**64, mixed; prefix sums give all words of a block at
once. Blocks are about a quarter of a megabyte, so memory does not depend on the size of an Arrow batch; a text
longer than that is a block of its own, and is taken in pieces.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes that are no ASCII letter or digit and no part of another character.
_OUTER = np.ones(256, bool)
_OUTER[128:] = _OUTER[48:58] = _OUTER[65:91] = _OUTER[97:123] = False
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _P, np.uint64), np.full(n + 1, _PINV, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n, off = len(column), column.offset
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64, n + 1, off * 8) if ends is not None and n else np.zeros(n + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, ends


def binaries(column: pa.Array) -> list[np.ndarray]:
    """The bytes of each row of a binary column, without a copy."""
    column = column.cast(pa.large_binary())
    n = len(column)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def blocks(ends: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(ends, ends[i] + size, "right")) - 1))
        yield i, j
        i = j


def word_hashes(data: np.ndarray, ends: np.ndarray, lower: bool = False, inner: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the rows that ``ends`` bounds: each word's hash, first byte and end (from the block's start), and
    for each row the index of its first word (one more entry than rows). inner: words are runs of letters, digits
    and characters beyond ASCII, not all that stands between spaces."""
    lo, rows = int(ends[0]), ends - ends[0]
    b = data[lo : int(ends[-1])]
    outer = _OUTER if inner else _SPACE
    if len(rows) > 2 or len(b) <= 2 * BLOCK:
        h, starts, stops = _hashed(b, rows, outer, lower)
    else:
        # a long text is taken in pieces that end between words, so that it needs no more memory than a block
        out, at = [], 0
        while at < len(b):
            end = at + BLOCK
            while end < len(b) and not (gap := outer[b[end : end + BLOCK]]).any():
                end += BLOCK
            end = min(len(b), end + int(gap.argmax())) if end < len(b) else len(b)
            h, x, y = _hashed(b[at:end], np.array([0, end - at]), outer, lower)
            out.append((h, x + at, y + at))
            at = end
        h, starts, stops = (np.concatenate(x) for x in zip(*out, strict=True))
    return h, starts, stops, np.searchsorted(starts, rows, "left")


def _hashed(b: np.ndarray, rows: np.ndarray, outer: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(b)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~outer[b]
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = BLOCK if n <= BLOCK else 1 << int(n - 1).bit_length()
    up, down = _powers(size)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(((_LOWER if lower else _SAME)[b].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[stops] - total[starts]) * down[starts]), starts, stops


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word runs of one row's words; with fewer words, the whole sequence as one."""
    if not len(words):
        return words
    k = min(n, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        total += words[i : len(words) - k + 1 + i] * np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64))
    return mix(total)


def find(ordered: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x stands in an ordered array, and whether it does."""
    if not len(ordered):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    maybe = np.isin((x >> np.uint64(44)).astype(np.int64), (ordered >> np.uint64(44)).astype(np.int64), kind="table") if len(x) > 1024 else np.ones(len(x), bool)
    at, few = np.zeros(len(x), np.int64), np.flatnonzero(maybe)
    at[few] = np.minimum(np.searchsorted(ordered, x[few]), len(ordered) - 1)
    return at, maybe & (ordered[at] == x)
