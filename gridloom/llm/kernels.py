"""Byte kernels in numpy, over many texts at once: words, word hashes, shingle hashes, rolling hashes.

Texts come as Arrow string columns; nothing here makes a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in blocks of about so many bytes (a longer text is a block of its own), which bounds memory.
BLOCK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240229))
_SYMBOLS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LOWER_SYMBOLS = _SYMBOLS[_FOLD]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2 ** 64."""
    t = _powers.get(base)
    if t is None or len(t) < n:
        size = 1 << max(16, (n - 1).bit_length())
        t = np.full(size, base, np.uint64)
        t[0] = 1
        np.multiply.accumulate(t, out=t)
        if size <= 4 * BLOCK_BYTES:
            _powers[base] = t
    return t[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a string column: (first row, bytes, offsets of its texts in these bytes and the end). Nulls are empty texts."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + BLOCK_BYTES, "right")) - 1)
        b = min(b, n)
        yield a, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words between blanks; none crosses texts."""
    full = ~_BLANK[data]
    begin = full.copy()
    begin[1:] &= ~full[:-1]
    heads = off[:-1][off[:-1] < off[1:]]  # texts that aren't empty: a word may start right where the text before ends
    begin[heads] = full[heads]
    starts = np.flatnonzero(begin)
    last = full.copy()
    last[:-1] &= ~full[1:]
    tails = off[1:][off[:-1] < off[1:]] - 1
    last[tails] = full[tails]
    # a word has one start and one last byte, so they are in the same order
    return starts, np.flatnonzero(last) + 1, np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(starts, off)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z lower-cased)."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER_SYMBOLS if lower else _SYMBOLS)[data] * _table(_BASE, n), out=total[1:])
    back = _table(pow(_BASE, -1, 1 << 64), n)
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def grams(words: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles within each text, and their text numbers. Texts of fewer words give all words as one."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    count = np.diff(np.r_[edge, n])
    out = np.zeros(n, np.uint64)
    left = np.repeat(edge + count, count) - np.arange(n)  # words from here to the end of the text
    for j in range(k):
        m = max(0, n - j)
        out[:m] += np.where(left[:m] > j, words[j:] * _MIX[j], np.uint64(0))
    first = np.zeros(n, bool)
    first[edge] = True
    keep = (left >= k) | first
    short = np.minimum(left, k).astype(np.uint64)
    return mix(out + short)[keep], text[keep]


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a string column, by block: (first row, distinct shingle hashes sorted within each text, bounds of the texts in them)."""
    for first, data, off in blocks(column):
        starts, ends, text = word_spans(data, off)
        h, t = grams(word_hashes(data, starts, ends), text, k)
        order = np.lexsort((h, t))
        h, t = h[order], t[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        h, t = h[keep], t[keep]
        yield first, h, np.searchsorted(t, np.arange(len(off)))
