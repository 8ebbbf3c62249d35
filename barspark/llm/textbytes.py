"""Vectorised access to the bytes and words of a batch of texts.

A batch of texts is one array of UTF-8 bytes and an array of offsets, as Arrow stores it. Batches are cut into
slices of bounded size, so that the memory of a task follows the longest text and not the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SLICE_ROWS = 4096

#: Word separators: the space and the control characters 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: A random number for each byte.
BYTE_CODES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES, max_rows: int = SLICE_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of consecutive rows; a null text is an empty one.

    A slice has one row at least, and else at most max_bytes and max_rows.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(at, at[low] + max_bytes, "right")) - 1
        high = min(max(high, low + 1), low + max_rows, n)
        yield low, high, whole[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; words don't cross texts."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    inside = ~IS_SPACE[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts = off[:-1][off[:-1] < len(buf)]
    first[starts] = inside[starts]
    ends = off[1:][off[1:] > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial over byte codes, from prefix sums, then mixed."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = max(SLICE_BYTES, 1 << int(len(buf)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODES[buf] * up[: len(buf)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of size words inside one text, and the number of its first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += words[k : k + n] * np.uint64(pow(0xA0761D6478BD642F, k + 1, 1 << 64) | 1)
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    return mixed(h[at]), at


def shingle_sets(words: np.ndarray, text: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, joined, and their offsets.

    A text with fewer words than a shingle has its whole sequence of words as one; one without words has none.
    """
    hashes, at = window_hashes(words, text, size)
    of = text[at]
    per_text = np.bincount(text, minlength=n_texts)
    short = np.flatnonzero((per_text > 0) & (per_text < size))
    bounds = np.concatenate(([0], np.cumsum(per_text)))
    ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n_texts))))
    short_set, sets = set(short.tolist()), []
    for k in range(n_texts):
        if k in short_set:
            h = np.uint64(per_text[k])
            for w in words[bounds[k] : bounds[k + 1]]:
                h = mixed(np.array([h ^ w], np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))[0]
            sets.append(np.array([h], np.uint64))
        else:
            part = np.sort(hashes[ends[k] : ends[k + 1]])
            sets.append(part[np.concatenate((part[:1] == part[:1], part[1:] != part[:-1]))])
    off = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), off
