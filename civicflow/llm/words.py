"""Words of whole Arrow text columns as numpy arrays: spans and 64-bit hashes, no Python objects.

A word is a run of bytes other than 09-0D and 20; A-Z count as a-z. Hashes chain the
eight-byte pieces of a word, starting from its length. Everything is a pure function of the bytes, so values agree between tasks, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Text bytes handled at once; a single longer text is taken whole (its arrays are in proportion to it).
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that near values get unrelated hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=64)
def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, the same everywhere."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_STEP = np.uint64(0xA0761D6478BD642F)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null texts have no bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each, at least one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row pointer): the words of row ``i`` are ``[pointer[i], pointer[i + 1])``."""
    inside = ~_SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    row_starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[row_starts] = inside[row_starts]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[row_starts[1:] - 1] |= inside[row_starts[1:] - 1]
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word."""
    return span_hashes(_LOWER[data], starts, ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: np.uint64 = _STEP) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes of every span at a time; another odd ``step`` is another hash."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    eights = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = ends - starts
    out = mix(length.astype(np.uint64))
    live, at = slice(None), 0
    while True:
        left, begin = length[live] - at, starts[live] + at
        if at:
            more = np.flatnonzero(left > 0)
            live = more if isinstance(live, slice) else live[more]
            left, begin = left[more], begin[more]
        if not len(begin):
            return out
        out[live] = mix(out[live] * step ^ (eights[begin] & _KEEP[np.minimum(left, 8)]))
        at += 8


def block_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: np.uint64, most: int = 512) -> np.ndarray:
    """``span_hashes``, but spans of more than ``most`` bytes are hashed in blocks side by side and then together."""
    number = np.maximum(1, -(-(ends - starts) // most))
    if (number == 1).all():
        return span_hashes(data, starts, ends, step)
    h = span_hashes(data, *cut_spans(starts, ends, most), step)
    first = np.cumsum(number) - number
    nth = (np.arange(len(h)) - np.repeat(first, number)).astype(np.uint64)
    return np.where(number == 1, h[first], mix(np.add.reduceat(mix(h + (nth + np.uint64(1)) * step), first)))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive words, in order."""
    if len(words) < n or n < 1:
        return np.zeros(0, np.uint64)
    weights = odd_constants(n, 1000 + n)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total += words[k:len(words) - n + 1 + k] * weights[k]
    return mix(total)


def gather_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the spans' bytes one after another."""
    length = ends - starts
    offsets = np.concatenate([[0], np.cumsum(length)])
    return data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], length)], offsets


def cut_spans(starts: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans longer than ``most`` bytes cut into parts, in order."""
    parts = np.maximum(1, -(-(ends - starts) // most))
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(starts, parts) + nth * most
    return begin, np.minimum(begin + most, np.repeat(ends, parts))
