"""Vectorised views of text batches: words, shingles and stripped lines as numpy arrays.

Everything works on the UTF-8 bytes of an Arrow batch. White space is the ASCII
white space ``[\\x20\\x09-\\x0D]`` and only A-Z are lower-cased, so that no
character of several bytes is ever touched.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library, without malloc_trim
    _LIBC = None
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Texts are taken in slices of about so many bytes, or one longer text. What needs many bytes for each byte of text goes in pieces.
SLICE_BYTES = PIECE = 1 << 20
#: Bytes are hashed so many at a time, which stay in the cache.
HASHED = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two rounds of xor-shift and multiply)."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA0761D6478BD642F)
    x ^= x >> U64(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def give_back() -> None:
    """Return freed memory to the system: workers live on, and idle ones would keep what their largest batch took."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def lean(f: Callable) -> Callable:
    """``f``, after which all that it held, but its result, goes back to the system: inside of ``f`` that can't be had."""

    def called(*args):
        out = f(*args)
        give_back()
        return out

    return called


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``limit`` bytes together; a longer text is a range of its own."""
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + limit, side="right")) - 1)
        yield at, to
        at = to
    if len(texts) and int(ends[-1]) - int(ends[0]) >= limit // 2:
        give_back()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (no nulls) and the offsets at which texts begin and end."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _mixed(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    x = place.view(U64) * U64(0xE7037ED1A0B428DB)
    x += _BYTE.take(data)
    x ^= x >> U64(31)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(30)
    return x


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the disjoint, ascending, non-empty spans of ``data``.

    Works on about HASHED bytes at a time, however long a span is.
    """
    sums = np.zeros(len(begin), U64)
    i = 0
    while i < len(begin):
        low = int(begin[i])
        j = max(i + 1, int(np.searchsorted(end, low + HASHED, side="right")))
        if j == i + 1:
            for at in range(low, int(end[i]), HASHED):
                to = min(at + HASHED, int(end[i]))
                sums[i : i + 1] += _mixed(data[at:to], np.arange(at - low, to - low)).sum(dtype=U64)
        else:
            part = data[low : int(end[j - 1])]
            first = begin[i:j] - low
            where = np.zeros(len(part), dtype=np.int64)
            where[first] = first
            np.maximum.accumulate(where, out=where)
            edges = np.empty(2 * (j - i), dtype=np.int64)
            edges[::2], edges[1::2] = first, end[i:j] - low
            sums[i:j] = np.add.reduceat(np.append(_mixed(part, np.arange(len(part)) - where), U64(0)), edges)[::2]
        i = j
    return mix(sums + (end - begin).astype(U64))


def counts_in(marks: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many of ``marks`` (booleans) are set in each of the ascending spans, without sums over all bytes."""
    if not len(begin):
        return np.zeros(0, np.int64)
    edges = np.empty(2 * len(begin), dtype=np.int64)
    edges[::2], edges[1::2] = begin, end
    found = np.add.reduceat(np.append(marks, False).view(np.uint8), edges, dtype=np.int64)[::2]
    return np.where(end > begin, found, 0)


@dataclass
class Words:
    data: np.ndarray  # bytes, A-Z lower-cased
    begin: np.ndarray
    end: np.ndarray
    of_text: np.ndarray  # words of text i: of_text[i] up to of_text[i + 1]

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.begin, self.end)


def words(texts: pa.Array, lower: bool = True) -> Words:
    data, offsets = raw(texts)
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data) + 1, dtype=bool)  # a space or a text's edge stands before or behind
    before[0] = True
    before[1:] = space
    before |= edge
    behind = np.append(space[1:], True) | edge[1:]
    begin = np.flatnonzero(~space & before[:-1])
    end = np.flatnonzero(~space & behind) + 1
    return Words(_LOWER[data] if lower else data, begin, end, np.searchsorted(begin, offsets))


def shingles(hashes: np.ndarray, of_text: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, their texts' offsets, and each run's first word.

    A text with fewer words, but some, has its whole sequence as its one run.
    """
    n = np.diff(of_text)
    runs = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    offsets = np.concatenate(([0], np.cumsum(runs)))
    first = np.arange(offsets[-1]) + np.repeat(of_text[:-1] - offsets[:-1], runs)
    rounds = max(size, 5)  # a run's hash depends on its own words alone, however long others may be
    padded = np.concatenate((hashes, np.zeros(rounds, U64)))
    length = np.repeat(np.minimum(n, size), runs)
    out = length.astype(U64) * U64(0x8EBC6AF09C88C6E3)
    for j in range(rounds):
        out = (out ^ (out >> U64(32))) * U64(0xD6E8FEB86659FD93) + np.where(length > j, padded[first + j], U64(0))
    return mix(out), offsets, first


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order, and their offsets."""
    values = values.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = values[1:] != values[:-1]
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return values[keep], kept[offsets]


@dataclass
class Lines:
    begin: np.ndarray  # of the raw lines, between line feeds
    end: np.ndarray
    of_text: np.ndarray
    key_begin: np.ndarray  # stripped
    key_end: np.ndarray
    chars: np.ndarray  # code points of the stripped line
    data: np.ndarray  # bytes, A-Z lower-cased


def lines(texts: pa.Array) -> Lines:
    """Lines of every text; an empty text has one empty line."""
    data, offsets = raw(texts)
    feeds = np.flatnonzero(data == 10)
    n = len(texts)
    per = np.diff(np.searchsorted(feeds, offsets)) + 1
    of_text = np.concatenate(([0], np.cumsum(per)))
    begin = np.empty(of_text[-1], dtype=np.int64)
    first = np.zeros(of_text[-1], dtype=bool)
    first[of_text[:-1]] = True
    begin[first] = offsets[:-1]
    begin[~first] = feeds + 1
    end = np.empty_like(begin)
    last = np.zeros(of_text[-1], dtype=bool)
    if n:
        last[of_text[1:] - 1] = True
    end[last] = offsets[1:]
    end[~last] = feeds
    # A line's key goes from its first word to its last one: words never hold a line feed.
    w = words(texts)
    lo, hi = np.searchsorted(w.begin, begin), np.searchsorted(w.begin, end)
    some = hi > lo
    key_begin, key_end = begin.copy(), begin.copy()
    key_begin[some], key_end[some] = w.begin[lo[some]], w.end[hi[some] - 1]
    return Lines(begin, end, of_text, key_begin, key_end, counts_in((data & 0xC0) != 0x80, key_begin, key_end), w.data)


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
