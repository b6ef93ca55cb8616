"""Whole columns of texts as numpy arrays: word spans and span hashes without a Python loop over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
BLOCK_BYTES = 1 << 20
#: Longer spans are hashed one by one.
LONG_SPAN = 1024
_ODD, _EIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(8)
#: Keeps the first k bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def byte_table(inside) -> np.ndarray:
    """A table of 256 booleans from a predicate over byte values."""
    return np.fromiter((bool(inside(b)) for b in range(256)), bool, 256)


#: Characters that `[^\x20\x09-\x0D]` takes; bytes of longer UTF-8 sequences all count.
NOT_SPACE = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Characters that `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` takes, after A-Z became a-z.
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
FIRST_BYTE = byte_table(lambda b: b & 0xC0 != 0x80)
LOWER_AZ = np.fromiter((b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)), np.uint8, 256)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins (one more offset than texts). Null: empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(at: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes together; a longer text is a range of its own."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same for equal bytes wherever they stand.

    Eight bytes a round, multiplied and shifted, of the spans that go on. (A polynomial modulo a power of two would be the
    same for some regular strings whatever its base is.)
    """
    sizes = ends - starts
    hashes = sizes.astype(np.uint64) * np.uint64(BASE)
    if not len(sizes):
        return hashes
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, np.uint64, padded, 0, (1,))
    live = np.flatnonzero((sizes > 0) & (sizes <= LONG_SPAN))
    at, left, h = starts[live], sizes[live], hashes[live]
    while len(live):
        h = (h ^ (words[at] & _FIRST[np.minimum(left, 8)])) * _ODD
        h ^= h >> np.uint64(29)
        on = left > 8
        if not on.all():
            hashes[live[~on]] = h[~on]
            live, at, left, h = live[on], at[on], left[on], h[on]
        at, left = at + 8, left - 8
    long = np.flatnonzero(sizes > LONG_SPAN)
    if len(long):
        raw = data.tobytes()
        hashes[long] = [int.from_bytes(hashlib.blake2b(memoryview(raw)[a:b], digest_size=8).digest()) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return mix(hashes)


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span of each different content, and for every span which of these it equals. Exact: equal hashes are compared byte by byte."""
    _, first, own = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    sizes = ends - starts
    if (sizes == sizes[first][own]).all() and (data[gathered(starts, sizes)] == data[gathered(starts[first][own], sizes)]).all():
        return first, own
    known: dict[bytes, int] = {}
    raw = data.tobytes()
    own = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
    return np.unique(own, return_index=True)[1], own


def gathered(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of so many values from each begin on, one run after another."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def spans(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each maximal run of bytes of a table; runs end with their text."""
    flag = inside[data] if len(data) else np.zeros(0, bool)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.zeros(len(data), bool)
    before[1:] = flag[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = flag[1:]
    starts = np.flatnonzero(flag & (~before | edge[:-1]))
    ends = np.flatnonzero(flag & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def per_text(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many marked places each text has."""
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of so many values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h *= np.uint64(BASE)
        h += values[j : j + n]
    return mix(h)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys stand twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    ranked = np.sort(keys)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    found = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[found] == keys
