"""Word shingles of whole Arrow batches in numpy, without a Python object per word.

Words are runs of bytes that aren't ASCII blanks, A-Z lower-cased. A word's hash is a polynomial of its
bytes modulo 2^64, taken from prefix sums over the batch; a shingle's hash mixes its words' hashes in
order. A text with fewer words than a shingle has its whole sequence as one, a text without words none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from .mph import mix
from .shared import SHINGLE

_BASE = 0x9E3779B97F4A7C15 | 1


@cache
def _byte_values() -> np.ndarray:
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += np.uint64(32)
    return mix(low + np.uint64(0x1234567))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = pow(_BASE, -1, 2**64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string column and where each row's begin; nulls have none."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each row)."""
    data, at = _bytes(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(column), np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = at[:-1][(at[:-1] < len(data)) & (np.diff(at) > 0)]
    begins[inner] = solid[inner]  # a row begins a word of its own
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = at[1:][np.diff(at) > 0] - 1
    ends[last] = solid[last]
    first, final = np.flatnonzero(begins), np.flatnonzero(ends)
    size = 1 << max(10, int(len(data)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[final + 1] - sums[first]) * down[first] + (final - first).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(first, at))


#: Bytes of text that are hashed together: few enough for their arrays to stay in a core's cache.
TOGETHER = 1 << 18


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    at = _bytes(column)[1]
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(at, at[low] + TOGETHER, side="right")) - 1)
        yield from _sets(column.slice(low, high - low), size)
        low = high


def _sets(column: pa.Array, size: int) -> list[np.ndarray]:
    words, counts = word_hashes(column)
    mixed = np.zeros(len(words), np.uint64)
    for k in range(size):
        part = words[k:]
        mixed[: len(part)] = mix(mixed[: len(part)] * np.uint64(3) + part)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(mixed[at : at + n - size + 1]))
        elif n:
            short = np.zeros(1, np.uint64)
            for w in words[at : at + n]:
                short = mix(short * np.uint64(3) + w)
            out.append(mix(short + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
