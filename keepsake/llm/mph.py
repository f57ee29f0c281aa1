"""Minimal perfect hashing of 128-bit keys in numpy, by cascaded bit maps.

Level after level, each key left takes the bit at its hash; keys alone on their bit are done, the
others go on. A key's number is the rank of its bit, so n keys get the numbers 0 .. n - 1. A function
says nothing about keys outside its set: whoever looks up must compare what the slot holds.
"""

from __future__ import annotations

import numpy as np

GAMMA, LEVELS = 1.5, 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    seed = np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) % 2**64)
    return mix(keys[:, 0] ^ mix(keys[:, 1] + seed)) % np.uint64(bits)


def as_keys(x: np.ndarray) -> np.ndarray:
    """Keys from 64-bit integers."""
    return np.stack([np.asarray(x).astype(np.int64).view(np.uint64), np.zeros(len(x), np.uint64)], axis=1)


def build(keys: np.ndarray) -> bytes:
    """keys: distinct, of shape (n, 2), uint64. ValueError if two are equal."""
    sizes, maps, left = [], [], keys
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("equal keys")
        bits = -(-int(GAMMA * len(left) + 64) // 64) * 64
        at = _places(left, len(sizes), bits)
        count = np.bincount(at.astype(np.int64), minlength=bits)
        sizes.append(bits)
        maps.append(np.packbits(count == 1, bitorder="little").view(np.uint64))
        left = left[count[at.astype(np.int64)] > 1]
    return np.array([len(sizes), *sizes], np.uint64).tobytes() + b"".join(m.tobytes() for m in maps)


class Lookup:
    def __init__(self, data: bytes):
        head = np.frombuffer(data, np.uint64, 1)[0]
        self.sizes = [int(x) for x in np.frombuffer(data, np.uint64, int(head), 8)]
        self.words = np.frombuffer(data, np.uint64, -1, 8 * (int(head) + 1))
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys; -1 where a key surely isn't in the set."""
        out, todo, first = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, bits in enumerate(self.sizes):
            at = _places(keys[todo], level, bits)
            word, bit = first + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            there = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[there]] & ((np.uint64(1) << bit[there]) - np.uint64(1))
            out[todo[there]] = self.before[word[there]] + np.bitwise_count(below)
            todo, first = todo[~there], first + bits // 64
        return out
