"""Words of many texts at once: numpy passes over the bytes of an Arrow column.

A word is a run of bytes other than space and 0x09-0x0D. Different words are numbered
exactly; each has a 64-bit XXH3 hash, so that of m different words about m**2 / 2**65 pairs
collide, whatever their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """P**0 .. P**(n-1) modulo 2**64 at least: weights of places."""
    global _powers
    while len(_powers) < n:
        step = np.uint64(pow(_BASE, len(_powers), 2**64))
        _powers = np.concatenate([_powers, _powers * step])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads each bit over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    data: np.ndarray  # the bytes, lower-cased if asked for
    begin: np.ndarray  # byte places where words begin
    end: np.ndarray  # and end (exclusive)
    first: np.ndarray  # for each text the index of its first word, and the number of all words
    hash: np.ndarray  # 64-bit hash of each word


def split(data: np.ndarray, starts: np.ndarray, lower: bool = False) -> Words:
    n = len(data)
    if lower:
        data = _LOWER[data]
    word = ~_SPACE[data]
    prev = np.zeros(n, bool)
    prev[1:] = word[:-1]
    prev[starts[:-1][starts[:-1] < n]] = False
    begin = np.flatnonzero(word & ~prev)
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    cut = starts[1:]
    after[cut[cut > 0] - 1] = False
    end = np.flatnonzero(word & ~after) + 1
    first = np.searchsorted(begin, starts)
    if not len(begin):
        return Words(data, begin, end, first, np.zeros(0, np.uint64))
    at = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=at[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(data[word])]).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    return Words(data, begin, end, first, hashes[words.indices.to_numpy()])
