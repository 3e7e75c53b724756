"""Salted pseudonyms: FNV-1a (64 bits) of salt, a zero byte and the value, folded to 8 hex digits, or all 16.

Eight digits tell few values apart: of m values about m^2 / 2^33 pairs share a pseudonym (among 90,000
names some do), so joins and groups by pseudonyms want 16, where it is m^2 / 2^65.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = (8, 16)
_MASK, _PRIME = 2**64 - 1, 0x100000001B3
#: Fewer values than this are hashed one by one.
_FEW = 32


def _absorb(h: int, data: bytes) -> int:
    for b in data:
        h = ((h ^ b) * _PRIME) & _MASK
    return h


def _absorb_all(h: int, values: list[bytes]) -> np.ndarray:
    """``_absorb`` of each value, a byte of all of them at a time, the longest first."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    order = np.argsort(-sizes, kind="stable")
    text, at, sizes = np.frombuffer(b"".join(values), np.uint8), (np.cumsum(sizes) - sizes)[order], sizes[order]
    found = np.full(len(values), h, np.uint64)
    for p in range(int(sizes[0]) if len(values) else 0):
        n = int(np.searchsorted(-sizes, -p))  # so many are longer than p
        if n < _FEW:
            found[:n] = [_absorb(int(found[k]), values[order[k]][p:]) for k in range(n)]
            break
        found[:n] = (found[:n] ^ text[at[:n] + p]) * np.uint64(_PRIME)
    out = np.empty_like(found)
    out[order] = found
    return out


def _shown(h: int, digits: int) -> str:
    return f"{h:016x}" if digits == 16 else f"{(h ^ (h >> 32)) & 0xFFFFFFFF:08x}"


def pseudonym(salt: str, value: str, digits: int = 8) -> str:
    return _shown(_absorb(0xCBF29CE484222325, salt.encode() + b"\0" + value.encode()), digits)


def pseudonym_column(value: Column, salt: str, digits: int = 8) -> Column:
    """Pseudonyms of a string column, in Arrow batches; each distinct value of a batch once."""
    start = _absorb(0xCBF29CE484222325, salt.encode() + b"\0")

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values)
        hashed = pd.Series([_shown(h, digits) for h in _absorb_all(start, [v.encode() for v in distinct]).tolist()], dtype=object)
        return pd.Series(hashed.reindex(codes).to_numpy(), index=values.index).where(values.notna(), None)

    return run(value)
