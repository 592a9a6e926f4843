"""Token hashes: 32-bit MurmurHash3 (x86, seed 0) in Arrow batches, and the first 32 bits of MD5 in SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF


def murmur3(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86_32 of bytes."""
    rotate = lambda x, r: ((x << r) | (x >> (32 - r))) & _MASK
    scramble = lambda k: rotate(k * 0xCC9E2D51 & _MASK, 15) * 0x1B873593 & _MASK
    h, whole = seed, len(data) & ~3
    for k in np.frombuffer(data[:whole], "<u4").tolist():
        h = (rotate(h ^ scramble(k), 13) * 5 + 0xE6546B64) & _MASK
    if len(data) > whole:
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & _MASK
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & _MASK
    return h ^ (h >> 16)


_known: dict[str, int] = {}


def murmur3_of(tokens: pa.Array) -> np.ndarray:
    """Hashes of a string array; each distinct token is hashed once, recent ones not again."""
    coded = tokens.dictionary_encode()
    if len(_known) > 1_000_000:
        _known.clear()
    values = []
    for token in coded.dictionary.to_pylist():
        if token not in _known:
            _known[token] = murmur3(token.encode("utf-8", "surrogatepass"))
        values.append(_known[token])
    return np.array(values, np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(tokens) else np.zeros(0, np.int64)


def md5_32(token: Column) -> Column:
    """The first 32 bits of a token's MD5, as a BIGINT."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long")
