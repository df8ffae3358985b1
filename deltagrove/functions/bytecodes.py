"""Byte-exact codecs that the JVM has no function for, as Arrow-batched pandas functions: CRC-32C and Bloom filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType


def _crc_table() -> np.ndarray:
    """CRC-32C (Castagnoli), from its reversed polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    return t


_TABLE = _crc_table()
_CRC = _TABLE.tolist()


def crc32c_of(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def crc32c_many(parts: list[bytes]) -> np.ndarray:
    """All parts at once, a byte of each a step; what is left of the few longest goes on byte by byte."""
    size = np.array([len(p) for p in parts], np.int64)
    order = np.argsort(-size, kind="stable")
    data = np.frombuffer(b"".join(parts[i] for i in order), np.uint8)
    size = size[order]
    start = np.cumsum(size) - size
    c = np.full(len(parts), 0xFFFFFFFF, np.uint32)
    at, few = 0, 16
    alive = len(parts) - np.searchsorted(size[::-1], np.arange(int(size[0]) if len(size) else 0), side="right")  # parts longer than each step
    while at < len(alive) and alive[at] > few:
        n = int(alive[at])
        c[:n] = _TABLE[(c[:n] ^ data[start[:n] + at]) & 0xFF] ^ (c[:n] >> np.uint32(8))
        at += 1
    for i in range(int(alive[at]) if at < len(alive) else 0):
        x = int(c[i])
        for b in data[start[i] + at : start[i] + size[i]].tobytes():
            x = _CRC[(x ^ b) & 0xFF] ^ (x >> 8)
        c[i] = x
    out = np.empty(len(parts), np.int64)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


@F.pandas_udf(LongType())
def crc32c(data: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(data), dtype="Int64")
    there = data.notna().to_numpy()
    out[there] = crc32c_many([bytes(x) for x in data[there]])
    return out


#: Fixed values of the filter's hash.
BLOOM_SEED, BLOOM_MULTIPLIER = 0xBC9F1D34, 0xC6A4A793
_LOW = 0xFFFFFFFF


def bloom_hash(key: bytes) -> int:
    """A 32-bit Murmur-like hash: four bytes at a time, little endian, and the rest."""
    h = (BLOOM_SEED ^ len(key) * BLOOM_MULTIPLIER) & _LOW
    whole = len(key) // 4 * 4
    for i in range(0, whole, 4):
        h = (h + int.from_bytes(key[i : i + 4], "little")) * BLOOM_MULTIPLIER & _LOW
        h ^= h >> 16
    if rest := key[whole:]:
        h = (h + int.from_bytes(rest, "little")) * BLOOM_MULTIPLIER & _LOW
        h ^= h >> 24
    return h


def bloom_hashes(keys: list[bytes]) -> np.ndarray:
    """bloom_hash of many keys: those of one length together, four bytes of each a step."""
    out = np.zeros(len(keys), np.uint64)
    size = np.array([len(k) for k in keys], np.int64)
    low, times = np.uint64(_LOW), np.uint64(BLOOM_MULTIPLIER)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        data = np.frombuffer(b"".join(keys[i] for i in rows), np.uint8).reshape(len(rows), n).astype(np.uint64)
        h = np.full(len(rows), (BLOOM_SEED ^ n * BLOOM_MULTIPLIER) & _LOW, np.uint64)
        for i in range(0, n, 4):
            part = data[:, i : i + 4]
            word = (part << (np.arange(part.shape[1], dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64)
            h = (h + word) * times & low
            h ^= h >> np.uint64(16 if part.shape[1] == 4 else 24)
        out[rows] = h
    return out


def bloom_size(n: int, per_key: int) -> tuple[int, int]:
    """Bits and hash functions."""
    bits = -(-max(n * per_key, 64) // 8) * 8
    return bits, max(1, min(30, (bits // n if n else 0) * 69 // 100))


def _places(key: bytes, bits: int, k: int):
    h = bloom_hash(key)
    step = (h >> 17 | h << 15) & _LOW
    for _ in range(k):
        yield h % bits
        h = (h + step) & _LOW


def bloom_build(keys: list[bytes], per_key: int = 10) -> bytes:
    bits, k = bloom_size(len(keys), per_key)
    h = bloom_hashes(keys)
    step = (h >> np.uint64(17) | h << np.uint64(15)) & np.uint64(_LOW)
    out = np.zeros(bits, bool)
    for _ in range(k):
        out[(h % np.uint64(bits)).astype(np.int64)] = True
        h = (h + step) & np.uint64(_LOW)
    return np.packbits(out, bitorder="little").tobytes() + bytes([k])


def bloom_may_contain(data: bytes, key: bytes) -> bool:
    if len(data) < 2:
        return False
    bits, k = 8 * (len(data) - 1), data[-1]
    return k > 30 or all(data[p // 8] >> p % 8 & 1 for p in _places(key, bits, k))


@F.pandas_udf(BooleanType())
def may_contain(data: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([bloom_may_contain(d, k) for d, k in zip(data, key, strict=True)])


def bloom_filters(rows, group: str, key: str, per_key: int = 10):
    """A filter of the keys of each group (a file): bounded by the file's size."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({group: [pdf[group].iloc[0]], "keys": [len(pdf)], "filter": [bloom_build([k if isinstance(k, bytes) else k.encode() for k in pdf[key]], per_key)]})

    kind = rows.schema[group].dataType.simpleString()
    return rows.select(group, key).distinct().groupBy(group).applyInPandas(build, f"`{group}` {kind}, keys long, filter binary")
