"""Blocks of documents, and an exchange of keys between all blocks.

Scans that need numpy over many texts at once work on blocks: some documents, their texts end to end and compressed, in one
row. A block is written once, below the cluster's shared folder, bucketed by its number, so what the shards answer meets
the texts again without a second shuffle of the texts. A key is a 64-bit hash; a block sends each shard its keys of a range,
sorted and as differences, and gets an answer for each key in the same order.

A null text counts as empty. A null doc_id is carried as the least long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, lean

NULL_ID = -(1 << 63)
#: Bytes of text to a block (a longer text has its own), and bytes of text to a shard.
BLOCK_BYTES, SHARD_BYTES = 3 << 20, 8 << 20
_ID = "__id_of_this_row__"
BLOCK_SCHEMA = "block long, n_bytes long, ids binary, lens binary, data binary, rest binary"


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data) if data else b""


def _ipc(parts: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema) as out:
        for p in parts:
            out.write_batch(p)
    return squeeze(sink.getvalue().to_pybytes())


def pack_blocks(docs: DataFrame, keep: bool) -> DataFrame:
    """keep: the columns but the text go along, as rows of an Arrow stream."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        ids, texts, size, rest = [], [], 0, []

        def row():
            nonlocal made
            out = [part << 32 | made], [size], [np.array(ids, np.int64).tobytes()], [np.array([len(t) for t in texts], np.int64).tobytes()], [squeeze(b"".join(texts), 3)], [_ipc(rest) if keep else None]
            made += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], ["block", "n_bytes", "ids", "lens", "data", "rest"])

        for b in batches:
            other = b.select([c for c in b.schema.names if c not in (_ID, "text")])
            since = 0
            for k, (i, t) in enumerate(zip(b.column(_ID).to_pylist(), b.column("text").cast(pa.large_binary()).to_pylist(), strict=True)):
                t = t or b""
                if ids and size + len(t) > BLOCK_BYTES:
                    rest.append(other.slice(since, k - since))
                    yield row()
                    ids, texts, size, rest, since = [], [], 0, [], k
                ids.append(NULL_ID if i is None else i)
                texts.append(t)
                size += len(t)
            rest.append(other.slice(since))
        if ids:
            yield row()

    cols = [c for c in docs.columns if c != "text"] if keep else []
    return docs.select(F.col("doc_id").cast("long").alias(_ID), "text", *cols).mapInArrow(run, BLOCK_SCHEMA)


def rest_of(row: dict) -> pa.Table:
    return pa.ipc.open_stream(expand(row["rest"])).read_all()


class Blocks:
    """The written blocks of a table of documents."""

    def __init__(self, docs: DataFrame, keep: bool = False) -> None:
        self.table = bucketed(pack_blocks(docs, keep), "block", "uncompressed")
        self.n_bytes = self.table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
        #: Enough shards that one fits a task; enough bits that two keys are seldom the same by chance.
        self.shard_bits = max(6, (self.n_bytes // SHARD_BYTES).bit_length())
        self.key_bits = min(64, max(32, self.n_bytes.bit_length() + 8))

    def with_answers(self, answers: DataFrame) -> DataFrame:
        """The blocks and what the shards answered, as a list in `answers`."""
        per = answers.groupBy("block").agg(F.collect_list(F.struct(*(c for c in answers.columns if c != "block"))).alias("answers"))
        return self.table.join(per, "block", "left")


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Ids, text starts (one more than texts) and the texts end to end."""
    lens = np.frombuffer(row["lens"], np.int64)
    return np.frombuffer(row["ids"], np.int64), np.concatenate([[0], np.cumsum(lens)]), expand(row["data"])


def rows_of(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]
    lean()


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs; the first byte says how many."""
    v = values.astype("<u8")
    w = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    return bytes([w]) + np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :w]).tobytes()


def widen(data: bytes) -> np.ndarray:
    w = data[0]
    out = np.zeros(((len(data) - 1) // w, 8), np.uint8)
    out[:, :w] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, w)
    return out.view("<u8").ravel()


def shard_slices(keys: np.ndarray, key_bits: int, shard_bits: int):
    """(shard, from, to) of the ranges of sorted keys that go to each shard."""
    edges = np.searchsorted(keys, np.arange(1 << shard_bits, dtype=np.uint64) << np.uint64(key_bits - shard_bits))
    ends = np.append(edges[1:], len(keys))
    for s in np.flatnonzero(ends > edges):
        yield int(s), int(edges[s]), int(ends[s])


def deltas(keys: np.ndarray) -> bytes:
    return narrow(np.diff(keys, prepend=keys[:1])) + int(keys[0]).to_bytes(8, "little") if len(keys) else b""


def undeltas(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    return np.cumsum(widen(data[:-8]), dtype=np.uint64) + np.uint64(int.from_bytes(data[-8:], "little"))


def _byte_values() -> np.ndarray:
    """A random value for each byte; letters A-Z have those of a-z."""
    v = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    v[65:91] = v[97:123]
    return v


FOLDED = _byte_values()
EXACT = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def span_hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, values: np.ndarray = FOLDED) -> np.ndarray:
    """A polynomial hash of each span of raw; spans go by their begins, in pieces, so that powers take bounded memory."""
    out = np.empty(len(begins), np.uint64)
    step, lo = 1 << 20, 0
    while lo < len(begins):
        hi = max(lo + 1, int(np.searchsorted(begins, begins[lo] + step)))
        at, end = int(begins[lo]), int(ends[lo:hi].max())
        h = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[raw[at:end]] * powers(_BASE, end - at), dtype=np.uint64)])
        b = begins[lo:hi] - at
        out[lo:hi] = (h[ends[lo:hi] - at] - h[b]) * powers(_INVERSE, end - at)[b]
        lo = hi
    return out


COUNTED = "block long, shard int, more binary, square long, sum long"


def count_keys(table: pa.Table) -> pa.Table:
    """Of a shard's keys and of how many more documents than one each block has them: of how many more each is in all, at
    most 65,535 (compressed); and the sums that give the mean length of a key's list."""
    keys = [undeltas(k) for k in table.column("keys").to_pylist()]
    more = [widen(m) for m in table.column("more").to_pylist()]
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(more) + np.uint64(1)).astype(np.int64)
    got = np.minimum(total[place] - 1, 65_535)
    parts = np.split(got, np.cumsum([len(k) for k in keys])[:-1])
    long = np.minimum(total[total > 1], 256)
    rest = [0] * (len(parts) - 1)
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "more": pa.array([squeeze(narrow(p)) for p in parts], pa.binary()), "square": pa.array([int((long**2).sum()), *rest], pa.int64()), "sum": pa.array([int(long.sum()), *rest], pa.int64())})
