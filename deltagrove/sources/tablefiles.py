"""Native table files: sorted data blocks, a bloom filter, an index of blocks and a footer, each file in a task.

A data block is entries, the offsets of every 16th, their number and a CRC-32C; the filter and the index end in a CRC-32C
too; the footer holds where both are. All numbers are little endian."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytecodes import bloom_build, crc32c_many
from ..schema import Corruption
from .native import ROWS, decode_entry, encode_entry

#: Fixed values of the format.
MAGIC, VERSION, FOOTER, BLOCK_BYTES, RESTART = 0x526170696454424C, 1, 48, 4096, 16
FIELDS = ["file_num", "key", "seq", "op", "value", "problem"]


@dataclass
class Footer:
    filter_at: int
    filter_size: int
    index_at: int
    index_size: int
    version: int = VERSION

    def to_bytes(self) -> bytes:
        places = (self.filter_at, self.filter_size, self.index_at, self.index_size)
        return b"".join(_u64(n) for n in places) + _u32(self.version) + bytes(4) + _u64(MAGIC)

    @classmethod
    def of(cls, data: bytes) -> Footer:
        """The footer of a whole file."""
        tail = data[-FOOTER:]
        if len(tail) < FOOTER:
            raise Corruption("short footer")
        if tail[40:] != _u64(MAGIC):
            raise Corruption("no table file")
        at = [int.from_bytes(tail[i : i + 8], "little") for i in (0, 8, 16, 24)]
        return cls(*at, int.from_bytes(tail[32:36], "little"))


def _u32(n: int) -> bytes:
    return n.to_bytes(4, "little")


def _u64(n: int) -> bytes:
    return n.to_bytes(8, "little")


def _sealed(parts: list[bytes]) -> list[bytes]:
    return [p + _u32(int(c)) for p, c in zip(parts, crc32c_many(parts), strict=True)]


def build(entries: list[tuple[bytes, int, int, bytes | None]], per_key: int = 10) -> bytes:
    """A file of entries (key, seq, op, value), which come by key and, within it, newest first."""
    blocks: list[tuple[bytes, bytes]] = []
    body, starts, count, last = bytearray(), [0], 0, b""

    def close() -> None:
        blocks.append((last, bytes(body) + b"".join(map(_u32, starts)) + _u32(len(starts))))

    for key, seq, op, value in entries:
        e = encode_entry(key, seq, op, value)
        if body and len(body) + len(e) + 4 * (len(starts) + 3) > BLOCK_BYTES:
            close()
            body, starts, count = bytearray(), [0], 0
        if count and count % RESTART == 0:
            starts.append(len(body))
        body += e
        count, last = count + 1, key
    if body:
        close()
    sealed = _sealed([b for _, b in blocks])
    index, at = bytearray(), 0
    for (key, _), b in zip(blocks, sealed, strict=True):
        index += _u32(len(key)) + key + _u64(at) + _u64(len(b))
        at += len(b)
    filter_block, index_block = _sealed([bloom_build(sorted({e[0] for e in entries}), per_key), bytes(index)])
    footer = Footer(at, len(filter_block), at + len(filter_block), len(index_block))
    return b"".join([*sealed, filter_block, index_block, footer.to_bytes()])


def index_of(data: bytes) -> list[tuple[bytes, int, int]]:
    """Last key, offset and size of each data block."""
    f = Footer.of(data)
    block = data[f.index_at : f.index_at + f.index_size]
    if len(block) != f.index_size or len(block) < 4 or int(crc32c_many([block[:-4]])[0]) != int.from_bytes(block[-4:], "little"):
        raise Corruption("bad index block")
    out, at, end = [], 0, len(block) - 4
    while at < end:
        k = int.from_bytes(block[at : at + 4], "little")
        if at + 20 + k > end:
            raise Corruption("bad index entry")
        place = block[at + 4 + k : at + 20 + k]
        out.append((block[at + 4 : at + 4 + k], int.from_bytes(place[:8], "little"), int.from_bytes(place[8:], "little")))
        at += 20 + k
    return out


def read(data: bytes) -> Iterator[tuple[tuple | None, str | None]]:
    """The entries, or what is wrong: a bad block is one problem, and reading goes on with the next."""
    try:
        blocks = [data[at : at + size] for _, at, size in index_of(data)]
    except Corruption as e:
        yield None, str(e)
        return
    sums = crc32c_many([b[:-4] for b in blocks])
    for b, c in zip(blocks, sums, strict=True):
        if len(b) < 12 or int(c) != int.from_bytes(b[-4:], "little"):
            yield None, "bad checksum"
            continue
        end = len(b) - 8 - 4 * int.from_bytes(b[-8:-4], "little")
        at = 0
        try:
            while at < end:
                entry, at = decode_entry(b[:end], at)
                yield entry, None
        except Corruption as e:
            yield None, str(e)


def filter_of(data: bytes) -> bytes | None:
    """The bloom filter; none if it is missing or damaged, which readers pass over."""
    f = Footer.of(data)
    block = data[f.filter_at : f.filter_at + f.filter_size]
    if len(block) < 6 or int(crc32c_many([block[:-4]])[0]) != int.from_bytes(block[-4:], "little"):
        return None
    return block[:-4]


def build_tables(entries: DataFrame) -> DataFrame:
    """file_num and content of table files of the entries (file_num, key, seq, op, value); a file is built in one task, as its
    size is bounded by the compaction's target."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(older=-pdf["seq"]).sort_values(["key", "older"])
        rows = [(k, int(s), int(o), v) for k, s, o, v in zip(pdf["key"], pdf["seq"], pdf["op"], pdf["value"], strict=True)]
        return pd.DataFrame({"file_num": [pdf["file_num"].iloc[0]], "content": [build(rows)]})

    binary = entries.select("file_num", F.col("key").cast("binary").alias("key"), "seq", F.col("op").cast("int").alias("op"), F.col("value").cast("binary").alias("value"))
    return binary.groupBy("file_num").applyInPandas(run, "file_num bigint, content binary")


def table_rows(files: DataFrame, per_batch: int = 10_000) -> DataFrame:
    """The entries of table files given as file_num and content, with problems as rows of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = lambda rows: pd.DataFrame(rows, columns=FIELDS).astype({"seq": "Int64", "op": "Int8"})
        for pdf in batches:
            rows = []
            for n, data in zip(pdf["file_num"], pdf["content"], strict=True):
                for entry, wrong in read(bytes(data)):
                    rows.append((n, *(entry or (None,) * 4), wrong))
                    if len(rows) >= per_batch:
                        yield out(rows)
                        rows = []
            yield out(rows)

    return files.select("file_num", "content").mapInPandas(run, ROWS)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(path)
    return table_rows(files.select(F.regexp_extract("path", r"([0-9]+)\.sst$", 1).cast("long").alias("file_num"), "content"))
