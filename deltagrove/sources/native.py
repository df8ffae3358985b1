"""Readers of native bytes: write-ahead log files (blocks of 32 KiB with fragments) and table files, each file in a task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytecodes import crc32c_of
from ..schema import HEADER, Corruption

#: A record is a CRC of 4 bytes, a length of 4, a type of 1, and its payload.
BLOCK, RECORD_HEADER = 32 << 10, 9
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4
ROWS = "file_num bigint, key binary, seq bigint, op tinyint, value binary, problem string"


def encode_entry(key: bytes, seq: int, op: int, value: bytes | None) -> bytes:
    v = value or b""
    return bytes([op]) + len(key).to_bytes(4, "little") + len(v).to_bytes(4, "little") + seq.to_bytes(8, "little") + key + v


def decode_entry(data: bytes, at: int = 0) -> tuple[tuple[bytes, int, int, bytes | None], int]:
    if len(data) - at < HEADER:
        raise Corruption("short entry")
    op, k, v = data[at], int.from_bytes(data[at + 1 : at + 5], "little"), int.from_bytes(data[at + 5 : at + 9], "little")
    end = at + HEADER + k + v
    if end > len(data) or op > 1:
        raise Corruption("bad entry")
    key = data[at + HEADER : at + HEADER + k]
    return (key, int.from_bytes(data[at + 9 : at + 17], "little"), op, None if op else data[at + HEADER + k : end]), end


def write_records(payloads: list[bytes]) -> bytes:
    """A log file: each payload in one record, or in fragments where it passes a block's end."""
    out = bytearray()
    for p in payloads:
        first = True
        while True:
            room = BLOCK - len(out) % BLOCK
            if room < RECORD_HEADER:
                out += b"\0" * room
                room = BLOCK
            part, p = p[: room - RECORD_HEADER], p[room - RECORD_HEADER :]
            kind = (FULL if first else LAST) if not p else (FIRST if first else MIDDLE)
            out += crc32c_of(bytes([kind]) + part).to_bytes(4, "little") + len(part).to_bytes(4, "little") + bytes([kind]) + part
            first = False
            if not p:
                break
    return bytes(out)


def read_records(data: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """Payloads, or what is wrong with one; reading goes on at the next block."""
    at, parts, broken = 0, [], False
    while at < len(data):
        room = BLOCK - at % BLOCK
        if room < RECORD_HEADER:
            at += room
            continue
        size, kind = int.from_bytes(data[at + 4 : at + 8], "little"), data[at + 8] if at + 8 < len(data) else 0
        body = data[at + RECORD_HEADER : at + RECORD_HEADER + size]
        if kind == 0 and size == 0:
            at += room
            continue
        if len(body) < size or size > room - RECORD_HEADER or kind > LAST or crc32c_of(bytes([kind]) + body) != int.from_bytes(data[at : at + 4], "little"):
            yield None, "truncated record" if len(body) < size else "bad checksum"
            parts, broken = [], True
            at += room
            continue
        at += RECORD_HEADER + size
        if kind == FULL:
            parts, broken = [], False
            yield body, None
        elif kind == FIRST:
            parts, broken = [body], False
        elif broken or not parts:
            broken = True
        else:
            parts.append(body)
            if kind == LAST:
                yield b"".join(parts), None
                parts = []
    if parts:
        yield None, "missing last fragment"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all log files below a path, with problems as rows of their own."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(path)
    return replayed(files.select(F.regexp_extract("path", r"([0-9]+)\.wal$", 1).cast("long").alias("file_num"), "content"))


def build_logs(entries: DataFrame) -> DataFrame:
    """file_num and content of log files that hold the entries (file_num, key, seq, op, value) in the order of seq; each file
    is built in one task, as a log file is bounded by rotation."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        entry = [encode_entry(k, s, o, None if v is None else v) for k, s, o, v in zip(pdf["key"], pdf["seq"], pdf["op"], pdf["value"], strict=True)]
        return pd.DataFrame({"file_num": [pdf["file_num"].iloc[0]], "content": [write_records(entry)]})

    binary = entries.select("file_num", F.col("key").cast("binary").alias("key"), "seq", F.col("op").cast("int").alias("op"), F.col("value").cast("binary").alias("value"))
    return binary.groupBy("file_num").applyInPandas(run, "file_num bigint, content binary")


def replayed(files: DataFrame) -> DataFrame:
    """The entries of log files given as file_num and content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, data in zip(pdf["file_num"], pdf["content"], strict=True):
                rows = []
                for payload, wrong in read_records(bytes(data)):
                    try:
                        entry = decode_entry(payload)[0] if payload is not None else (None, None, None, None)
                    except Corruption as e:
                        entry, wrong = (None, None, None, None), str(e)
                    rows.append((n, *entry, wrong))
                yield pd.DataFrame(rows, columns=["file_num", "key", "seq", "op", "value", "problem"]).astype({"seq": "Int64", "op": "Int8"})

    return files.mapInPandas(run, ROWS)


def recovered(entries: DataFrame, first_file: int = 0) -> DataFrame:
    """Replayed entries from a log number on; one that stands in two files counts once."""
    return entries.where((F.col("file_num") >= first_file) & F.col("problem").isNull()).dropDuplicates(["key", "seq"])
