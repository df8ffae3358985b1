"""Native manifests: version edits as tagged fields, in checked records, and their rows for the fold of the catalog."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bytecodes import crc32c_of
from ..schema import Corruption
from .native import FIRST, FULL, LAST, MIDDLE, RECORD_HEADER

#: Fixed values of the format: the tags of fields, and the most bytes of a fragment.
COMPARATOR, LOG_NUMBER, NEXT_FILE, LAST_SEQ, DELETED, ADDED = 1, 2, 3, 4, 6, 7
FRAGMENT = 32 << 10
NUMBERS = {LOG_NUMBER: "log_number", NEXT_FILE: "next_file", LAST_SEQ: "last_seq"}


@dataclass
class Edit:
    """deleted: (level, file_num); added: (level, file_num, size, min_key, max_key, min_seq, max_seq, num_keys)."""

    comparator: str | None = None
    log_number: int | None = None
    next_file: int | None = None
    last_seq: int | None = None
    deleted: list[tuple[int, int]] = field(default_factory=list)
    added: list[tuple] = field(default_factory=list)

    def to_bytes(self) -> bytes:
        u = lambda n, size=8: n.to_bytes(size, "little")
        text = lambda b: u(len(b), 4) + b
        out = bytearray()
        if self.comparator is not None:
            out += bytes([COMPARATOR]) + text(self.comparator.encode())
        for tag, name in NUMBERS.items():
            if (n := getattr(self, name)) is not None:
                out += bytes([tag]) + u(n)
        for level, n in self.deleted:
            out += bytes([DELETED]) + u(level, 4) + u(n)
        for level, n, size, low, high, *rest in self.added:
            out += bytes([ADDED]) + u(level, 4) + u(n) + u(size) + text(low) + text(high) + b"".join(map(u, rest))
        return bytes(out)

    @classmethod
    def of(cls, data: bytes) -> Edit:
        at, out = 0, cls()

        def take(n: int) -> bytes:
            nonlocal at
            if at + n > len(data):
                raise Corruption("short edit")
            at += n
            return data[at - n : at]

        number = lambda n=8: int.from_bytes(take(n), "little")
        text = lambda: take(number(4))
        while at < len(data):
            tag = take(1)[0]
            if tag == COMPARATOR:
                out.comparator = text().decode()
            elif tag in NUMBERS:
                setattr(out, NUMBERS[tag], number())
            elif tag == DELETED:
                out.deleted.append((number(4), number()))
            elif tag == ADDED:
                out.added.append((number(4), number(), number(), text(), text(), number(), number(), number()))
            else:
                raise Corruption(f"unknown tag {tag}")
        return out


def write_manifest(edits: list[Edit]) -> bytes:
    out = bytearray()
    for e in edits:
        data = e.to_bytes()
        parts = [data[i : i + FRAGMENT] for i in range(0, len(data), FRAGMENT)] or [b""]
        for i, part in enumerate(parts):
            kind = FULL if len(parts) == 1 else FIRST if i == 0 else LAST if i == len(parts) - 1 else MIDDLE
            out += crc32c_of(bytes([kind]) + part).to_bytes(4, "little") + len(part).to_bytes(4, "little") + bytes([kind]) + part
    return bytes(out)


def read_manifest(data: bytes) -> Iterator[Edit]:
    """The edits in order; a damaged record ends in Corruption, since no later edit can be trusted without it."""
    at, held = 0, None
    while at < len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        kind, part = data[at + 8 : at + 9], data[at + RECORD_HEADER : at + RECORD_HEADER + size]
        if len(part) < size or not kind or crc32c_of(kind + part) != int.from_bytes(data[at : at + 4], "little"):
            raise Corruption("damaged manifest record")
        at += RECORD_HEADER + size
        if kind[0] in (FULL, FIRST) and held is None:
            held = part
        elif kind[0] in (MIDDLE, LAST) and held is not None:
            held += part
        else:
            raise Corruption("fragment out of order")
        if kind[0] in (FULL, LAST):
            yield Edit.of(held)
            held = None
    if held is not None:
        raise Corruption("missing last fragment")


EDITS = "edit_id long, level int, file_num long, added boolean, size long, min_key binary, max_key binary, min_seq long, max_seq long, num_keys long, next_file long, last_seq long, log_number long"


def edit_rows(manifests: DataFrame) -> DataFrame:
    """manifests: content (a manifest is one small file). A row for each file that an edit adds or removes, and one (without a
    file) for its counters: what fold_edits and counters take."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in EDITS.split(", ")]
        for pdf in batches:
            rows = []
            for data in pdf["content"]:
                for i, e in enumerate(read_manifest(bytes(data)), 1):
                    rows.append((i, *(None,) * 9, e.next_file, e.last_seq, e.log_number))
                    rows += [(i, level, n, False, *(None,) * 9) for level, n in e.deleted]
                    rows += [(i, level, n, True, *rest, *(None,) * 3) for level, n, *rest in e.added]
            whole = {f.split()[0]: "Int64" for f in EDITS.split(", ") if f.split()[1] in ("long", "int")}
            yield pd.DataFrame(rows, columns=names).astype({**whole, "added": "boolean"})

    return manifests.select(F.col("content")).mapInPandas(run, EDITS)
