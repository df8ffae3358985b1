"""The change log and the tables around it: schemas, limits and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG = "key binary, seq bigint, op tinyint, value binary"
FILES = "file_num bigint, level int, size bigint, min_key binary, max_key binary, min_seq bigint, max_seq bigint, num_keys bigint, created_at timestamp"
SNAPSHOTS = "id bigint, seq bigint, released boolean"
PUT, DELETE = 0, 1
MAX_KEY, MAX_VALUE = 65_536, 268_435_456
#: Bytes of an entry's header: type, key length, value length, sequence number.
HEADER = 17
PROTOCOL_KEY = r"^[^\x00-\x20\x7f]{1,250}$"
MAX_PROTOCOL_VALUE = 1 << 20


class StoreError(Exception):
    """Base of all errors of a store."""


class InvalidKey(StoreError):
    pass


class InvalidValue(StoreError):
    pass


class SnapshotReleased(StoreError):
    pass


class WriteStalled(StoreError):
    pass


class Corruption(StoreError):
    pass


class JobRunning(StoreError):
    pass


def entry_size(key: Column, value: Column) -> Column:
    return (F.lit(HEADER) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def problem(key: Column, value: Column) -> Column:
    """Why an entry can't be written; null if it can."""
    return (
        F.when(key.isNull() | (F.octet_length(key) == 0), "empty key")
        .when(F.octet_length(key) > MAX_KEY, "key too large")
        .when(F.octet_length(value) > MAX_VALUE, "value too large")
    )


def op_name(op: Column) -> Column:
    return F.when(op == PUT, "PUT").when(op == DELETE, "DELETE").otherwise(F.format_string("UNKNOWN(%d)", op))
