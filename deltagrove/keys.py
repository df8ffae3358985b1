"""Keys, ranges and their predicates. Ranges are half open; a missing end has no bound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_end(prefix: bytes | None) -> bytes | None:
    """The least key after all keys with the prefix; None where there is none (empty, or all bytes 255)."""
    cut = (prefix or b"").rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def _literal(key: bytes | str) -> Column:
    return F.lit(bytearray(key)) if isinstance(key, bytes) else F.lit(key)


def in_range(key: Column, lower: bytes | str | None = None, upper: bytes | str | None = None) -> Column:
    """lower <= key < upper, as comparisons that reach the scan."""
    out = F.lit(True)
    if lower:
        out = key >= _literal(lower)
    if upper:
        out = out & (key < _literal(upper))
    return out


def with_prefix(key: Column, prefix: bytes | str) -> Column:
    """The prefix as a range, which prunes row groups, and as itself."""
    if not prefix:
        return F.lit(True)
    if isinstance(prefix, bytes):
        return in_range(key, prefix, prefix_end(prefix))
    end = prefix_end(prefix.encode())
    try:
        upper = end.decode() if end else None
    except UnicodeDecodeError:
        upper = None
    return in_range(key, prefix, upper) & F.startswith(key, F.lit(prefix))


def contains(start: Column, end: Column, key: Column) -> Column:
    return (start.isNull() | (key >= start)) & (end.isNull() | (key < end))


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return (end.isNull() | other_start.isNull() | (other_start < end)) & (other_end.isNull() | start.isNull() | (start < other_end))
