"""Scalar functions on columns: codecs, hashes, names and formats, all on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_U64 = "decimal(20,0)"
_TWO64 = 1 << 64


def fixed_le(n: Column, width: int) -> Column:
    """An unsigned number as width little-endian bytes."""
    digits = F.lpad(F.hex(n.cast("long")), 2 * width, "0")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(width - 1), F.lit(0), F.lit(-1)), lambda i: F.substring(digits, 2 * i + 1, F.lit(2))), ""))


def from_fixed_le(b: Column) -> Column:
    """Little-endian bytes as a number (up to 8 bytes, below 2^63)."""
    digits = F.array_join(F.transform(F.sequence(F.octet_length(b), F.lit(1), F.lit(-1)), lambda i: F.hex(F.substring(b, i, F.lit(1)))), "")
    return F.conv(digits, 16, 10).cast("long")


def uvarint_len(n: Column) -> Column:
    """Bytes of a number from 0 as a base-128 varint."""
    return F.when(n == 0, 1).otherwise(F.ceil(F.length(F.bin(n)) / 7)).cast("int")


def uvarint(n: Column) -> Column:
    """A number from 0 as a varint: seven bits a byte, low first, the high bit set on all but the last."""
    count = uvarint_len(n)
    byte = lambda i: F.shiftright(n, (i * 7).cast("int")).bitwiseAND(F.lit(127)) + F.when(i < count - 1, 128).otherwise(0)
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), ""))


def encode_entry(op: Column, key: Column, value: Column, seq: Column) -> Column:
    """type(1) key length(4) value length(4) seq(8), little endian, then key and value."""
    v = F.coalesce(value, F.lit(bytearray()))
    return F.concat(fixed_le(op, 1), fixed_le(F.octet_length(key), 4), fixed_le(F.octet_length(v), 4), fixed_le(seq, 8), key, v)


def decode_entry(b: Column) -> Column:
    part = lambda at, n: F.substring(b, at, n)
    k, v = from_fixed_le(part(F.lit(2), F.lit(4))).cast("int"), from_fixed_le(part(F.lit(6), F.lit(4))).cast("int")
    op = from_fixed_le(part(F.lit(1), F.lit(1)))
    value = F.when(op == 0, part(F.lit(18) + k, v))
    return F.struct(op.cast("tinyint").alias("op"), part(F.lit(18), k).alias("key"), value.alias("value"), from_fixed_le(part(F.lit(10), F.lit(8))).alias("seq"))


def fnv1a(text: Column) -> Column:
    """FNV-1a, 64 bits, over the bytes of a text, as decimal digits: the token of compare-and-swap."""
    data = text.cast("binary")
    size = F.octet_length(data)
    step = lambda h, i: _xor_low(h, F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int"))
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit("14695981039346656037").cast(_U64), step).cast("string")


def _xor_low(h: Column, byte: Column) -> Column:
    low = (h % F.lit(256)).cast("int")
    mixed = (h - low + low.bitwiseXOR(byte)).cast(_U64)
    # h * (2^40 + 0x1b3) mod 2^64, in parts that stay below 38 digits
    high = (mixed % F.lit(1 << 24).cast(_U64)).cast("decimal(18,0)") * F.lit(1 << 40).cast("decimal(19,0)")
    small = mixed * F.lit(0x1B3).cast("decimal(5,0)")
    return ((high.cast("decimal(38,0)") + small.cast("decimal(38,0)")) % F.lit(str(_TWO64)).cast("decimal(38,0)")).cast(_U64)


def human_bytes(n: Column) -> Column:
    out = F.when(n < 1024, F.format_string("%d B", n))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        scaled = F.format_string(f"%.1f {unit}", n / F.lit(float(1 << (10 * i))))
        out = out.when(n < 1 << (10 * (i + 1)), scaled) if i < 4 else out.otherwise(scaled)
    return out


def file_type(name: Column) -> Column:
    return (
        F.when(name == "CURRENT", "current")
        .when(name.rlike(r"^MANIFEST-[0-9]{6,}$"), "manifest")
        .when(name.rlike(r"^[0-9]{6,}\.sst$"), "table")
        .when(name.rlike(r"^[0-9]+\.wal$"), "log")
        .otherwise("unknown")
    )


def file_number(name: Column) -> Column:
    return F.when(file_type(name).isin("manifest", "table", "log"), F.regexp_extract(name, r"([0-9]+)", 1).cast("long"))


def table_name(n: Column) -> Column:
    return F.format_string("%06d.sst", n)


def manifest_name(n: Column) -> Column:
    return F.format_string("MANIFEST-%06d", n)


def log_name(n: Column) -> Column:
    return F.format_string("%d.wal", n)


def request_id(prefix: Column, counter: Column, ts: Column) -> Column:
    """prefix, the counter as 8 hex digits at least, and the low 32 bits of the milliseconds as 8 hex digits."""
    padded = lambda n: F.lpad(F.lower(F.hex(n)), F.greatest(F.lit(8), F.length(F.hex(n))), F.lit("0"))
    return F.concat_ws("-", prefix, padded(counter.cast("long")), padded(F.unix_millis(ts.cast("timestamp")).bitwiseAND(F.lit(0xFFFFFFFF))))


def metric_number(x: Column) -> Column:
    """Whole numbers without decimals; NaN and infinities by name."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "+Inf").when(x == float("-inf"), "-Inf").when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))


def level_name(text: Column) -> Column:
    """A log level by name in any case; warning is warn; anything else is info."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("debug", "info", "warn", "error", "fatal"), t).when(t == "warning", "warn").otherwise("info")


def bloom_bits(n: Column, per_key: int) -> Column:
    return (F.ceil(F.greatest(n * per_key, F.lit(64)) / 8) * 8).cast("long")


def bloom_hashes(n: Column, per_key: int) -> Column:
    per = F.when(n > 0, F.floor(bloom_bits(n, per_key) / F.greatest(n, F.lit(1)))).otherwise(0)
    return F.greatest(F.lit(1), F.least(F.lit(30), F.floor(per * 69 / 100))).cast("int")


def bloom_false_positives(n: Column, per_key: int) -> Column:
    """(hashes * keys / bits) ^ hashes; 1 where the ratio is above 1."""
    k = bloom_hashes(n, per_key)
    r = k * n / bloom_bits(n, per_key)
    return F.when((n <= 0) | (r > 1), F.lit(1.0)).otherwise(F.pow(r, k))
