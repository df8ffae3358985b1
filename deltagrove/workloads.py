"""Generated keys, values and operations, on executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def key_of(n: Column, prefix: str = "key") -> Column:
    """prefix and 16 digits; not cut, so keys stay different."""
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), 16, "0"))


def value_of(size: int = 100) -> Column:
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.lit((letters * (size // 26 + 1))[:size])


def fill_sequential(spark: SparkSession, n: int, size: int = 100) -> DataFrame:
    return spark.range(n).select(key_of(F.col("id")).alias("key"), (F.col("id") + 1).alias("seq"), F.lit(0).cast("tinyint").alias("op"), value_of(size).alias("value"))


def _place(n: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(n))


def fill_random(spark: SparkSession, n: int, seed: int = 1, size: int = 100) -> DataFrame:
    return spark.range(n).select(key_of(_place(n, seed)).alias("key"), (F.col("id") + 1).alias("seq"), F.lit(0).cast("tinyint").alias("op"), value_of(size).alias("value"))


def read_keys(spark: SparkSession, n: int, space: int, seed: int = 2, sequential: bool = False) -> DataFrame:
    at = F.pmod("id", F.lit(space)) if sequential else _place(space, seed)
    return spark.range(n).select(F.col("id").alias("pos"), key_of(at).alias("key"))


def mixed(spark: SparkSession, n: int, space: int, reads: int = 80, seed: int = 3) -> DataFrame:
    """Commands of which `reads` in 100 are gets, the others sets."""
    get = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id")), F.lit(100)) < reads
    null = F.lit(None)
    return spark.range(n).select(key_of(_place(space, seed)).alias("key"), F.col("id").alias("ord"), F.when(get, "get").otherwise("set").alias("name"), F.when(~get, F.col("id").cast("string")).alias("data"), null.cast("bigint").alias("flags"), null.cast("decimal(20,0)").alias("delta"), null.cast("decimal(20,0)").alias("cas"))


def ranges(spark: SparkSession, n: int, space: int, width: int = 100, seed: int = 4) -> DataFrame:
    """Scans of so many neighbouring keys each."""
    at = _place(space, seed)
    return spark.range(n).select(F.col("id").alias("range_id"), key_of(at).alias("start"), key_of(at + width).alias("end"))


def deletes(spark: SparkSession, n: int, space: int, base: int, seed: int = 5) -> DataFrame:
    return spark.range(n).select(key_of(_place(space, seed)).alias("key"), (F.col("id") + 1 + base).alias("seq"), F.lit(1).cast("tinyint").alias("op"), F.lit(None).cast("string").alias("value"))
