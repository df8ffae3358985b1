"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the ASCII white space of the contracts.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the cluster names none (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="deltagrove-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The rows, written to a new Parquet folder below the shared one and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/deltagrove-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, codec: str = "zstd") -> DataFrame:
    """The rows, written below the shared folder in buckets of key, so that joins by it don't deal them out again."""
    spark = df.sparkSession
    name = f"deltagrove_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).option("path", f"{shared_dir(spark).rstrip('/')}/{name}").option("compression", codec).format("parquet").saveAsTable(name)
    return spark.table(name)


def spread_join(rows: DataFrame, small: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """rows with the columns of small, which has one row a key (and a parts-fold copy of it is no burden). A key's rows are
    spread over parts by a hash of the whole row, so that a hot key isn't one task's, and small needs no broadcast."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def lean() -> None:
    """Gives freed memory of this worker back, so that what one task held doesn't stay beside the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def map_arrow(df: DataFrame, batch: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield batch(b)

    return df.mapInArrow(run, schema)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
