"""Consecutive numbers by an order, without one task that sorts everything."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a narrow order up to which one task may number them.
FEW = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the session names, or, only where it names none, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="deltagrove-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def numbered(rows: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """rows with the place of each by order. Beyond FEW rows they are dealt out by range, cut by a checkpoint so that ranges
    stay as they are, counted a range, and numbered within their range."""
    spark = rows.sparkSession
    if rows.limit(FEW + 1).count() <= FEW:
        return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)) + (start - 1))
    shared_folder(spark)
    dealt = rows.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy("_pid").count().orderBy("_pid").collect()  # a row for each partition
    bases, total = {}, start - 1
    for pid, n in counts:
        bases[pid] = total
        total += n
    base = F.element_at(F.create_map(*(F.lit(x) for kv in bases.items() for x in kv)), F.col("_pid"))
    return dealt.withColumn(name, F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) + base).drop("_pid")
