"""The table of snapshots: id, seq, released."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def created(snapshots: DataFrame, seq: int) -> DataFrame:
    """snapshots with a new one at seq; ids go up from 1."""
    next_id = snapshots.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
    return snapshots.unionByName(snapshots.sparkSession.createDataFrame([(next_id, seq, False)], snapshots.schema))


def released(snapshots: DataFrame, snapshot_id: int) -> DataFrame:
    """Releasing one twice does nothing."""
    return snapshots.withColumn("released", F.col("released") | (F.col("id") == snapshot_id))


def state(snapshots: DataFrame, current: int) -> DataFrame:
    """active, oldest_seq (the current one when none is active) and the active ids."""
    live = ~F.col("released")
    return snapshots.agg(
        F.count_if(live).alias("active"),
        F.coalesce(F.min(F.when(live, F.col("seq"))), F.lit(current)).cast("long").alias("oldest_seq"),
        F.array_join(F.array_sort(F.collect_list(F.when(live, F.col("id")))), ",").alias("ids"),
    )
