"""Reads of the change log (key, seq, op, value): visible versions, snapshots, merges and their differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..keys import in_range, with_prefix
from ..schema import DELETE, PUT


def newest(log: DataFrame, *order: Column) -> DataFrame:
    """The newest version of each key, tombstones included. Spark keeps one row a key below the shuffle (WindowGroupLimit)."""
    by = order or (F.desc("seq"), F.desc("op"))
    return log.withColumn("_rank", F.row_number().over(Window.partitionBy("key").orderBy(*by))).where("_rank = 1").drop("_rank")


def as_of(log: DataFrame, seq: int | None = None, tombstones: bool = False) -> DataFrame:
    """What a reader at seq sees (None: now; 0: the empty log)."""
    rows = newest(log if seq is None else log.where(F.col("seq") <= seq))
    return rows if tombstones else rows.where(F.col("op") == PUT)


latest = as_of


def snapshot_filter(log: DataFrame, seq: int, tombstones: bool = False) -> DataFrame:
    """All versions up to seq, without folding them."""
    rows = log.where(F.col("seq") <= seq)
    return rows if tombstones else rows.where(F.col("op") == PUT)


def get(log: DataFrame, key, seq: int | None = None) -> DataFrame:
    return as_of(log.where(F.col("key") == F.lit(key)), seq)


def multi_get(log: DataFrame, keys: DataFrame, seq: int | None = None, ordered: bool = True) -> DataFrame:
    """keys: pos, key. The hits, ordered in the order asked. Only the log's rows of those keys are folded; the semi-join, the
    fold and the join share one dealing by key, and only ordered adds a sort."""
    asked = (log if seq is None else log.where(F.col("seq") <= seq)).join(keys.select("key"), "key", "left_semi")
    out = keys.join(as_of(asked), "key")
    return out.orderBy("pos") if ordered else out


def _range(log: DataFrame, lower, upper, prefix) -> DataFrame:
    key = F.col("key")
    return log.where(with_prefix(key, prefix) if prefix else in_range(key, lower, upper))


def scan(log: DataFrame, lower=None, upper=None, prefix=None, seq: int | None = None, tombstones: bool = False) -> DataFrame:
    """Live keys of a range; a prefix goes before bounds. The range is applied below the fold."""
    return as_of(_range(log, lower, upper, prefix), seq, tombstones)


def scan_versions(log: DataFrame, lower=None, upper=None, prefix=None, tombstones: bool = False) -> DataFrame:
    """All versions of a range's keys, without folding them."""
    rows = _range(log, lower, upper, prefix)
    return rows if tombstones else rows.where(F.col("op") == PUT)


def seek(view: DataFrame, target) -> DataFrame:
    return view.where(F.col("key") >= F.lit(target)).orderBy("key").limit(1)


def seek_for_prev(view: DataFrame, target) -> DataFrame:
    return view.where(F.col("key") <= F.lit(target)).orderBy(F.desc("key")).limit(1)


def page(view: DataFrame, after, size: int, reverse: bool = False) -> DataFrame:
    """The next rows after a key, in either direction; a top-k, not a sort of everything."""
    if after is not None:
        view = view.where(F.col("key") < F.lit(after) if reverse else F.col("key") > F.lit(after))
    return view.orderBy(F.desc("key") if reverse else F.asc("key")).limit(size)


def merge_sources(sources: list[DataFrame], seq: int | None = None, tombstones: bool = False) -> DataFrame:
    """Sources (logs, with more columns or fewer) as one view."""
    return as_of(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources), seq, tombstones)


def table_merge(files: DataFrame) -> DataFrame:
    """files: log rows with level and file_num. Of equal sequence numbers the lower level wins, then the later file."""
    return newest(files, F.desc("seq"), F.asc("level"), F.desc("file_num")).where(F.col("op") == PUT)


def version_neighbours(log: DataFrame) -> DataFrame:
    w = Window.partitionBy("key").orderBy("seq")
    return log.select("key", "seq", F.lag("seq").over(w).alias("prev_seq"), F.lead("seq").over(w).alias("next_seq"))


def snapshot_diff(log: DataFrame, old: int, new: int) -> DataFrame:
    """Keys whose value differs between two snapshots. One pass: both versions come from one fold of the log."""
    rows = log.where(F.col("seq") <= max(old, new))
    at = lambda s: F.max(F.when(F.col("seq") <= s, F.struct("seq", "op", "value")))
    both = rows.groupBy("key").agg(at(old).alias("o"), at(new).alias("n"))
    live = lambda c: F.when(F.col(f"{c}.op") == PUT, F.col(f"{c}.value"))
    had, has = F.coalesce(F.col("o.op") == PUT, F.lit(False)), F.coalesce(F.col("n.op") == PUT, F.lit(False))
    change = F.when(~had & has, "added").when(had & ~has, "removed").when(had & has & (~live("o").eqNullSafe(live("n"))), "changed")
    return both.select("key", live("o").alias("old_value"), live("n").alias("new_value"), change.alias("change")).where(change.isNotNull())


def append(log: DataFrame, rows: DataFrame, order: str, base: int | None = None) -> DataFrame:
    """Rows (key, op, value and an order) after the log, with consecutive sequence numbers by that order."""
    from .sequence import numbered

    if base is None:
        base = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    new = numbered(rows, [F.col(order)], "_n").withColumn("seq", (F.col("_n") + base).cast("long"))
    return log.unionByName(new.select(*(F.col(c).cast(log.schema[c].dataType).alias(c) for c in log.columns)))


def range_tombstones(log: DataFrame, lower, upper) -> DataFrame:
    """A tombstone for each live key of a range, to append; order: the key."""
    null = F.lit(None).cast(log.schema["value"].dataType)
    return scan(log, lower, upper).select("key", F.lit(DELETE).cast("tinyint").alias("op"), null.alias("value"))
