"""The file catalog, what compaction keeps, and the leveled, tiered and FIFO choices of files.

Files: file_num, level, size, min_key, max_key, min_seq, max_seq, num_keys[, created_at].
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PUT, entry_size

LEVELS = 7


def file_catalog(log: DataFrame, rows_per_file: int = 1000) -> DataFrame:
    """A log whose seq goes up from 1, cut into level-0 files of so many sequence numbers."""
    n = F.floor((F.col("seq") - 1) / rows_per_file).cast("long") + 1
    return log.groupBy(n.alias("file_num")).agg(
        F.lit(0).alias("level"),
        F.sum(entry_size(F.col("key"), F.col("value"))).cast("long").alias("size"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
        F.count("*").alias("num_keys"),
    )


def files_for_keys(files: DataFrame, keys: DataFrame, cells: int = 128) -> DataFrame:
    """The files whose closed range holds each key. The key space is cut into at most so many cells at files' least keys; keys
    and files meet by an equi-join on cells, so neither side is broadcast by need nor all pairs formed. A file is there once
    for each cell it reaches: files of a level are disjoint, and level 0 is bounded by its stop limit."""
    parts = files.select("min_key").repartitionByRange(cells, "min_key").groupBy(F.spark_partition_id()).agg(F.min("min_key").alias("b"))
    bounds = sorted(r.b for r in parts.collect())  # at most `cells`
    if not bounds:
        return keys.join(files, F.lit(False))
    cuts = F.array(*(F.lit(b) for b in bounds))
    cell = lambda c: F.size(F.filter(cuts, lambda b: b <= c))
    dealt = files.withColumn("_cell", F.explode(F.sequence(cell(F.col("min_key")), cell(F.col("max_key")))))
    return keys.withColumn("_cell", cell(F.col("key"))).join(dealt, "_cell").where((F.col("key") >= F.col("min_key")) & (F.col("key") <= F.col("max_key"))).drop("_cell")


def files_overlapping(files: DataFrame, low, high) -> DataFrame:
    return files.where((F.col("max_key") >= F.lit(low)) & (F.col("min_key") <= F.lit(high)))


def retained(log: DataFrame, snapshots: list[int], bottom: bool = False) -> DataFrame:
    """The versions that now or an active snapshot can see. bottom: nothing lies below, so tombstones that no older
    snapshot needs go too."""
    w = Window.partitionBy("key").orderBy(F.desc("seq"), F.desc("op"))
    newer = F.lag("seq").over(w)
    rows = log.withColumn("_newer", newer)
    seen = F.col("_newer").isNull()
    for s in sorted(set(snapshots)):
        seen = seen | ((F.col("seq") <= s) & (F.col("_newer") > s))
    out = rows.where(seen)
    if bottom:
        floor = min(snapshots) if snapshots else None
        old = F.lit(True) if floor is None else F.col("seq") <= floor
        out = out.where((F.col("op") == PUT) | ~old)
    return out.drop("_newer")


def compact(log: DataFrame, snapshots: list[int], path: str, bottom: bool = False, rows_per_file: int = 1_000_000) -> DataFrame:
    """Rewrites a log as files of disjoint key ranges, each sorted, and gives it back."""
    kept = retained(log, snapshots, bottom)
    kept.repartitionByRange("key").sortWithinPartitions("key", F.desc("seq")).write.option("maxRecordsPerFile", rows_per_file).option("parquet.bloom.filter.enabled#key", "true").parquet(path)
    return log.sparkSession.read.schema(log.schema).parquet(path)


def output_files(log: DataFrame, target: int) -> DataFrame:
    """Where a compaction splits its sorted output: a file closes once target bytes (key, value and 20 an entry) are in it.
    Files of one key range each; a range's files are numbered by the bytes before."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 20
    w = Window.partitionBy("part").orderBy("key", F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    rows = log.withColumn("_size", size).withColumn("_before", F.coalesce(F.sum("_size").over(w), F.lit(0)))
    return rows.groupBy("part", F.floor(F.col("_before") / target).cast("long").alias("file")).agg(F.sum("_size").cast("long").alias("size"), F.count("*").alias("entries"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def level_target(level, base: int = 64 << 20, ratio: int = 10):
    return F.when(level == 0, F.lit(0)).otherwise(F.lit(base) * F.pow(F.lit(ratio), level - 1)).cast("long")


def level_stats(files: DataFrame, trigger: int = 4, base: int = 64 << 20, ratio: int = 10) -> DataFrame:
    """Each level's files, size, target and score (level 0: files to trigger; others: size to target)."""
    spark = files.sparkSession
    have = files.groupBy("level").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    levels = spark.range(LEVELS).select(F.col("id").cast("int").alias("level"))
    t = level_target(F.col("level"), base, ratio)
    out = levels.join(have, "level", "left").select("level", F.coalesce("n", F.lit(0)).cast("long").alias("files"), F.coalesce("s", F.lit(0)).cast("long").alias("size"), t.alias("target"))
    score = F.when(F.col("level") == 0, F.col("files") / F.lit(float(trigger))).otherwise(F.col("size") / F.greatest("target", F.lit(1)))
    return out.withColumn("score", score.cast("double"))


@dataclass
class Leveled:
    trigger: int = 4
    stop: int = 12
    base: int = 64 << 20
    ratio: int = 10

    def pick(self, files: DataFrame) -> DataFrame:
        """The files of the next compaction, with their role (input or overlap) and target_level; none: nothing to do. Level 0
        goes first once it has `trigger` files."""
        due = F.when(F.col("level") == 0, F.col("files") >= self.trigger).otherwise(F.col("score") > 1)
        return self._task(files, due)

    def pick_by_size(self, files: DataFrame) -> DataFrame:
        """As pick, among the levels below 0 alone, whatever the number of files of level 0."""
        return self._task(files, (F.col("level") > 0) & (F.col("score") > 1))

    def _task(self, files: DataFrame, due) -> DataFrame:
        best = level_stats(files, self.trigger, self.base, self.ratio).where((F.col("level") < LEVELS - 1) & due)
        chosen = best.orderBy(F.desc((F.col("level") == 0).cast("int")), F.desc("score"), "level").limit(1).select(F.col("level").alias("_l"))
        inputs = files.join(F.broadcast(chosen), F.col("level") == F.col("_l"))  # one row
        first = F.row_number().over(Window.partitionBy("level").orderBy("min_key", "file_num"))
        inputs = inputs.withColumn("_n", first).where("level = 0 or _n = 1").drop("_n")
        span = inputs.agg(F.min("min_key").alias("_lo"), F.max("max_key").alias("_hi"), F.first("_l").alias("_at"))
        below = files.join(F.broadcast(span), (F.col("level") == F.col("_at") + 1) & (F.col("max_key") >= F.col("_lo")) & (F.col("min_key") <= F.col("_hi")))
        give = lambda df, role: df.select("file_num", "level", F.lit(role).alias("role"), (F.col("_l" if role == "input" else "_at") + 1).cast("int").alias("target_level"))
        return give(inputs, "input").unionByName(give(below, "overlap"))

    def state(self, files: DataFrame) -> DataFrame:
        """needs_compaction and stalled."""
        n = F.count_if(F.col("level") == 0)
        over = level_stats(files, self.trigger, self.base, self.ratio).where("level between 1 and 5 and size > target")
        return files.agg((n >= self.trigger).alias("_t"), (n >= self.stop).alias("stalled")).crossJoin(over.agg((F.count("*") > 0).alias("_o"))).select((F.col("_t") | F.col("_o")).alias("needs_compaction"), "stalled")


@dataclass
class Tiered:
    base: int = 4 << 20
    ratio: float = 4.0
    buckets: int = 10
    least: int = 4
    most: int = 32
    stop: int = 64

    def bucket(self, size):
        """The first bucket whose limit (base times ratio to its number) a size doesn't pass; the last takes the rest."""
        limits = [self.base * self.ratio**i for i in range(self.buckets - 1)]
        out = F.when(size <= limits[0], 0)
        for i, most in enumerate(limits[1:], 1):
            out = out.when(size <= most, i)
        return out.otherwise(self.buckets - 1)

    def stats(self, files: DataFrame) -> DataFrame:
        all_ = files.sparkSession.range(self.buckets).select(F.col("id").cast("int").alias("bucket"))
        got = files.groupBy(self.bucket(F.col("size")).alias("bucket")).agg(F.count("*").alias("files"), F.sum("size").alias("size"))
        return all_.join(got, "bucket", "left").select("bucket", F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))

    def pick(self, files: DataFrame) -> DataFrame:
        score = F.col("files") / F.lit(float(self.least)) * (self.buckets - F.col("bucket")) / F.lit(float(self.buckets))
        best = self.stats(files).where(F.col("files") >= self.least).withColumn("score", score).orderBy(F.desc("score"), "bucket").limit(1).select("bucket", "score")
        rows = files.withColumn("bucket", self.bucket(F.col("size"))).join(F.broadcast(best), "bucket")  # one row
        return rows.orderBy("size", "file_num").limit(self.most).select("file_num", "bucket", "size", "score")

    def state(self, files: DataFrame) -> DataFrame:
        return self.stats(files).agg((F.max("files") >= self.least).alias("needs_compaction"), (F.sum("files") >= self.stop).alias("stalled"))


@dataclass
class Fifo:
    most_bytes: int = 640 << 20
    ttl_seconds: int = 0
    per_cycle: int = 10
    stop: int = 100

    def expired(self, files: DataFrame, now) -> DataFrame:
        """The oldest files past their time."""
        late = files.where(F.col("created_at") < now - F.make_interval(secs=F.lit(self.ttl_seconds))) if self.ttl_seconds else files.limit(0)
        return late.orderBy("file_num").limit(self.per_cycle)

    def excess(self, files: DataFrame) -> DataFrame:
        """The oldest files until what is above most_bytes is covered. Sizes are summed over the catalog, a row a file."""
        before = F.coalesce(F.sum("size").over(Window.orderBy("file_num").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        total = F.sum("size").over(Window.partitionBy())
        out = files.withColumn("freed_before", before.cast("long")).withColumn("_over", total - self.most_bytes)
        return out.where(F.col("freed_before") < F.col("_over")).orderBy("file_num").limit(self.per_cycle).select("file_num", "size", "freed_before")

    def state(self, files: DataFrame, now=None) -> DataFrame:
        """Compaction is due by size, and with a time to live (now given, files with created_at) by age; writes stall at
        `stop` files."""
        total = F.coalesce(F.sum("size"), F.lit(0))
        due = total > self.most_bytes
        if self.ttl_seconds and now is not None:
            due = due | (F.coalesce(F.min("created_at") < now - F.make_interval(secs=F.lit(self.ttl_seconds)), F.lit(False)))
        return files.agg(F.count("*").alias("files"), total.cast("long").alias("size"), due.alias("needs_compaction"), (F.count("*") >= self.stop).alias("stalled"), F.min("file_num").alias("oldest"), F.max("file_num").alias("newest"))


def fold_edits(edits: DataFrame) -> DataFrame:
    """edits: edit_id, file_num, level, added. The live files: of each file the last edit, if it added it; within an edit an
    addition goes after a removal."""
    w = Window.partitionBy("level", "file_num").orderBy(F.desc("edit_id"), F.desc("added"))
    return edits.withColumn("_n", F.row_number().over(w)).where("_n = 1 and added").select("file_num", "level")


def counters(edits: DataFrame) -> DataFrame:
    return edits.agg(*(F.max(c).alias(c) for c in ("next_file", "last_seq", "log_number")))
