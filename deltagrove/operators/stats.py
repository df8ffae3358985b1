"""Counters, gauges, histograms, latency summaries, health: aggregations with partial sums below the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import metric_number

SEVERITY = ("healthy", "degraded", "unhealthy")


def counter_vec(rows: DataFrame, labels: list[str], value: str | None = None) -> DataFrame:
    return rows.groupBy(*labels).agg((F.count("*") if value is None else F.sum(value)).alias("value"))


def gauge_vec(rows: DataFrame, labels: list[str], value: str, *order: str) -> DataFrame:
    """The last value by an order."""
    return rows.groupBy(*labels).agg(F.max_by(value, F.struct(*order)).alias("value"))


def gauge_moves(rows: DataFrame, labels: list[str], *order: str) -> DataFrame:
    """rows: move (set, inc, dec, add), amount, and an order. The value after all moves: the last set, and the sum of what
    follows it; inc and dec count 1 where amount is null. One aggregation finds the last set, one sums behind it."""
    at = F.struct(*order)
    last = rows.where("move = 'set'").groupBy(*labels).agg(F.max(F.struct(at.alias("at"), F.col("amount").cast("double").alias("value"))).alias("_set"))
    by = F.coalesce(F.col("amount").cast("double"), F.lit(1.0))
    step = F.when(F.col("move") == "dec", -by).when(F.col("move").isin("inc", "add"), by).otherwise(0.0)
    after = F.col("_set").isNull() | (at > F.col("_set.at"))
    moved = rows.withColumn("_step", step).join(last, labels, "left") if labels else rows.withColumn("_step", step).crossJoin(last.select("_set"))  # one row
    return moved.groupBy(*labels).agg((F.coalesce(F.max("_set.value"), F.lit(0.0)) + F.coalesce(F.sum(F.when(after, F.col("_step"))), F.lit(0.0))).alias("value"))


#: What the engine tells of itself: name (after the prefix) and kind.
ENGINE_METRICS = (
    ("writes_total", "counter"),
    ("reads_total", "counter"),
    ("deletes_total", "counter"),
    ("write_latency_seconds", "histogram"),
    ("read_latency_seconds", "histogram"),
    ("delete_latency_seconds", "histogram"),
    ("memtable_size_bytes", "gauge"),
    ("sstable_count", "gauge"),
    ("sstable_size_bytes", "gauge"),
    ("wal_size_bytes", "gauge"),
    ("disk_usage_bytes", "gauge"),
    ("compaction_duration_seconds", "histogram"),
    ("compactions_total", "counter"),
    ("compaction_bytes_total", "counter"),
    ("bloom_filter_hits_total", "counter"),
    ("bloom_filter_misses_total", "counter"),
    ("active_connections", "gauge"),
    ("connections_total", "counter"),
    ("rate_limited_total", "counter"),
    ("cache_hits_total", "counter"),
    ("cache_misses_total", "counter"),
    ("tasks_count", "gauge"),
    ("heap_alloc_bytes", "gauge"),
    ("heap_sys_bytes", "gauge"),
    ("gc_pause_seconds_total", "gauge"),
    ("info", "gauge"),
)
LATENCY_BOUNDS = [0.00001, 0.00005, 0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0]


def engine_metrics(measured: DataFrame, prefix: str = "deltagrove_") -> DataFrame:
    """measured: metric, labels (map), amount, ord; rows of observations. Samples (name, labels, value) of the whole set, ready for
    exposition: counters add up, gauges keep the last, histograms give their buckets, sum and count. A metric without
    observations is 0; observations of unknown metrics are left out. The set is broadcast: it is fixed and small."""
    spark = measured.sparkSession
    known = spark.createDataFrame(list(ENGINE_METRICS), "metric string, kind string")
    pairs = F.array_sort(F.map_entries(F.coalesce("labels", F.create_map().cast("map<string,string>"))))
    rows = measured.select("metric", pairs.alias("labels"), F.col("amount").cast("double").alias("amount"), "ord").join(F.broadcast(known), "metric")
    counts = [F.count_if(F.col("amount") <= b).alias(f"_b{i}") for i, b in enumerate(LATENCY_BOUNDS)]
    g = rows.groupBy("metric", "kind", "labels").agg(F.sum("amount").alias("sum"), F.count("amount").alias("n"), F.max_by("amount", "ord").alias("last"), *counts)
    g = known.join(g, ["metric", "kind"], "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<struct<key:string,value:string>>")))
    le = lambda b: F.concat(F.col("labels"), F.array(F.struct(F.lit("le").alias("key"), F.lit(b).alias("value"))))
    sample = lambda suffix, labels, value: F.struct(F.concat(F.lit(prefix), "metric", F.lit(suffix)).alias("name"), F.map_from_entries(labels).alias("labels"), F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"))
    own = F.col("labels")
    buckets = [sample("_bucket", le(str(b)), F.col(f"_b{i}")) for i, b in enumerate(LATENCY_BOUNDS)]
    hist = F.array(*buckets, sample("_bucket", le("+Inf"), F.col("n")), sample("_sum", own, F.col("sum")), sample("_count", own, F.col("n")))
    one = F.array(sample("", own, F.when(F.col("kind") == "counter", F.col("sum")).otherwise(F.col("last"))))
    return g.select(F.inline(F.when(F.col("kind") == "histogram", hist).otherwise(one)))


def store_gauges(properties: DataFrame) -> DataFrame:
    """The storage metrics of a store's properties, as observations for engine_metrics; a stream's trigger can append them."""
    of = {"sstable_count": "runs", "sstable_size_bytes": "bytes", "disk_usage_bytes": "bytes", "compactions_total": "compactions", "compaction_bytes_total": "compacted_in"}
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.create_map().cast("map<string,string>").alias("labels"), F.col(c).cast("double").alias("amount"), F.col("last_seq").alias("ord")) for m, c in of.items()))
    return properties.select(F.inline(rows))


def histogram(rows: DataFrame, labels: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets (value <= bound, then +Inf), with sum and count: one pass, a sum for each bound."""
    sums = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    g = rows.groupBy(*labels).agg(*sums, F.count(value).alias("count"), F.sum(value).alias("sum"))
    buckets = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    buckets.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("cumulative")))
    return g.select(*labels, F.explode(F.array(*buckets)).alias("_x"), "count", "sum").select(*labels, "_x.le", "_x.cumulative", "count", "sum")


def exposition(samples: DataFrame) -> DataFrame:
    """samples: name, labels (map), value. A line of text each, labels sorted."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.format_string('%s="%s"', e["key"], e["value"])), ",")
    return samples.select(F.concat("name", F.when(pairs != "", F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise(""), F.lit(" "), metric_number(F.col("value"))).alias("line"))


def latency_summary(ops: DataFrame, labels: list[str], nanos: str, size: str | None = None, failed: str | None = None, seconds: float | None = None) -> DataFrame:
    """Count, mean (whole), extremes and nearest-rank percentiles; with failed (a boolean column) errors, with seconds (what
    the run took) ops_per_second, and with both seconds and size mb_per_second (of 2^20 bytes)."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by {nanos})").cast("long")
    rate = lambda c: (c / F.lit(float(seconds)) if seconds else F.lit(0.0)).cast("double")
    return ops.groupBy(*labels).agg(
        F.count("*").alias("ops"),
        F.expr(f"sum({nanos}) div count(*)").cast("long").alias("avg"),
        F.min(nanos).alias("min"),
        F.max(nanos).alias("max"),
        p("0.5").alias("p50"),
        p("0.9").alias("p90"),
        p("0.99").alias("p99"),
        p("0.999").alias("p999"),
        *([F.sum(size).alias("bytes")] if size else []),
        *([F.count_if(failed).alias("errors")] if failed else []),
        *([rate(F.count("*")).alias("ops_per_second")] if seconds is not None else []),
        *([(rate(F.sum(size)) / F.lit(float(1 << 20))).alias("mb_per_second")] if seconds is not None and size else []),
    )


def merged(parts: DataFrame) -> DataFrame:
    """Summaries of parts (ops, errors, total, min, max) as one."""
    return parts.agg(F.sum("ops").alias("ops"), F.sum("errors").alias("errors"), F.sum("total").alias("total"), F.min("min").alias("min"), F.max("max").alias("max"))


def hit_rate(hits: Column, misses: Column) -> Column:
    total = hits + misses
    return F.when(total > 0, F.format_string("%.2f%%", 100.0 * hits / total)).otherwise("N/A")


def rollup(checks: DataFrame) -> DataFrame:
    """checks: status, ready, live. The worst: not ready is degraded at least, not live unhealthy."""
    rank = F.when(F.col("status") == "unhealthy", 2).when(F.col("status") == "degraded", 1).otherwise(0)
    worst = F.max(F.greatest(rank, F.when(~F.col("live"), 2).otherwise(0), F.when(~F.col("ready"), 1).otherwise(0)))
    return checks.agg(F.element_at(F.array(*map(F.lit, SEVERITY)), worst + 1).alias("status"), F.count("*").alias("checks"))


def usage_status(used: Column, most: Column, free_bytes: Column | None = None) -> Column:
    """Unhealthy from 95 % (or under 100 MiB free), degraded from 80 %."""
    share = used / most
    bad = share >= 0.95
    if free_bytes is not None:
        bad = bad | (free_bytes < 100 << 20)
    return F.when(bad, "unhealthy").when(share >= 0.8, "degraded").otherwise("healthy")
