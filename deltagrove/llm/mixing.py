"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

A source's target is its weight's share of all words, at most `epochs` times its own words; what is cut off is shared again
by weight among the others until no target is above its cap. A document is then taken a whole number of times, and a seeded
order of a source's documents takes the words that are left: whole documents, and of the last one its first words.

A null text has no words; an empty table gives no rows; null sources form one source, ranked last. Repeated rows are taken
each. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

SEED = "mix"
#: A seeded bucket of a source holds about so many documents; prefix sums go over buckets, then inside each.
BUCKET_DOCS = 256


def _ranked(sources: DataFrame) -> DataFrame:
    """rank (from 0) by source, nulls last, without one task that sorts them all."""
    t = written(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_pid", F.spark_partition_id()))
    base = t.groupBy("_pid").count()  # a row for each partition
    base = base.withColumn("_base", F.coalesce(F.sum("count").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_pid").orderBy(F.col("source").asc_nulls_last())) - 1
    return t.withColumn("_within", within).join(base.select("_pid", "_base"), "_pid").select(*sources.columns, (F.col("_base") + F.col("_within")).alias("rank"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """sources: source, source_size. Adds weight and target."""
    t = written(_ranked(sources).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")))
    cap = F.col("source_size") * epochs
    left = total = t.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    rest, clamped = F.lit(True), F.lit(False)
    weight = t.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    while weight:
        above = rest & (cap.cast("decimal(38,0)") * weight < F.lit(left).cast("decimal(38,0)") * F.col("weight"))
        cut = t.where(above).agg(F.sum(cap), F.sum("weight")).first()
        if not cut[1]:
            break
        # one threshold says it all: who is above once stays above, as what the others get only grows
        clamped = clamped | above
        rest = cap.cast("decimal(38,0)") * weight >= F.lit(left).cast("decimal(38,0)") * F.col("weight")
        left, weight = left - cut[0], weight - cut[1]
    share = F.lit(float(left)) * F.col("weight").cast("double") / F.lit(float(weight or 1))
    return t.withColumn("target", F.when(clamped, cap.cast("double")).otherwise(share if total else F.lit(0.0)))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: str = SEED) -> DataFrame:
    """doc_id and, as _row, the rows of docs with size, source_size, target and taken as _size, _source_size, _target, _taken."""
    docs = docs.select("doc_id", "text", "source", F.struct("*").alias("_row"))
    n = docs.count()
    bits = max(0, min(16, (n // BUCKET_DOCS).bit_length()))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    h = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    bucket = F.shiftright(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"), 16 - bits)
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    rows = docs.withColumn("_size", size).withColumn("_skey", skey).withColumn("_h", h).withColumn("_bucket", bucket)
    buckets = written(rows.groupBy("source", "_skey", "_bucket").agg(F.sum("_size").alias("_bucket_size")))
    sized = targets(buckets.groupBy("source").agg(F.sum("_bucket_size").alias("source_size")), weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sized = sized.withColumn("_skey", skey).withColumn("_whole", whole).select("_skey", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_whole", (F.floor(F.col("target") + 0.5) - F.col("_whole") * F.col("source_size")).alias("_extra"))
    before = F.coalesce(F.sum("_bucket_size").over(Window.partitionBy("_skey").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = buckets.withColumn("_before", before).select("_skey", "_bucket", "_before").join(sized, "_skey")
    # ahead grows with documents and sources, so it isn't broadcast; the window below uses the same exchange of the rows
    out = rows.join(written(ahead).hint("merge"), ["_skey", "_bucket"])
    run = Window.partitionBy("_skey", "_bucket").orderBy("_h", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("_before") + F.sum("_size").over(run) - F.col("_size")
    part = F.least(F.greatest(F.col("_extra") - start, F.lit(0)), F.col("_size"))
    return out.withColumn("_part", part).withColumn("_taken", F.col("_whole") * F.col("_size") + F.col("_part"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents: each row as often as it is taken; a partly taken one holds its first words."""
    p = plan_mix(docs, **how)
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("_part").cast("int")), " ")
    times = F.col("_whole").cast("int") + (F.col("_part") > 0).cast("int")
    rows = p.where(times > 0).withColumn("_n", F.explode(F.sequence(F.lit(1), times)))
    text = F.when((F.col("_n") > F.col("_whole")) & (F.col("_part") < F.col("_size")), cut).otherwise(F.col("text"))
    return rows.select(*(text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))
