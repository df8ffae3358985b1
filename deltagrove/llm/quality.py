"""Quality by perplexity: an interpolated modified Kneser-Ney model of bytes, trained on trusted text.

The model counts strings of 5 bytes in the texts that labels call good (all of them). Lower orders count different
continuations; each order has its three discounts, and what they take goes to the next lower order, down to an even share of
256 bytes. Blocks send shards the different strings of their documents, with how often they stand in trusted ones; the shards'
sums are one table of counts, whose joins by context give each string its log-probability; shards answer the blocks with it,
and a document's perplexity is that of its bytes, each after the four before (bytes 0 before the text).

A document is good if its perplexity is at most the KEEP quantile of its language's documents. An empty text has no
perplexity (null) and isn't good. Null languages are one language. Without trusted text every byte has an even share. Repeated
rows are scored each. Rows of labels with nulls are left out; an id is trusted if any label says so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import NULL_ID, Blocks, deltas, expand, mix64, narrow, rest_of, rows_of, squeeze, undeltas, unpack, widen
from .common import spread_join, written

ORDER = 5
KEEP = 0.9
#: One in so many ranks is how far off the quantiles may be that enclose the exact one.
ACCURACY = 10_000
#: Log-probabilities travel as whole 1/2048 of a nat, up to 31.
STEPS, FLOOR = 2048, 31.0


def grams(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The 5 bytes that end at each byte, as a number, first byte highest; bytes before a text count as 0."""
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(len(raw), np.uint64)
    place = np.arange(len(raw)) - np.repeat(starts[:-1], np.diff(starts))
    for back in range(ORDER - 1, -1, -1):
        part = np.zeros(len(raw), np.uint64)
        part[back:] = raw[: len(raw) - back] if back else raw
        part[place < back] = 0
        out = out << np.uint64(8) | part
    return out


def shard_of(g: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(g + np.uint64(1)) >> np.uint64(64 - bits)).astype(np.int64)


def _dealt(g: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different strings by shard, and each place's string."""
    keys, place = np.unique(g, return_inverse=True)
    shard = shard_of(keys, bits)
    order = np.lexsort((keys, shard))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return keys[order], back[place], np.searchsorted(shard[order], np.arange((1 << bits) + 1))


def _requests(blocks: Blocks, trusted: DataFrame) -> DataFrame:
    bits = blocks.shard_bits

    def run(batches):
        for row in rows_of(batches):
            ids, starts, data = unpack(row)
            keys, place, ends = _dealt(grams(data, starts), bits)
            good = {i for a in row["answers"] or [] for i in a["ids"]}
            weight = np.repeat(np.array([i in good for i in ids.tolist()], float), np.diff(starts))
            count = np.bincount(place, weights=weight, minlength=len(keys)).astype(np.int64)
            out = [(s, row["block"], deltas(keys[a:b]), squeeze(narrow(count[a:b]))) for s, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "block", "keys", "counts"])

    return blocks.with_answers(trusted).mapInArrow(run, "shard int, block long, keys binary, counts binary")


def _trusted(blocks: Blocks, labels: DataFrame) -> DataFrame:
    """Per block, the ids that labels call good."""

    def run(batches):
        for row in rows_of(batches):
            ids = np.frombuffer(row["ids"], np.int64)
            ids = np.unique(ids[ids != NULL_ID])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["block"]), pa.int64()), pa.array(ids, pa.int64())], ["block", "doc_id"])

    ids = blocks.table.select("block", "ids").mapInArrow(run, "block long, doc_id long")
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.join(good, "doc_id").groupBy("block").agg(F.collect_list("doc_id").alias("ids"))


def _sum_shard(table: pa.Table) -> pa.Table:
    keys = [undeltas(k) for k in table.column("keys").to_pylist()]
    counts = [widen(expand(c)) for c in table.column("counts").to_pylist()]
    g, place = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)
    return pa.table({"g": pa.array(g.astype(np.int64), pa.int64()), "c": pa.array(c, pa.int64())})


def discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ of an order from how many strings have counts of 1 to 4."""
    n = counts.agg(*(F.count_if(F.col("c") == i) for i in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (int(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    out = []
    for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        out.append(min(max(i - (i + 1) * y * b / a, 0.0), float(i)) if a else 0.0)
    return out


def _kneser_ney(asked: DataFrame) -> DataFrame:
    """asked: g (5 bytes), c (in trusted text). Gives g and logp."""
    top = asked.where("c > 0")
    counts = {ORDER: top}
    for n in range(ORDER - 1, 0, -1):  # different continuations to the left
        up = counts[n + 1].select((F.col("g") % (1 << 8 * n)).alias("g"))
        counts[n] = written(up.groupBy("g").agg(F.count("*").alias("c")))
    prob = None
    for n in range(1, ORDER + 1):
        d = discounts(counts[n])
        want = written(asked.select((F.col("g") % (1 << 8 * n)).alias("g")).distinct()) if n < ORDER else asked.select("g")
        off = F.when(F.col("c") >= 3, d[2]).when(F.col("c") == 2, d[1]).when(F.col("c") == 1, d[0]).otherwise(0.0)
        own = counts[n].select("g", F.greatest(F.col("c") - off, F.lit(0.0)).alias("_own"))
        context = counts[n].withColumn("_h", F.shiftright("g", 8)).groupBy("_h").agg(F.sum("c").alias("_total"), F.sum(off).alias("_off"))
        rows = want.withColumn("_h", F.shiftright("g", 8)).join(own, "g", "left").join(context, "_h", "left")
        if prob is None:
            lower = F.lit(1 / 256)
        else:
            rows = rows.withColumn("_l", F.col("g") % (1 << 8 * (n - 1))).join(prob.select(F.col("g").alias("_l"), F.col("p").alias("_low")), "_l")
            lower = F.col("_low")
        p = F.when(F.col("_total").isNull(), lower).otherwise((F.coalesce("_own", F.lit(0.0)) + F.col("_off") * lower) / F.col("_total"))
        prob = written(rows.select("g", p.alias("p")))
    return prob.select("g", F.log("p").alias("logp"))


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the text, with _perplexity."""
    blocks = Blocks(docs, keep=True)
    bits = blocks.shard_bits
    trusted = written(_trusted(blocks, labels))
    asked = written(_requests(blocks, trusted).groupBy("shard").applyInArrow(_sum_shard, "g long, c long"))

    def deal(batches):
        for b in batches:
            g = b.column("g").to_numpy(zero_copy_only=False).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(g, bits).astype(np.int32), pa.int32()), b.column("g"), b.column("logp")], ["shard", "g", "logp"])

    scored = _kneser_ney(asked).mapInArrow(deal, "shard int, g long, logp double")

    def answer(asking: pa.Table, model: pa.Table) -> pa.Table:
        g = model.column("g").to_numpy().astype(np.uint64)
        cost = np.rint(np.minimum(-model.column("logp").to_numpy(), FLOOR) * STEPS).astype(np.int64)
        order = np.argsort(g)
        g, cost = g[order], cost[order]
        out = [squeeze(narrow(cost[np.searchsorted(g, undeltas(k))])) for k in asking.column("keys").to_pylist()]
        return pa.table({"block": asking.column("block"), "shard": asking.column("shard"), "costs": pa.array(out, pa.binary())})

    again = _requests(blocks, trusted.limit(0)).select("shard", "block", "keys")
    answers = again.groupBy("shard").cogroup(scored.groupBy("shard")).applyInArrow(answer, "block long, shard int, costs binary")
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        for row in rows_of(batches):
            _, starts, data = unpack(row)
            keys, place, ends = _dealt(grams(data, starts), bits)
            cost = np.zeros(len(keys))
            said = {a["shard"]: a["costs"] for a in row["answers"] or []}
            for s, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                if b > a:
                    cost[a:b] = widen(expand(said[s]))
            total = np.concatenate([[0.0], np.cumsum(cost[place])])[starts]
            n = np.diff(starts)
            ppl = np.exp(np.diff(total) / STEPS / np.maximum(n, 1))
            table = rest_of(row).select(names).append_column("_perplexity", pa.array(ppl, pa.float64(), mask=n == 0))
            yield from table.combine_chunks().to_batches()

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return blocks.with_answers(answers).mapInArrow(run, f"{fields}, _perplexity double")


def quantiles(rows: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """key and threshold: the least value that at least the share q of a key's values do not pass; null without values.

    Exact at any size: approximate quantiles on both sides, whose ranks are at most one in ACCURACY off, enclose it, and only
    the few rows between them are ranked."""
    edge = 3 / ACCURACY
    ends = F.percentile_approx(value, F.array(F.lit(max(0.0, q - edge)), F.lit(min(1.0, q + edge))), F.lit(ACCURACY))
    span = rows.groupBy(key).agg(ends.alias("_ends"), F.greatest(F.ceil(F.count(value) * F.lit(q)), F.lit(1)).alias("_rank"))
    near = spread_join(rows, span, key)
    below = near.groupBy(key).agg(F.count(F.when(F.col(value) < F.col("_ends")[0], 1)).alias("_below"))
    between = near.where((F.col(value) >= F.col("_ends")[0]) & (F.col(value) <= F.col("_ends")[1]))
    ranked = between.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(value))).join(below, key)
    found = ranked.where(F.col("_below") + F.col("_place") == F.col("_rank")).select(key, F.col(value).alias("threshold"))
    return span.select(key).join(found, key, "left")


def quality_report(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, lang, perplexity, threshold (the keep quantile of the language) and good."""
    p = written(perplexities(docs.select("doc_id", "text", "lang"), labels))
    p = p.withColumn("_k", F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("")))
    j = spread_join(p, quantiles(p, "_k", "_perplexity", keep), "_k")
    good = F.coalesce(F.col("_perplexity") <= F.col("threshold"), F.lit(False))
    return j.select("doc_id", "lang", F.col("_perplexity").alias("perplexity"), "threshold", good.alias("good"))
