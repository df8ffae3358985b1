"""Spans: propagation headers, samplers, trees and export shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def traceparent(header: Column) -> Column:
    """version-trace-span-flags: 32, 16 and 2 hex digits, not all zero; sampled is the lowest bit of the flags."""
    h = F.lower(F.trim(header))
    ok = h.rlike(r"^[0-9a-f]{2}-[0-9a-f]{32}-[0-9a-f]{16}-[0-9a-f]{2}$") & ~h.rlike(r"^ff-") & ~h.rlike(r"^..-0{32}-") & ~h.rlike(r"^.{35}-0{16}-")
    p = F.split(h, "-")
    get = lambda i: F.when(ok, F.element_at(p, i))
    return F.struct(get(2).alias("trace_id"), get(3).alias("span_id"), F.when(ok, F.element_at(p, 4).substr(2, 1).isin(*"13579bdf")).alias("sampled"))


def b3(header: Column) -> Column:
    """trace-span[-sampled[-parent]]; sampled is 1 or d."""
    p = F.split(F.lower(F.trim(header)), "-")
    at = lambda i: F.try_element_at(p, F.lit(i))
    ok = at(1).rlike("^([0-9a-f]{16}|[0-9a-f]{32})$") & at(2).rlike("^[0-9a-f]{16}$")
    return F.struct(F.when(ok, F.lpad(at(1), 32, "0")).alias("trace_id"), F.when(ok, at(2)).alias("span_id"), F.when(ok, F.coalesce(at(3).isin("1", "d"), F.lit(False))).alias("sampled"))


def _valid(trace_id: Column, span_id: Column) -> Column:
    return trace_id.rlike("^[0-9a-f]{32}$") & (trace_id != "0" * 32) & span_id.rlike("^[0-9a-f]{16}$") & (span_id != "0" * 16)


def traceparent_of(trace_id: Column, span_id: Column, sampled: Column) -> Column:
    """The header that hands a context on; null if the context isn't valid."""
    flags = F.when(sampled, "01").otherwise("00")
    return F.when(_valid(trace_id, span_id), F.concat_ws("-", F.lit("00"), trace_id, span_id, flags))


def b3_of(trace_id: Column, span_id: Column, sampled: Column) -> Column:
    return F.when(_valid(trace_id, span_id), F.concat_ws("-", trace_id, span_id, F.when(sampled, "1").otherwise("0")))


def b3_headers_of(trace_id: Column, span_id: Column, sampled: Column) -> Column:
    """The form with a header for each part, as a map."""
    parts = F.create_map(F.lit("x-b3-traceid"), trace_id, F.lit("x-b3-spanid"), span_id, F.lit("x-b3-sampled"), F.when(sampled, "1").otherwise("0"))
    return F.when(_valid(trace_id, span_id), parts)


def headers_of(trace_id: Column, span_id: Column, sampled: Column) -> Column:
    """All forms at once, as a map."""
    one = F.create_map(F.lit("traceparent"), traceparent_of(trace_id, span_id, sampled), F.lit("b3"), b3_of(trace_id, span_id, sampled))
    return F.when(_valid(trace_id, span_id), F.map_concat(one, b3_headers_of(trace_id, span_id, sampled)))


def extracted(headers: Column) -> Column:
    """The context in a map of headers, names in any case: traceparent if it is valid, else b3, else the B3 parts."""
    h = F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    at = lambda name: F.try_element_at(h, F.lit(name))
    parts = b3(F.concat_ws("-", at("x-b3-traceid"), at("x-b3-spanid"), F.coalesce(at("x-b3-sampled"), F.when(at("x-b3-flags") == "1", "d"))))
    w3c, single = traceparent(at("traceparent")), b3(at("b3"))
    return F.when(w3c["trace_id"].isNotNull(), w3c).when(single["trace_id"].isNotNull(), single).otherwise(parts)


def ratio_sampled(trace_id: Column, ratio: float) -> Column:
    """Whether the number in the trace id's last 16 hex digits is below ratio * 2^64."""
    if ratio <= 0:
        return F.lit(False)
    if ratio >= 1:
        return F.lit(True)
    digits = F.substring(trace_id, 17, 16)
    return F.conv(digits, 16, 10).cast("decimal(20,0)") < F.lit(str(int(ratio * 2**64))).cast("decimal(20,0)")


def rate_sampled(spans: DataFrame, per_second: int) -> DataFrame:
    """The first spans of each second, by start and id."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.date_trunc("second", "start")).orderBy("start", "span_id")
    return spans.withColumn("sampled", F.row_number().over(w) <= per_second)


def parent_based(spans: DataFrame, ratio: float) -> DataFrame:
    """A span is sampled as its parent is; without one, by ratio."""
    p = spans.select(F.col("trace_id"), F.col("span_id").alias("parent_span_id"), F.col("sampled").alias("_p"))
    return spans.join(p, ["trace_id", "parent_span_id"], "left").withColumn("sampled", F.coalesce("_p", ratio_sampled(F.col("trace_id"), ratio))).drop("_p")


def children(spans: DataFrame) -> DataFrame:
    """Each span with how many children it has and their summed duration."""
    kids = spans.where("parent_span_id is not null").groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.count("*").alias("children"), F.sum("duration").alias("child_duration"))
    return spans.join(kids, ["trace_id", "span_id"], "left").fillna(0, ["children", "child_duration"])


def json_line(spans: DataFrame) -> DataFrame:
    return spans.select(F.to_json(F.struct("trace_id", "span_id", "parent_span_id", "name", "duration")).alias("line"))


def zipkin(spans: DataFrame) -> DataFrame:
    return spans.select(F.to_json(F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("id"), F.col("parent_span_id").alias("parentId"), "name", "duration")).alias("line"))


def jaeger(spans: DataFrame) -> DataFrame:
    """A line for each trace, its spans in order of id."""
    one = F.struct(F.col("span_id").alias("spanID"), F.col("name").alias("operationName"), "duration")
    return spans.groupBy("trace_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("spans"))


def stats(spans: DataFrame) -> DataFrame:
    return spans.agg(F.count("*").alias("created"), F.count_if("sampled").alias("sampled"))
