"""Statistics, metrics, health, traces, backups, listings and generated workloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import workloads
from ..functions import scalar
from ..operators import compaction, stats, traces, views
from ..sources import transfer
from .catalog import FILES_SQL, LOG_SQL, event_log, query, table

L, FS = f"with {LOG_SQL}", f"with {FILES_SQL}"


@query("admin_sstables", f"{FS} select file_num, size, min_key, max_key, sum(size) over ()::bigint as total_size from files")
def _(s, d):
    f = compaction.file_catalog(event_log(s, d))
    total = f.agg(F.sum("size").alias("total_size"))
    return f.crossJoin(total).select("file_num", "size", "min_key", "max_key", "total_size")


@query("admin_properties", f"{L} select count(*) as entries, sum(op)::bigint as tombstones, count(distinct k) as keys, max(seq) as last_seq, sum(17 + length(k) + coalesce(length(v), 0))::bigint as bytes, (select count(*) from live) as live_keys from log")
def _(s, d):
    from ..schema import entry_size

    e = event_log(s, d)
    live = views.latest(e).agg(F.count("*").alias("live_keys"))
    return e.agg(F.count("*").alias("entries"), F.sum("op").alias("tombstones"), F.count_distinct("key").alias("keys"), F.max("seq").alias("last_seq"), F.sum(entry_size(F.col("key"), F.col("value"))).alias("bytes")).crossJoin(live)


@query("hit_rate", """with h as (select user_id % 7 as shard, count(*) filter (where event_type = 'view') as hits, count(*) filter (where event_type = 'error') as misses from events group by 1)
select shard, hits, misses, case when hits + misses > 0 then printf('%.2f%%', 100.0 * hits / (hits + misses)) else 'N/A' end as rate from h""")
def _(s, d):
    h = table(s, d, "events").groupBy((F.col("user_id") % 7).alias("shard")).agg(F.count_if(F.col("event_type") == "view").alias("hits"), F.count_if(F.col("event_type") == "error").alias("misses"))
    return h.withColumn("rate", stats.hit_rate(F.col("hits"), F.col("misses")))


@query("counter_vec", "select event_type, date_trunc('day', ts) as day, count(*) as value from events group by 1, 2")
def _(s, d):
    return stats.counter_vec(table(s, d, "events").withColumn("day", F.date_trunc("day", "ts")), ["event_type", "day"])


@query("gauge_vec", "select user_id, arg_max(value, (ts, event_id)) as value from events group by 1")
def _(s, d):
    return stats.gauge_vec(table(s, d, "events"), ["user_id"], "value", "ts", "event_id")


@query("histogram_le", """with b(le, bound) as (values ('1.0', 1.0), ('10.0', 10.0), ('50.0', 50.0), ('100.0', 100.0), ('250.0', 250.0), ('+Inf', 'infinity'::double))
select event_type, le, count(*) filter (where value <= bound) as cumulative, count(*) as count from events, b group by 1, 2""")
def _(s, d):
    return stats.histogram(table(s, d, "events"), ["event_type"], "value", [1.0, 10.0, 50.0, 100.0, 250.0]).drop("sum")


@query("metric_exposition", "select 'ops_total{kind=\"' || event_type || '\",source=\"log\"} ' || count(*)::varchar as line from events group by event_type")
def _(s, d):
    t = table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    labels = F.create_map(F.lit("source"), F.lit("log"), F.lit("kind"), F.col("event_type"))
    return stats.exposition(t.select(F.lit("ops_total").alias("name"), labels.alias("labels"), F.col("n").cast("double").alias("value")))


@query("metric_numbers", "select * from (values (1.0::double, '1'), (2.5, '2.5'), (-3.0, '-3')) t(x, text)")
def _(s, d):
    t = s.createDataFrame([(1.0,), (2.5,), (-3.0,)], "x double")
    return t.select("x", scalar.metric_number(F.col("x")).alias("text"))


_LAT = "select event_type, cast(floor(value * 1000) as bigint) as ns from events"


@query("latency_summary", f"""select event_type, count(*) as ops, (sum(ns) // count(*))::bigint as avg, min(ns) as min, max(ns) as max, quantile_disc(ns, 0.5) as p50, quantile_disc(ns, 0.9) as p90,
quantile_disc(ns, 0.99) as p99, quantile_disc(ns, 0.999) as p999 from ({_LAT}) group by event_type""")
def _(s, d):
    return stats.latency_summary(table(s, d, "events").select("event_type", F.floor(F.col("value") * 1000).cast("long").alias("ns")), ["event_type"], "ns")


@query("latency_rates", f"""select event_type, count(*) as ops, count(*) filter (where user_id % 11 = 0) as errors, count(*) / 60.0::double as ops_per_second, sum(strlen(props))::bigint as bytes,
sum(strlen(props)) / 60.0::double / 1048576.0::double as mb_per_second, (sum(ns) // count(*))::bigint as avg from (select *, floor(value * 1000)::bigint as ns from events) group by event_type""")
def _(s, d):
    e = table(s, d, "events").select("event_type", F.floor(F.col("value") * 1000).cast("long").alias("ns"), F.octet_length("props").cast("long").alias("size"), (F.col("user_id") % 11 == 0).alias("failed"))
    return stats.latency_summary(e, ["event_type"], "ns", "size", "failed", 60.0).select("event_type", "ops", "errors", "ops_per_second", "bytes", "mb_per_second", "avg")


_MOVES = "select user_id, event_id, case event_type when 'signup' then 'set' when 'error' then 'dec' when 'purchase' then 'add' else 'inc' end as move, case when event_type in ('signup', 'purchase') then (event_id % 10)::double end as amount from events"


@query("gauge_moves", f"""with m as ({_MOVES}), l as (select user_id, max(event_id) as at, max_by(amount, event_id) as v from m where move = 'set' group by 1)
select m.user_id, (coalesce(max(l.v), 0) + coalesce(sum(case when l.at is null or event_id > l.at then case move when 'set' then 0 when 'dec' then -1 when 'inc' then 1 else amount end end), 0))::double as value from m left join l using (user_id) group by 1""")
def _(s, d):
    t = F.col("event_type")
    move = F.when(t == "signup", "set").when(t == "error", "dec").when(t == "purchase", "add").otherwise("inc")
    m = table(s, d, "events").select("user_id", "event_id", move.alias("move"), F.when(t.isin("signup", "purchase"), (F.col("event_id") % 10).cast("double")).alias("amount"))
    return stats.gauge_moves(m, ["user_id"], "event_id")


_KNOWN = ", ".join(f"('{m}', '{k}')" for m, k in stats.ENGINE_METRICS)
_LE = ", ".join(f"('{b}', {b}::double)" for b in stats.LATENCY_BOUNDS)


@query("engine_metrics", f"""with k(metric, kind) as (values {_KNOWN}), b(le, most) as (values {_LE}, ('+Inf', 'infinity'::double)),
o as (select case event_type when 'view' then 'reads_total' when 'click' then 'read_latency_seconds' when 'purchase' then 'writes_total' when 'signup' then 'active_connections' else 'deletes_total' end as metric,
  case when event_type = 'click' then (event_id % 1000) / 1000.0::double else (event_id % 7)::double end as amount, event_id from events),
g as (select k.*, coalesce(sum(amount), 0) as s, count(amount) as n, coalesce(max_by(amount, event_id), 0) as last from k left join o using (metric) group by all)
select 'deltagrove_' || metric as name, null as le, case kind when 'counter' then s else last end::double as value from g where kind <> 'histogram'
union all select 'deltagrove_' || metric || '_sum', null, round(s, 6) from g where kind = 'histogram' union all select 'deltagrove_' || metric || '_count', null, n from g where kind = 'histogram'
union all select 'deltagrove_' || k.metric || '_bucket', le, count(*) filter (where amount <= most) from k cross join b left join o on o.metric = k.metric where kind = 'histogram' group by k.metric, le""")
def _(s, d):
    t = F.col("event_type")
    metric = F.when(t == "view", "reads_total").when(t == "click", "read_latency_seconds").when(t == "purchase", "writes_total").when(t == "signup", "active_connections").otherwise("deletes_total")
    amount = F.when(t == "click", (F.col("event_id") % 1000) / F.lit(1000.0)).otherwise((F.col("event_id") % 7).cast("double"))
    seen = table(s, d, "events").select(metric.alias("metric"), F.create_map().cast("map<string,string>").alias("labels"), amount.alias("amount"), F.col("event_id").alias("ord"))
    m = stats.engine_metrics(seen)  # a sum of doubles depends on its order: compared to six digits
    return m.select("name", F.try_element_at("labels", F.lit("le")).alias("le"), F.when(F.endswith("name", F.lit("_sum")), F.round("value", 6)).otherwise(F.col("value")).alias("value"))


@query("stats_merge", f"select count(*) as ops, count(*) filter (where event_type = 'error') as errors, sum(ns)::bigint as total, min(ns) as min, max(ns) as max from ({_LAT})")
def _(s, d):
    e = table(s, d, "events").select("event_type", F.floor(F.col("value") * 1000).cast("long").alias("ns"), (F.col("user_id") % 4).alias("worker"))
    parts = e.groupBy("worker").agg(F.count("*").alias("ops"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("ns").alias("total"), F.min("ns").alias("min"), F.max("ns").alias("max"))
    return stats.merged(parts)


@query("health_checks", """with u as (select user_id, count(*) as used from events group by 1)
select user_id, case when used / 90.0 >= 0.95 then 'unhealthy' when used / 90.0 >= 0.8 then 'degraded' else 'healthy' end as status from u""")
def _(s, d):
    u = table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("used"))
    return u.select("user_id", stats.usage_status(F.col("used"), F.lit(90.0)).alias("status"))


@query("health_rollup", "select * from (values (1, 'healthy', 2::bigint), (2, 'degraded', 2::bigint), (3, 'unhealthy', 1::bigint)) t(case_no, status, checks)")
def _(s, d):
    rows = [(1, "healthy", True, True), (1, "healthy", True, True), (2, "healthy", False, True), (2, "degraded", True, True), (3, "healthy", True, False)]
    t = s.createDataFrame(rows, "case_no int, status string, ready boolean, live boolean")
    out = [stats.rollup(t.where(f"case_no = {i}")).select(F.lit(i).alias("case_no"), "status", "checks") for i in (1, 2, 3)]
    return out[0].unionByName(out[1]).unionByName(out[2])


_T = "4bf92f3577b34da6a3ce929d0e0e4736"
_HEADERS = [(f"00-{_T}-00f067aa0ba902b7-01", _T, "00f067aa0ba902b7", True), (f"00-{_T}-00f067aa0ba902b7-10", _T, "00f067aa0ba902b7", False), (f"00-{'0' * 32}-00f067aa0ba902b7-01", None, None, None), ("junk", None, None, None), (f"ff-{_T}-00f067aa0ba902b7-01", None, None, None), (f"00-{_T}-{'0' * 16}-01", None, None, None)]
_sql = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'"


@query("traceparent_parse", "select * from (values " + ", ".join(f"({', '.join(map(_sql, h))})" for h in _HEADERS) + ") t(header, trace_id, span_id, sampled)")
def _(s, d):
    t = s.createDataFrame([(h[0],) for h in _HEADERS], "header string").withColumn("p", traces.traceparent(F.col("header")))
    return t.select("header", "p.trace_id", "p.span_id", "p.sampled")


@query("b3_parse", f"select * from (values ('{_T}-00f067aa0ba902b7-1', '{_T}', '00f067aa0ba902b7', true), ('a3ce929d0e0e4736-00f067aa0ba902b7', '0000000000000000a3ce929d0e0e4736', '00f067aa0ba902b7', false), ('0', null, null, null)) t(header, trace_id, span_id, sampled)")
def _(s, d):
    t = s.createDataFrame([(f"{_T}-00f067aa0ba902b7-1",), ("a3ce929d0e0e4736-00f067aa0ba902b7",), ("0",)], "header string").withColumn("p", traces.b3(F.col("header")))
    return t.select("header", "p.trace_id", "p.span_id", "p.sampled")


_CONTEXT = "select event_id, md5(user_id::varchar) as t, printf('%016x', event_id + 1) as p, event_id % 3 = 0 as sampled from events"


@query("trace_headers", f"""select event_id, '00-' || t || '-' || p || case when sampled then '-01' else '-00' end as traceparent, t || '-' || p || case when sampled then '-1' else '-0' end as b3, t as trace_id, p as span_id, sampled from ({_CONTEXT})""")
def _(s, d):
    e = table(s, d, "events").select("event_id", F.md5(F.col("user_id").cast("string")).alias("t"), F.lpad(F.lower(F.hex(F.col("event_id") + 1)), 16, "0").alias("p"), (F.col("event_id") % 3 == 0).alias("sampled"))
    h = e.withColumn("h", traces.headers_of(F.col("t"), F.col("p"), F.col("sampled")))
    # read back from one of the three forms, header names in capitals
    form = F.when(F.col("event_id") % 3 == 0, F.map_filter("h", lambda k, v: k == "traceparent")).when(F.col("event_id") % 3 == 1, F.map_filter("h", lambda k, v: k == "b3")).otherwise(F.map_filter("h", lambda k, v: k.startswith("x-")))
    back = h.withColumn("x", traces.extracted(F.transform_keys(form, lambda k, v: F.upper(k))))
    return back.select("event_id", F.col("h")["traceparent"].alias("traceparent"), F.col("h")["b3"].alias("b3"), "x.trace_id", "x.span_id", "x.sampled")


_SPANS = """spans as (select md5(user_id::varchar) as trace_id, printf('%016x', event_id + 1) as span_id,
  lag(printf('%016x', event_id + 1)) over (partition by user_id order by event_id) as parent_span_id, event_type as name, cast(floor(value * 1000) as bigint) as duration, ts as start from events)"""


def spans(s, d):
    from pyspark.sql import Window

    e = table(s, d, "events")
    span = F.lower(F.lpad(F.hex(F.col("event_id") + 1), 16, "0"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    return e.select(F.md5(F.col("user_id").cast("string").cast("binary")).alias("trace_id"), span.alias("span_id"), F.lag(span).over(w).alias("parent_span_id"), F.col("event_type").alias("name"), F.floor(F.col("value") * 1000).cast("long").alias("duration"), F.col("ts").alias("start"))


@query("ratio_sample", f"with {_SPANS} select trace_id, count(*) as spans from spans where ('0x' || substr(trace_id, 17, 16))::ubigint < 4611686018427387904 group by 1")
def _(s, d):
    return spans(s, d).where(traces.ratio_sampled(F.col("trace_id"), 0.25)).groupBy("trace_id").agg(F.count("*").alias("spans"))


@query("rate_sample", f"with {_SPANS}, r as (select *, row_number() over (partition by date_trunc('second', start) order by start, span_id) <= 1 as sampled from spans) select count(*) as created, count(*) filter (where sampled) as sampled from r")
def _(s, d):
    return traces.stats(traces.rate_sampled(spans(s, d), 1))


@query("parent_sample", f"with {_SPANS}, p as (select *, name = 'click' as sampled from spans) select c.span_id, case when p.span_id is null then ('0x' || substr(c.trace_id, 17, 16))::ubigint < 9223372036854775808 else p.sampled end as sampled from p c left join p on p.trace_id = c.trace_id and p.span_id = c.parent_span_id")
def _(s, d):
    return traces.parent_based(spans(s, d).withColumn("sampled", F.col("name") == "click"), 0.5).select("span_id", "sampled")


@query("span_children", f"with {_SPANS} select s.span_id, count(c.span_id) as children, coalesce(sum(c.duration), 0)::bigint as child_duration from spans s left join spans c on c.trace_id = s.trace_id and c.parent_span_id = s.span_id group by 1")
def _(s, d):
    return traces.children(spans(s, d)).select("span_id", "children", "child_duration")


@query("span_export_json", f"""with {_SPANS} select '{{"trace_id":"' || trace_id || '","span_id":"' || span_id || '"' || coalesce(',"parent_span_id":"' || parent_span_id || '"', '') || ',"name":"' || name || '","duration":' || duration || '}}' as line from spans""")
def _(s, d):
    return traces.json_line(spans(s, d))


@query("span_export_zipkin", f"""with {_SPANS} select '{{"traceId":"' || trace_id || '","id":"' || span_id || '"' || coalesce(',"parentId":"' || parent_span_id || '"', '') || ',"name":"' || name || '","duration":' || duration || '}}' as line from spans""")
def _(s, d):
    return traces.zipkin(spans(s, d))


@query("span_export_jaeger", f"""with {_SPANS} select trace_id, '[' || string_agg('{{"spanID":"' || span_id || '","operationName":"' || name || '","duration":' || duration || '}}', ',' order by span_id) || ']' as spans from spans group by 1""")
def _(s, d):
    return traces.jaeger(spans(s, d))


@query("log_levels", "select * from (values ('DEBUG', 'debug'), ('Warning', 'warn'), ('error', 'error'), ('x', 'info'), (' fatal ', 'fatal')) t(text, level)")
def _(s, d):
    t = s.createDataFrame([(x,) for x in ("DEBUG", "Warning", "error", "x", " fatal ")], "text string")
    return t.select("text", scalar.level_name(F.col("text")).alias("level"))


@query("log_analysis", "select json_extract_string(props, '$.k')::int % 10 as k, count(*) as n from events where props is not null group by 1")
def _(s, d):
    k = F.get_json_object("props", "$.k").cast("int") % 10
    return table(s, d, "events").where("props is not null").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@query("request_ids", "select event_id, 'req-' || printf('%08x', event_id) || '-' || printf('%08x', (epoch_us(ts) // 1000) & 4294967295) as request_id from events")
def _(s, d):
    e = table(s, d, "events")
    return e.select("event_id", scalar.request_id(F.lit("req"), F.col("event_id"), F.col("ts")).alias("request_id"))


_BACKUPS = [("b1", "full", "completed", None, 1), ("b2", "incremental", "completed", "b1", 2), ("b3", "full", "completed", None, 3), ("b4", "incremental", "completed", "b3", 4), ("b5", "incremental", "completed", "b4", 5), ("b6", "full", "failed", None, 6)]


def backups(s):
    return s.createDataFrame(_BACKUPS, "id string, kind string, status string, parent_id string, start_time long")


_BACKUP_SQL = "b(id, kind, status, parent_id, start_time) as (values " + ", ".join(f"({', '.join(map(_sql, b[:4]))}, {b[4]}::bigint)" for b in _BACKUPS) + ")"


@query("backup_parent", f"with {_BACKUP_SQL} select id, start_time from b where kind = 'full' and status = 'completed' order by start_time desc limit 1")
def _(s, d):
    return transfer.parent_of(backups(s)).select("id", "start_time")


@query("backup_chain", f"with recursive {_BACKUP_SQL}, c as (select id, parent_id, 0 as up from b where id = 'b5' union all select b.id, b.parent_id, c.up + 1 from b join c on b.id = c.parent_id) select id, parent_id, ((select max(up) from c) - up)::int as depth from c")
def _(s, d):
    return transfer.chain(backups(s), "b5")


@query("backup_deletable", f"with {_BACKUP_SQL} select id, status from b where id not in (select parent_id from b where parent_id is not null)")
def _(s, d):
    return transfer.deletable(backups(s)).select("id", "status")


@query("backup_list", f"with {_BACKUP_SQL} select kind, status, count(*) as n, min(start_time) as first_start, max(start_time) as last_start from b group by 1, 2")
def _(s, d):
    return backups(s).groupBy("kind", "status").agg(F.count("*").alias("n"), F.min("start_time").alias("first_start"), F.max("start_time").alias("last_start"))


def _files(s, d, upto: int):
    f = compaction.file_catalog(event_log(s, d).where(F.col("seq") <= upto))
    return f.select(scalar.table_name(F.col("file_num")).alias("name"), "size", F.col("max_seq").alias("mtime"), F.sha2(F.concat_ws("|", "min_key", "max_key", "size").cast("binary"), 256).alias("checksum"))


def _files_sql(upto: int) -> str:
    return f"(select printf('%06d.sst', (seq - 1) // 1000 + 1) as name, sum(17 + length(k) + coalesce(length(v), 0))::bigint as size, max(seq) as mtime, sha256(concat_ws('|', min(k), max(k), sum(17 + length(k) + coalesce(length(v), 0))::bigint)) as checksum from log where seq <= {upto} group by 1)"


@query("backup_incremental", f"{L} select c.name, c.size from {_files_sql(9500)} c where not exists (select 1 from {_files_sql(6500)} p where p.name = c.name and p.size = c.size and p.mtime = c.mtime)")
def _(s, d):
    return transfer.incremental(_files(s, d, 9500), _files(s, d, 6500)).select("name", "size")


@query("backup_restore", f"{L}, x as (select *, 0 as depth from {_files_sql(6500)} union all select *, 1 from {_files_sql(9500)}) select name, size, depth from (select *, row_number() over (partition by name order by depth desc) as n from x) where n = 1")
def _(s, d):
    both = _files(s, d, 6500).withColumn("depth", F.lit(0)).unionByName(_files(s, d, 9500).withColumn("depth", F.lit(1)))
    return transfer.restored(both).select("name", "size", "depth")


@query("backup_checksum", f"{L} select sha256(string_agg(name || checksum, '' order by name)) as checksum, count(*) as files from {_files_sql(9500)}")
def _(s, d):
    return transfer.overall_checksum(_files(s, d, 9500))


@query("backend_urls", "select * from (values ('/a/b', 'file', null, '/a/b'), ('file:///a', 'file', null, '/a'), ('s3://bucket/p/q', 's3', 'bucket', 'p/q'), ('s3://bucket', 's3', 'bucket', '')) t(url, scheme, bucket, path)")
def _(s, d):
    t = s.createDataFrame([(u,) for u in ("/a/b", "file:///a", "s3://bucket/p/q", "s3://bucket")], "url string")
    return t.withColumn("u", transfer.backend_url(F.col("url"))).select("url", "u.scheme", "u.bucket", "u.path")


_KEY = "printf('key%016d', {})"
_VALUE = "substr(repeat('abcdefghijklmnopqrstuvwxyz', 4), 1, 100)"


@query("fill_sequential", f"select {_KEY.format('i')} as k, (i + 1)::bigint as seq, {_VALUE} as v from range(20000) t(i)")
def _(s, d):
    return workloads.fill_sequential(s, 20_000).select(F.col("key").alias("k"), "seq", F.col("value").alias("v"))


@query("read_sequential", f"select pos, {_KEY.format('pos % 500')} as k, (pos % 500 + 1)::bigint as seq from range(2000) t(pos)")
def _(s, d):
    hits = views.multi_get(workloads.fill_sequential(s, 500), workloads.read_keys(s, 2000, 500, sequential=True))
    return hits.select("pos", F.col("key").alias("k"), "seq")


@query("read_random", "select 2000::bigint as reads, 2000::bigint as hits")
def _(s, d):
    asked = workloads.read_keys(s, 2000, 500)
    hits = views.multi_get(workloads.fill_sequential(s, 500), asked)
    return asked.agg(F.count("*").alias("reads")).crossJoin(hits.agg(F.count("*").alias("hits")))


@query("fill_random_distinct", "select true as all_in_space, 5000::bigint as rows")
def _(s, d):
    r = workloads.fill_random(s, 5000)
    return r.agg(F.max(F.substring("key", 4, 16).cast("long") < 5000).alias("all_in_space"), F.count("*").alias("rows"))


@query("scan_ranges", "select 50::bigint as ranges, 5000::bigint as keys")
def _(s, d):
    r = workloads.ranges(s, 50, 900)
    k = workloads.fill_sequential(s, 1000).select("key")
    hit = k.join(F.broadcast(r), (k.key >= r.start) & (k.key < r.end))  # 50 rows
    return r.agg(F.count("*").alias("ranges")).crossJoin(hit.agg(F.count("*").alias("keys")))


@query("delete_workload", "select 0::bigint as left_over")
def _(s, d):
    log = workloads.fill_sequential(s, 100)
    gone = workloads.deletes(s, 2000, 100, 100)
    return views.latest(log.unionByName(gone)).join(gone.select("key").distinct(), "key", "left_semi").agg(F.count("*").alias("left_over"))


@query("mixed_workload")
def _(s, d):
    from ..operators.commands import command_fold

    return command_fold(workloads.mixed(s, 20_000, 500)).groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("reply") == "END").alias("misses"))


@query("batch_export", "select (event_id // 512)::bigint as batch, count(*) as spans from events group by 1")
def _(s, d):
    return table(s, d, "events").groupBy(F.floor(F.col("event_id") / 512).alias("batch")).agg(F.count("*").alias("spans"))
