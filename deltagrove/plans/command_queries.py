"""The command protocol, counters, limiters and transfer."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import commands, limits, views
from ..operators.sequence import shared_folder
from ..schema import PROTOCOL_KEY
from ..sources import transfer
from .catalog import LOG_SQL, event_log, query, table

L = f"with {LOG_SQL}"


@query("cas_token", f"""{L}, x as (select k, coalesce(v, '') as v from live)
select k, v, (list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(1, length(v) + 1), lambda i: ascii(v[i])::hugeint)),
  lambda h, b: (xor(h::ubigint, b::ubigint)::hugeint * 1099511628211) % 18446744073709551616))::varchar as cas from x""")
def _(s, d):
    return commands.gets(views.latest(event_log(s, d))).select(F.col("key").alias("k"), F.col("value").alias("v"), "cas")


_ROWS = "select printf('user:%06d', c_custkey) as k, c_name as v from customer"


def _new_rows(s, d):
    return table(s, d, "customer").select(F.format_string("user:%06d", "c_custkey").alias("key"), F.col("c_name").alias("value"))


@query("cmd_add", f"{L} select r.* from ({_ROWS}) r where not exists (select 1 from live where live.k = r.k)")
def _(s, d):
    return commands.add(views.latest(event_log(s, d)), _new_rows(s, d)).select(F.col("key").alias("k"), F.col("value").alias("v"))


@query("cmd_replace", f"{L} select r.* from ({_ROWS}) r where exists (select 1 from live where live.k = r.k)")
def _(s, d):
    return commands.replace(views.latest(event_log(s, d)), _new_rows(s, d)).select(F.col("key").alias("k"), F.col("value").alias("v"))


@query("cmd_delete", f"{L} select r.k, case when live.k is null then 'NOT_FOUND' else 'DELETED' end as reply from ({_ROWS}) r left join live on live.k = r.k")
def _(s, d):
    live = views.latest(event_log(s, d)).select("key", F.lit("DELETED").alias("reply"))
    return _new_rows(s, d).select("key").join(live, "key", "left").select(F.col("key").alias("k"), F.coalesce("reply", F.lit("NOT_FOUND")).alias("reply"))


@query("cmd_flush_all", f"{L} select count(*) as tombstones, 0::bigint as live from live")
def _(s, d):
    e = event_log(s, d)
    gone = commands.flush_all(views.latest(e))
    after = views.latest(views.append(e, gone, "key"))
    return gone.agg(F.count("*").alias("tombstones")).crossJoin(after.agg(F.count("*").alias("live")))


def _counter(s, d):
    e = table(s, d, "events")
    up, down = F.col("event_type") == "purchase", F.col("event_type") == "error"
    name = F.when(up, "incr").when(down, "decr")
    delta = F.when(up, 3).otherwise(5).cast("decimal(20,0)")
    return e.where(up | down).select(F.format_string("user:%06d", "user_id").alias("key"), F.col("event_id").alias("ord"), name.alias("name"), delta.alias("delta"))


@query("counter_fold", """with c as (select printf('user:%06d', user_id) as k, event_id, case event_type when 'purchase' then 3 else -5 end as x from events where event_type in ('purchase', 'error'))
select k, (list_reduce(list_prepend(0::bigint, list(x::bigint order by event_id)), lambda a, x: greatest(0, a + x)))::varchar as value from c group by k""")
def _(s, d):
    return commands.counter_fold(_counter(s, d)).select(F.col("key").alias("k"), F.col("value").cast("string").alias("value"))


@query("counter_replies", """with c as (select printf('user:%06d', user_id) as k, event_id, case event_type when 'purchase' then 3 else -5 end as x from events where event_type in ('purchase', 'error')),
l as (select k, list(x::bigint order by event_id) as xs, list(event_id order by event_id) as ids from c group by k),
n as (select k, xs, ids, unnest(range(1, len(xs) + 1)) as i from l)
select k, ids[i] as ord, (list_reduce(list_prepend(100::bigint, xs[1:i]), lambda a, x: greatest(0, a + x)))::varchar as reply from n""")
def _(s, d):
    c = _counter(s, d).select("key", "ord", "name", F.lit(None).cast("string").alias("data"), F.lit(None).cast("long").alias("flags"), "delta", F.lit(None).cast("decimal(20,0)").alias("cas"))
    first = c.select("key").distinct().select("key", F.lit(-1).cast("long").alias("ord"), F.lit("set").alias("name"), F.lit("100").alias("data"), F.lit(None).cast("long").alias("flags"), F.lit(None).cast("decimal(20,0)").alias("delta"), F.lit(None).cast("decimal(20,0)").alias("cas"))
    return commands.command_fold(c.unionByName(first)).where("ord >= 0").select(F.col("key").alias("k"), "ord", "reply")


_STEPS = [("k", 1, "add", "a", None), ("k", 2, "add", "b", None), ("k", 3, "append", "c", None), ("k", 4, "prepend", "0", None), ("k", 5, "get", None, None), ("k", 6, "incr", None, 5), ("k", 7, "touch", None, None), ("k", 8, "delete", None, None), ("k", 9, "replace", "x", None), ("n", 1, "set", "5", None), ("n", 2, "decr", None, 10), ("n", 3, "incr", None, 18446744073709551615), ("n", 4, "incr", None, 2), ("n", 5, "delete", None, None), ("n", 6, "incr", None, 1)]
_REPLIES = ["STORED", "NOT_STORED", "STORED", "STORED", "VALUE 0ac", "CLIENT_ERROR cannot increment non-numeric value", "TOUCHED", "DELETED", "NOT_STORED", "STORED", "0", "18446744073709551615", "1", "DELETED", "NOT_FOUND"]


@query("command_replies", "select * from (values " + ", ".join(f"('{r[0]}', {r[1]}::bigint, '{reply}')" for r, reply in zip(_STEPS, _REPLIES, strict=True)) + ") t(k, ord, reply)")
def _(s, d):
    t = s.createDataFrame([(*r[:4], None if r[4] is None else str(r[4])) for r in _STEPS], "key string, ord long, name string, data string, delta string")
    t = t.withColumn("delta", F.col("delta").cast("decimal(20,0)")).withColumn("flags", F.lit(None).cast("long")).withColumn("cas", F.lit(None).cast("decimal(20,0)"))
    return commands.command_fold(t).select(F.col("key").alias("k"), "ord", "reply")


_LINES = ["get a b c", "set k 5 0 10", "set k x 0 10", "incr n 7 noreply", "incr n x", "delete", "cas k 1 2 3 99", "bogus", f"get {'x' * 251}", "set k 0 0 2000000", "touch k 60", "FLUSH_ALL"]
_PARSED = ["get|a,b,c||", "set|k|10|", "set|k|10|CLIENT_ERROR bad command line format", "incr|n|7|", "incr|n||CLIENT_ERROR invalid numeric delta argument", "delete|||ERROR", "cas|k|3|", "bogus|||ERROR", f"get|{'x' * 251}||CLIENT_ERROR bad key", "set|k|2000000|SERVER_ERROR object too large for cache", "touch|k|60|", "flush_all|||"]


@query("cmd_parse", "select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in zip(_LINES, _PARSED, strict=True)) + ") t(line, parsed)")
def _(s, d):
    p = commands.parse(s.createDataFrame([(x,) for x in _LINES], "line string"))
    number = F.coalesce(F.col("bytes").cast("string"), F.col("delta").cast("string"), F.when(F.col("name") == "touch", F.col("exptime").cast("string")), F.lit(""))
    return p.select("line", F.concat_ws("|", F.coalesce("name", F.lit("")), F.array_join("keys", ","), number, F.coalesce("error", F.lit(""))).alias("parsed"))


@query("cmd_keys_valid", f"select page_id, regexp_full_match(url, '[^\\x00-\\x20\\x7f]{{1,250}}') as valid from pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.col("url").rlike(PROTOCOL_KEY).alias("valid"))


@query("command_stats", """select count(*) filter (where event_type in ('view', 'click')) as cmd_get, count(*) filter (where event_type = 'signup') as cmd_set, count(*) filter (where event_type = 'error') as cmd_delete,
count(*) filter (where event_type = 'purchase') as cmd_counter, count(*) filter (where event_type in ('view', 'click') and user_id % 3 <> 0) as get_hits, count(*) filter (where event_type in ('view', 'click') and user_id % 3 = 0) as get_misses from events""")
def _(s, d):
    t = F.col("event_type")
    name = F.when(t.isin("view", "click"), "get").when(t == "signup", "set").when(t == "error", "delete").otherwise("incr")
    return commands.stats(table(s, d, "events").select(name.alias("name"), (F.col("user_id") % 3 != 0).alias("hit")))


@query("expiry_filter", "with n as (select max(ts) as now from events) select event_id from events, n where user_id % 5 = 0 or ts + interval 432000 seconds > now")
def _(s, d):
    e = table(s, d, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    view = e.withColumn("expires_at", F.when(F.col("user_id") % 5 != 0, F.col("ts") + F.make_interval(secs=F.lit(432_000))))
    return commands.unexpired(view, now).select("event_id")


def requests(s, d):
    return table(s, d, "events").select(F.format_string("user:%06d", "user_id").alias("client"), F.col("event_id").alias("ord"), "ts")


_WINDOWS = "select time_bucket(interval '1 day', ts) as window_start, count(*) as requests from events group by 1"


@query("window_counts", _WINDOWS)
def _(s, d):
    return limits.window_counts(requests(s, d), "1 day").select(F.col("window_start").cast("timestamp").alias("window_start"), "requests")


@query("sliding_weighted", f"""with w as (select user_id, time_bucket(interval '1 day', ts) as window_start, count(*) as requests from events group by 1, 2),
p as (select *, lag(window_start) over q as pw, lag(requests) over q as pr from w window q as (partition by user_id order by window_start))
select printf('user:%06d', user_id) as client, window_start, requests, (coalesce(case when pw = window_start - interval 1 day then pr end, 0) * 0.5 + requests)::double as weighted from p""")
def _(s, d):
    return limits.sliding_rate(limits.window_counts(requests(s, d), "1 day", "client"), 86_400, "client")


@query("progress_rate", "select date_trunc('hour', ts) as hour, count(*) as ops, count(*) / 3600.0::double as per_second from events group by 1")
def _(s, d):
    return table(s, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("ops"), (F.count("*") / F.lit(3600.0)).alias("per_second"))


_BUCKET = """with recursive r as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as i from events),
f as (select user_id, event_id, us, i, (2.0::double - 1.0::double) as tokens, true as allowed from r where i = 1
  union all select r.user_id, r.event_id, r.us, r.i,
    case when least(2.0::double, f.tokens + (r.us - f.us) / 1e6::double * 0.00002::double) >= 1 then least(2.0::double, f.tokens + (r.us - f.us) / 1e6::double * 0.00002::double) - 1 else least(2.0::double, f.tokens + (r.us - f.us) / 1e6::double * 0.00002::double) end,
    least(2.0::double, f.tokens + (r.us - f.us) / 1e6::double * 0.00002::double) >= 1 from f join r on r.user_id = f.user_id and r.i = f.i + 1)
select printf('user:%06d', user_id) as client, event_id as ord, allowed from f"""


@query("token_bucket", _BUCKET)
def _(s, d):
    return limits.token_bucket(requests(s, d), 0.00002, 2).select("client", "ord", "allowed")


@query("token_bucket_results", _BUCKET.replace("select printf('user:%06d', user_id) as client, event_id as ord, allowed from f", """select printf('user:%06d', user_id) as client, event_id as ord, allowed, tokens as remaining, 2.0::double as "limit",
  case when allowed then 0.0::double else greatest(0.0::double, (1 - tokens) / 0.00002::double) end as retry_after, us + round_even((2.0::double - tokens) / 0.00002::double * 1e6::double, 0)::bigint as reset_us from f"""))
def _(s, d):
    return limits.token_bucket(requests(s, d), 0.00002, 2)


_W = 86_400_000_000
#: The state after each request: window start, requests in it, requests in the window before it, and the weighted count before.
_SLIDING = f"""with recursive r as (select user_id, event_id, epoch_us(ts) as us, epoch_us(ts) // {_W} * {_W} as st, row_number() over (partition by user_id order by ts, event_id) as i from events),
f as (select user_id, event_id, us, i, st, 1::bigint as cur, 0::bigint as bef, 0::double as had from r where i = 1
  union all select user_id, event_id, us, i, st, cur + case when bef * share + cur + 1 <= 2 then 1 else 0 end, bef, bef * share + cur
  from (select r.user_id, r.event_id, r.us, r.i, r.st, 1 - (r.us - r.st)::double / {_W}::double as share, case when r.st > f.st then 0 else f.cur end as cur,
    case when r.st = f.st then f.bef when r.st = f.st + {_W} then f.cur else 0 end as bef from f join r on r.user_id = f.user_id and r.i = f.i + 1))
select printf('user:%06d', user_id) as client, event_id as ord, had + 1 <= 2 as allowed, greatest(0.0::double, 2 - (bef * (1 - (us - st)::double / {_W}::double) + cur)) as remaining, 2.0::double as "limit",
  case when had + 1 <= 2 or had < 2 then 0.0::double else (st + {_W} - us) / 1e6::double end as retry_after, st + {_W} as reset_us from f"""


@query("sliding_window_admission", _SLIDING)
def _(s, d):
    return limits.sliding_window(requests(s, d), 2, 86_400)


def _fold(rate: str, burst: str, rows: str, by: str) -> str:
    """A token bucket over rows r, numbered i within by, as the two parts of a recursive table."""
    now = f"least({burst}, f.tokens + (r.us - f.us) / 1e6::double * {rate})"
    return f"""select {by}, event_id, us, i, {burst} - 1 as tokens, true as ok from {rows} where i = 1
  union all select r.{by}, r.event_id, r.us, r.i, case when {now} >= 1 then {now} - 1 else {now} end, {now} >= 1 from f_{rows} f join {rows} r on r.{by} = f.{by} and r.i = f.i + 1"""


@query("two_level_admission", f"""with recursive g as (select 0 as one, user_id, event_id, epoch_us(ts) as us, row_number() over (order by ts, event_id) as i from events),
f_g as ({_fold("0.002::double", "20.0::double", "g", "one")}),
c as (select g.user_id, g.event_id, g.us, row_number() over (partition by g.user_id order by g.us, g.event_id) as i from g join f_g using (event_id) where ok),
f_c as ({_fold("0.00003::double", "2.0::double", "c", "user_id")})
select printf('user:%06d', user_id) as client, event_id as ord, f_g.ok as global_allowed, f_g.ok and coalesce(f_c.ok, false) as allowed from g join f_g using (event_id) left join f_c using (user_id, event_id)""")
def _(s, d):
    return limits.two_level(requests(s, d), 0.002, 0.00003, 20, 2)


_GETS = f"{L}, t as (select k, v, substr(k, 6)::bigint as n from live)"


@query("get_replies", f"""{_GETS} select n // 10 as request, string_agg('VALUE ' || k || ' ' || n % 8 || ' ' || strlen(v) || chr(13) || chr(10) || v || chr(13) || chr(10), '' order by k) || 'END' || chr(13) || chr(10) as reply from t group by 1""")
def _(s, d):
    n = F.substring("key", 6, 6).cast("long")
    view = views.latest(event_log(s, d)).select("key", (n % 8).alias("flags"), "value")
    asked = view.select(F.floor(n / 10).alias("request"), n.alias("pos"), "key")
    return commands.get_replies(asked, view)


@query("read_connections", """select user_id as conn, row_number() over (partition by user_id order by event_id) - 1 as ord, 'set' as name, 'e' || event_id as k,
case when user_id % 9 <> 0 then props end as data, case when user_id % 9 = 0 then 'CLIENT_ERROR bad data chunk' end as error from events qualify user_id % 9 <> 0 or ord = 0""")
def _(s, d):
    # every ninth connection ends in the middle of its first block
    e = table(s, d, "events").select("user_id", "event_id", F.concat(F.lit("set e"), F.col("event_id").cast("string"), F.lit(" 0 0 "), F.octet_length("props").cast("string"), F.lit("\r\n"), F.col("props"), F.lit("\r\n")).alias("t"))
    g = e.groupBy(F.col("user_id").alias("conn")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "t"))), lambda x: x["t"]), "").alias("t"), F.min(F.struct("event_id", "t"))["t"].alias("first"))
    cut = F.substring("first", F.lit(1), F.length("first") - 3)
    streams = g.select("conn", F.when(F.col("conn") % 9 == 0, cut).otherwise(F.col("t")).cast("binary").alias("stream"))
    c = commands.read_connections(streams)
    return c.select("conn", "ord", "name", F.element_at("keys", 1).alias("k"), F.col("data").cast("string").alias("data"), "error")


@query("idle_clients", "with n as (select max(ts) as now from events), l as (select user_id, max(ts) as last_seen from events group by 1) select printf('user:%06d', user_id) as client, last_seen from l, n where last_seen < now - interval 86400 seconds")
def _(s, d):
    r = requests(s, d)
    return limits.idle_clients(r, F.lit(r.agg(F.max("ts")).first()[0]), 86_400)


@query("retention_ttl", "select event_id from events where ts >= (select max(ts) from events) - interval 259200 seconds")
def _(s, d):
    e = table(s, d, "events")
    return e.where(F.col("ts") >= F.lit(e.agg(F.max("ts")).first()[0]) - F.make_interval(secs=F.lit(259_200))).select("event_id")


def _folder(s):
    """A new folder below the one that driver and executors share."""
    return f"{shared_folder(s).rstrip('/')}/deltagrove-{uuid.uuid4().hex}"


def _lines(s, text):
    """A folder that holds one text file of these lines."""
    path = _folder(s)
    s.createDataFrame([(x,) for x in text], "value string").coalesce(1).write.text(path)
    return path


@query("import_csv", """select 'import/' || c_custkey::varchar as k, c_name || '"x",' || chr(10) || 'y' as v from customer""")
def _(s, d):
    path = _folder(s) + "/csv"
    rows = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.concat("c_name", F.lit('"x",\ny')).alias("value"))
    transfer.write_csv(rows, path, header=True)
    got, _ = transfer.read_csv(s, path, header=True, key_prefix="import/")
    return got.select(F.col("key").alias("k"), F.col("value").alias("v"))


@query("import_csv_counts", "select 5::bigint as total, 3::bigint as imported, 2::bigint as failed")
def _(s, d):
    return transfer.read_csv(s, _lines(s, ["k1;v1", "keyonly", "k2;v2", ";v3", "k4;v4;more"]), delimiter=";")[1]


@query("import_jsonl", "select 'user:' || event_id::varchar as k, coalesce(props, '') as v from events")
def _(s, d):
    path = _folder(s) + "/json"
    e = table(s, d, "events").select(F.concat(F.lit("user:"), F.col("event_id").cast("string")).alias("key"), F.coalesce("props", F.lit("")).alias("value"))
    transfer.write_jsonl(e, path)
    got, _ = transfer.read_jsonl(s, path)
    return got.select(F.col("key").alias("k"), F.col("value").alias("v"))


@query("import_jsonl_values", "select * from (values ('a', '1'), ('b', 'true'), ('c', 'null'), ('d', '{\"x\":[1,2]}'), ('e', '')) t(k, v)")
def _(s, d):
    lines = ['{"k":"a","v":1}', "", '{"k":"b","v":true}', '{"k":"c","v":null}', '{"k":"d","v":{"x":[1,2]}}', "not json", '{"v":"no key"}', '{"k":"e","v":""}']
    got, _ = transfer.read_jsonl(s, _lines(s, lines), "k", "v")
    return got.select(F.col("key").alias("k"), F.col("value").alias("v"))


@query("import_stats", "select count(*) as records, sum(strlen(c_custkey::varchar) + strlen(c_name) + 3)::bigint as bytes from customer")
def _(s, d):
    return transfer.import_stats(table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value")))


@query("export_rows", f"{L} select k, v from live where starts_with(k, 'user:0000') order by k limit 25")
def _(s, d):
    return transfer.export_rows(event_log(s, d), prefix="user:0000", limit=25).select(F.col("key").alias("k"), F.col("value").alias("v"))


@query("import_tables", f"{L}, p as (select *, case when k < 'user:000075' then 0 else 1 end as part from log) select (part + 7)::bigint as file_num, 0 as level, min(k) as min_key, max(k) as max_key, min(seq) as min_seq, max(seq) as max_seq, count(*) as num_keys from p group by part")
def _(s, d):
    base = _folder(s)
    e = event_log(s, d)
    for i, part in enumerate((e.where("key < 'user:000075'"), e.where("key >= 'user:000075'"))):
        part.coalesce(1).sortWithinPartitions("key", F.desc("seq")).write.parquet(f"{base}/part={i}")
    out = [transfer.import_tables(s, f"{base}/part={i}", 7 + i) for i in (0, 1)]
    return out[0].unionByName(out[1]).select(F.col("file_num").cast("long").alias("file_num"), "level", "min_key", "max_key", "min_seq", "max_seq", "num_keys")
