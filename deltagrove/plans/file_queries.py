"""The file catalog, manifest, compaction choices, codecs and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bytecodes, scalar
from ..operators import compaction, views
from ..sources import native, tablefiles
from .catalog import FILES_SQL, LOG_SQL, event_log, query, table

FS, LS = f"with {FILES_SQL}", f"with {LOG_SQL}"


def catalog(s, d, leveled: bool = False):
    f = compaction.file_catalog(event_log(s, d))
    return f.withColumn("level", F.when(F.col("file_num") % 3 == 0, 0).otherwise(F.col("file_num") % 3).cast("int")) if leveled else f


_LEVELED = FS + ", lf as (select *, (case when file_num % 3 = 0 then 0 else file_num % 3 end)::int as level from files)"


@query("file_catalog", f"{FS} select *, 0 as level from files")
def _(s, d):
    return catalog(s, d)


@query("files_for_key", f"{FS} select x.k, file_num from (values ('user:000003'), ('user:000077'), ('zzz')) x(k) join files on x.k between min_key and max_key")
def _(s, d):
    asked = s.createDataFrame([("user:000003",), ("user:000077",), ("zzz",)], "key string")
    return compaction.files_for_keys(catalog(s, d), asked).select(F.col("key").alias("k"), "file_num")


@query("files_overlapping", f"{FS} select file_num, min_key, max_key from files where max_key >= 'user:000010' and min_key <= 'user:000012'")
def _(s, d):
    return compaction.files_overlapping(catalog(s, d), "user:000010", "user:000012").select("file_num", "min_key", "max_key")


@query("level_lookup", f"""{_LEVELED} select x.k, level, file_num, row_number() over (partition by x.k order by level, file_num desc) as step
from (values ('user:000003'), ('user:000077')) x(k) join lf on x.k between min_key and max_key""")
def _(s, d):
    from pyspark.sql import Window

    asked = s.createDataFrame([("user:000003",), ("user:000077",)], "key string")
    w = Window.partitionBy("key").orderBy("level", F.desc("file_num"))
    return compaction.files_for_keys(catalog(s, d, True), asked).select(F.col("key").alias("k"), "level", "file_num", F.row_number().over(w).alias("step"))


_KEPT = """(select k, seq, op, v from (select *, lag(seq) over (partition by k order by seq desc, op desc) as newer from log)
where newer is null or (seq <= 2000 and newer > 2000) or (seq <= 5000 and newer > 5000))"""


@query("compact_retain", f"{LS} select k, seq, op::int as op, v from {_KEPT}")
def _(s, d):
    r = compaction.retained(event_log(s, d), [2000, 5000])
    return r.select(F.col("key").alias("k"), "seq", F.col("op").cast("int").alias("op"), F.col("value").alias("v"))


@query("compact_keeps_snapshot", f"{LS} select k, seq, v from (select *, row_number() over (partition by k order by seq desc) as n from log where seq <= 2000) where n = 1 and op = 0")
def _(s, d):
    kept = compaction.retained(event_log(s, d), [2000, 5000], bottom=True)
    return views.as_of(kept, 2000).select(F.col("key").alias("k"), "seq", F.col("value").alias("v"))


@query("compact_bottom", f"{LS} select k, seq from top where op = 0")
def _(s, d):
    return compaction.retained(event_log(s, d), [], bottom=True).select(F.col("key").alias("k"), "seq")


@query("compact_outputs", f"""{LS}, p as (select *, substr(k, 1, 10) as part, length(k) + coalesce(length(v), 0) + 20 as size from log),
q as (select *, coalesce(sum(size) over (partition by part order by k, seq desc rows between unbounded preceding and 1 preceding), 0) as before from p)
select part, (before // 4096)::bigint as file, sum(size)::bigint as size, count(*) as entries, min(k) as min_key, max(k) as max_key from q group by 1, 2""")
def _(s, d):
    return compaction.output_files(event_log(s, d).withColumn("part", F.substring("key", 1, 10)), 4096)


@query("deletion_task", f"{FS} select count(*) as files, sum(size)::bigint as size from files where file_num > 2")
def _(s, d):
    return catalog(s, d).where(~F.col("file_num").isin(1, 2)).agg(F.count("*").alias("files"), F.sum("size").alias("size"))


@query("level_stats", f"""{_LEVELED}, g as (select l.level::int as level, count(file_num) as files, coalesce(sum(size), 0)::bigint as size from range(7) l(level) left join lf on lf.level = l.level group by 1),
t as (select *, (case when level = 0 then 0 else 100000 * pow(10, level - 1) end)::bigint as target from g)
select *, (case when level = 0 then files / 4.0 else size / greatest(target, 1) end)::double as score from t""")
def _(s, d):
    return compaction.level_stats(catalog(s, d, True), 4, 100_000, 10)


@query("level_targets", "select level::int as level, (case when level = 0 then 0 else 67108864 * pow(10, level - 1) end)::bigint as target from range(7) t(level)")
def _(s, d):
    levels = s.range(7).select(F.col("id").cast("int").alias("level"))
    return levels.withColumn("target", compaction.level_target(F.col("level")))


@query("leveled_pick", f"{FS} select file_num, 0 as level, 'input' as role, 1 as target_level from files where (select count(*) from files) >= 4")
def _(s, d):
    return compaction.Leveled().pick(catalog(s, d))


@query("leveled_pick_by_size", f"""{_LEVELED}, m as (select level, sum(size) as size from lf where level > 0 group by level),
b as (select level from m where size > 1000 * pow(10, level - 1) order by size / (1000 * pow(10, level - 1)) desc, level limit 1),
i as (select lf.* from lf join b on lf.level = b.level order by min_key, file_num limit 1),
o as (select lf.* from lf, i where lf.level = i.level + 1 and lf.max_key >= i.min_key and lf.min_key <= i.max_key)
select file_num, level, 'input' as role, (level + 1)::int as target_level from i union all select file_num, level, 'overlap', level::int from o""")
def _(s, d):
    return compaction.Leveled(trigger=100, base=1000, ratio=10).pick_by_size(catalog(s, d, True))


@query("leveled_trigger", f"{_LEVELED} select true as needs_compaction, (select count(*) >= 12 from lf where level = 0) as stalled from (values (1)) where exists (select 1 from lf where level > 0 group by level having sum(size) > 1000 * pow(10, level - 1))")
def _(s, d):
    return compaction.Leveled(trigger=100, base=1000, ratio=10).state(catalog(s, d, True))


_SIZES = "(values (1, 0), (2, 512), (3, 1024), (4, 1025), (5, 4096), (6, 4097), (7, 16384), (8, 16385), (9, 1048576), (10, 5000), (11, 9000), (12, 16000)) s(file_num, size)"
_BUCKET = "case " + " ".join(f"when size <= {1024 * 4**i} then {i}" for i in range(9)) + " else 9 end"
_SIZE_ROWS = [(1, 0), (2, 512), (3, 1024), (4, 1025), (5, 4096), (6, 4097), (7, 16384), (8, 16385), (9, 1048576), (10, 5000), (11, 9000), (12, 16000)]


def sized(s):
    return s.createDataFrame(_SIZE_ROWS, "file_num long, size long")


@query("tiered_buckets", f"select b.bucket::int as bucket, count(s.size) as files, coalesce(sum(s.size), 0)::bigint as size from range(10) b(bucket) left join (select size, {_BUCKET} as bucket from {_SIZES}) s on s.bucket = b.bucket group by 1")
def _(s, d):
    return compaction.Tiered(base=1024).stats(sized(s))


@query("tiered_pick", f"with b as (select file_num, size, {_BUCKET} as bucket from {_SIZES}) select file_num::bigint as file_num, bucket::int as bucket, size::bigint as size, (5 / 4.0 * 8 / 10.0)::double as score from b where bucket = 2 order by size, file_num limit 4")
def _(s, d):
    return compaction.Tiered(base=1024, most=4).pick(sized(s))


@query("tiered_trigger", "select true as needs_compaction, false as stalled")
def _(s, d):
    return compaction.Tiered(base=1024).state(sized(s))


@query("fifo_evict", f"""{FS}, r as (select file_num, size, coalesce(sum(size) over (order by file_num rows between unbounded preceding and 1 preceding), 0)::bigint as freed_before from files)
select * from r where freed_before < (select sum(size) - 150000 from files) order by file_num limit 10""")
def _(s, d):
    return compaction.Fifo(most_bytes=150_000).excess(catalog(s, d))


@query("fifo_ttl", """with f as (select event_id // 1000 + 1 as file_num, max(ts) as created_at from events group by 1)
select file_num from f where created_at < (select max(ts) from events) - interval 864000 seconds order by file_num limit 10""")
def _(s, d):
    e = table(s, d, "events")
    f = e.groupBy((F.floor(F.col("event_id") / 1000) + 1).alias("file_num")).agg(F.max("ts").alias("created_at"))
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return compaction.Fifo(ttl_seconds=864_000).expired(f, now).select("file_num")


@query("fifo_trigger", f"{FS} select count(*) as files, sum(size)::bigint as size, sum(size) > 150000 as needs_compaction, count(*) >= 4 as stalled, min(file_num) as oldest, max(file_num) as newest from files")
def _(s, d):
    return compaction.Fifo(most_bytes=150_000, stop=4).state(catalog(s, d))


_EDITS = "(values (1, 1, 0, true), (1, 2, 0, true), (2, 3, 1, true), (2, 1, 0, false), (3, 2, 0, false), (3, 2, 0, true), (4, 3, 1, false), (5, 4, 2, true)) e(edit_id, file_num, level, added)"
_EDIT_ROWS = [(1, 1, 0, True), (1, 2, 0, True), (2, 3, 1, True), (2, 1, 0, False), (3, 2, 0, False), (3, 2, 0, True), (4, 3, 1, False), (5, 4, 2, True)]


@query("manifest_fold", f"select file_num, level from (select *, row_number() over (partition by level, file_num order by edit_id desc, added desc) as n from {_EDITS}) where n = 1 and added")
def _(s, d):
    return compaction.fold_edits(s.createDataFrame(_EDIT_ROWS, "edit_id long, file_num int, level int, added boolean"))


@query("manifest_counters", f"{FS} select max(file_num) + 1 as next_file, max(max_seq) as last_seq, max(min_seq) as log_number from files")
def _(s, d):
    f = catalog(s, d).select((F.col("file_num") + 1).alias("next_file"), F.col("max_seq").alias("last_seq"), F.col("min_seq").alias("log_number"))
    return compaction.counters(f)


_NAMES = ["000001.sst", "MANIFEST-000007", "CURRENT", "12.wal", "notes.txt", "1234567.sst", "MANIFEST-1"]
_NAME_SQL = ", ".join(f"('{n}')" for n in _NAMES)


@query("file_names", f"""select n as name, case when n = 'CURRENT' then 'current' when regexp_matches(n, '^MANIFEST-[0-9]{{6,}}$') then 'manifest' when regexp_matches(n, '^[0-9]{{6,}}\\.sst$') then 'table'
when regexp_matches(n, '^[0-9]+\\.wal$') then 'log' else 'unknown' end as kind, case when regexp_matches(n, '^(MANIFEST-[0-9]{{6,}}|[0-9]{{6,}}\\.sst|[0-9]+\\.wal)$') then regexp_extract(n, '([0-9]+)', 1)::bigint end as number from (values {_NAME_SQL}) t(n)""")
def _(s, d):
    t = s.createDataFrame([(n,) for n in _NAMES], "name string")
    return t.select("name", scalar.file_type(F.col("name")).alias("kind"), scalar.file_number(F.col("name")).alias("number"))


@query("build_names", "select file_num, printf('%06d.sst', file_num) as table_name, printf('MANIFEST-%06d', file_num) as manifest, printf('%d.wal', file_num) as log_name from (select distinct event_id // 1000 + 1 as file_num from events)")
def _(s, d):
    f = catalog(s, d).select("file_num")
    n = F.col("file_num")
    return f.select(n, scalar.table_name(n).alias("table_name"), scalar.manifest_name(n).alias("manifest"), scalar.log_name(n).alias("log_name"))


@query("bloom_parameters", """with n(n) as (values (0), (1), (5), (100), (1000), (10000)), b as (select n, (ceil(greatest(n * 10, 64) / 8.0) * 8)::bigint as bits from n),
k as (select *, greatest(1, least(30, (case when n > 0 then bits // n else 0 end) * 69 // 100))::int as hashes from b)
select n::bigint as n, bits, hashes, round(case when n <= 0 or hashes * n / bits > 1 then 1.0 else pow(hashes * n / bits, hashes) end, 10)::double as false_positives from k""")
def _(s, d):
    n = F.col("n")
    t = s.createDataFrame([(x,) for x in (0, 1, 5, 100, 1000, 10000)], "n long")
    return t.select(n, scalar.bloom_bits(n, 10).alias("bits"), scalar.bloom_hashes(n, 10).alias("hashes"), F.round(scalar.bloom_false_positives(n, 10), 10).alias("false_positives"))


@query("bloom_file_filters", f"{LS} select (seq - 1) // 1000 + 1 as file_num, count(distinct k) as keys, true as all_found from log group by 1")
def _(s, d):
    e = event_log(s, d).select((F.floor((F.col("seq") - 1) / 1000) + 1).alias("file_num"), "key")
    filters = bytecodes.bloom_filters(e, "file_num", "key")
    found = e.distinct().join(filters.select("file_num", "filter"), "file_num").groupBy("file_num").agg(F.min(bytecodes.may_contain("filter", F.col("key").cast("binary"))).alias("all_found"))
    return filters.select("file_num", "keys").join(found, "file_num")


@query("encode_entries", f"""{LS} select k, seq, lower(hex(seq)) as seq_hex, 17 + length(k) + coalesce(length(v), 0) as size, op::int as op, v, k as decoded_key from log""")
def _(s, d):
    e = event_log(s, d)
    b = scalar.encode_entry(F.col("op"), F.col("key").cast("binary"), F.col("value").cast("binary"), F.col("seq"))
    x = e.withColumn("bytes", b).withColumn("d", scalar.decode_entry(F.col("bytes")))
    return x.select(F.col("key").alias("k"), F.col("d.seq").alias("seq"), F.lower(F.hex("d.seq")).alias("seq_hex"), F.octet_length("bytes").cast("long").alias("size"), F.col("d.op").cast("int").alias("op"), F.col("d.value").cast("string").alias("v"), F.col("d.key").cast("string").alias("decoded_key"))


@query("uvarint_lengths", """select event_id, greatest(1, ceil(length(ltrim(bin(event_id * 97), '0')) / 7.0))::int as bytes from events""")
def _(s, d):
    n = F.col("event_id") * 97
    return table(s, d, "events").select("event_id", scalar.uvarint_len(n).alias("bytes"))


@query("fixed_le", "select event_id, event_id as back from events")
def _(s, d):
    return table(s, d, "events").select("event_id", scalar.from_fixed_le(scalar.fixed_le(F.col("event_id"), 8)).alias("back"))


@query("crc32c_values", "select * from (values ('', 0::bigint), ('123456789', 3808858755::bigint), ('a', 3251651376::bigint)) t(text, crc)")
def _(s, d):
    t = s.createDataFrame([("",), ("123456789",), ("a",)], "text string")
    return t.select("text", bytecodes.crc32c(F.col("text").cast("binary")).alias("crc"))


@query("human_sizes", "select * from (values (0, '0 B'), (100, '100 B'), (1024, '1.0 KB'), (1536, '1.5 KB'), (1048576, '1.0 MB'), (1073741824, '1.0 GB')) t(n, text)")
def _(s, d):
    t = s.createDataFrame([(x,) for x in (0, 100, 1024, 1536, 1 << 20, 1 << 30)], "n int")
    return t.select("n", scalar.human_bytes(F.col("n").cast("long")).alias("text"))


@query("log_replay", f"{LS} select (seq - 1) // 500 + 1 as file_num, count(*) as entries, max(seq) as last_seq from log where seq > 500 group by 1")
def _(s, d):
    e = event_log(s, d).withColumn("file_num", F.floor((F.col("seq") - 1) / 500) + 1)
    back = native.recovered(native.replayed(native.build_logs(e)), first_file=2)
    return back.groupBy("file_num").agg(F.count("*").alias("entries"), F.max("seq").alias("last_seq"))


@query("table_files", f"{LS} select (seq - 1) // 500 + 1 as file_num, k, seq, op::int as op, v from log")
def _(s, d):
    e = event_log(s, d).withColumn("file_num", F.floor((F.col("seq") - 1) / 500) + 1)
    back = tablefiles.table_rows(tablefiles.build_tables(e)).where("problem is null")
    return back.select("file_num", F.col("key").cast("string").alias("k"), "seq", F.col("op").cast("int").alias("op"), F.col("value").cast("string").alias("v"))
