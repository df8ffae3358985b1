"""Golden cases, properties against a plain model, plans, streams, native bytes and the store."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from deltagrove import keys
from deltagrove.cli import main
from deltagrove.config import Config
from deltagrove.functions import bytecodes, scalar
from deltagrove.operators import commands, compaction, limits, stats, views
from deltagrove.schema import Corruption, InvalidKey, SnapshotReleased, StoreError, WriteStalled
from deltagrove.sources import manifests, native, tablefiles, transfer
from deltagrove.store import Store
from deltagrove.streaming import jobs


def log(spark, rows):
    return spark.createDataFrame(rows, "key string, seq long, op tinyint, value string")


def kv(df):
    return sorted((r.key, r.value) for r in df.collect())


@pytest.mark.parametrize(("prefix", "end"), [(b"a", b"b"), (b"ab", b"ac"), (b"\0", b"\1"), (b"\xff", None), (b"\xff\xff", None), (b"\xaa\xff", b"\xab"), (None, None)])
def test_prefix_end(prefix, end):
    assert keys.prefix_end(prefix) == end


def test_versions(spark):
    rows = log(spark, [("k", 1, 0, "v1"), ("k", 5, 0, "v2"), ("k", 10, 0, "v3")])
    for seq, want in ((1, "v1"), (4, "v1"), (5, "v2"), (9, "v2"), (10, "v3"), (100, "v3")):
        assert kv(views.as_of(rows, seq)) == [("k", want)]
    assert kv(views.as_of(rows.where("seq > 1"), 1)) == []


def test_merge_at_snapshot(spark):
    a = log(spark, [("a", 30, 0, "v3"), ("b", 25, 0, "b2")])
    b = log(spark, [("a", 20, 0, "v2"), ("a", 10, 0, "v1"), ("b", 15, 0, "b1")])
    assert kv(views.merge_sources([a, b], 20)) == [("a", "v2"), ("b", "b1")]


def test_tombstones_and_ties(spark):
    rows = log(spark, [("a", 1, 0, ""), ("b", 2, 1, None), ("c", 3, 0, "c"), ("d", 4, 0, "x"), ("d", 4, 1, None)])
    assert kv(views.as_of(rows)) == [("a", ""), ("c", "c")]
    assert [r.key for r in views.as_of(rows, tombstones=True).orderBy("key").collect()] == ["a", "b", "c", "d"]


def test_snapshot_filter_keeps_versions(spark):
    rows = log(spark, [("a", 20, 0, "a2"), ("a", 30, 0, "a3"), ("b", 15, 0, "b1"), ("b", 25, 0, "b2"), ("c", 22, 1, None), ("c", 12, 0, "c1"), ("d", 18, 0, "d1")])
    assert [v for _, v in kv(views.snapshot_filter(rows, 20))] == ["a2", "b1", "c1", "d1"]


def test_scan_versions_keeps_versions(spark):
    rows = log(spark, [("a", 1, 0, "a1"), ("b", 2, 0, "b2"), ("b", 3, 1, None), ("b", 4, 0, "b4"), ("c", 5, 0, "c5"), ("c", 5, 0, "c5"), ("d", 6, 0, "d6")])
    assert [v for _, v in kv(views.scan_versions(rows, "b", "d"))] == ["b2", "b4", "c5", "c5"]
    assert views.scan_versions(rows, prefix="b", tombstones=True).count() == 3 and views.scan_versions(rows).count() == 6
    assert [v for _, v in kv(views.scan(rows, "b", "d"))] == ["b4", "c5"]


def test_page_urls_that_repeat(spark, tmp_path):
    """Pages that share a url stay a row each in kv_scan_page_urls, as in its SQL."""
    import duckdb

    from deltagrove.plans import catalog

    urls = ["https://m.a/", "https://m.a/", "https://m.\u00e9/", "https://mz.b/x", "https://mz.b/x", "https://n", "https://m", "http://m.a/", None, None]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()["kv_scan_page_urls"]).fetchall())
    assert len(want) == 5 and sorted(map(tuple, catalog.queries()["kv_scan_page_urls"](spark, str(tmp_path)).collect())) == want


def test_random_logs_against_a_dict(spark):
    rng = random.Random(7)
    for _ in range(3):
        rows = [(rng.choice("abcdefgh") * rng.randint(1, 2), i + 1, int(rng.random() < 0.3), None) for i in range(120)]
        rows = [(k, s, op, None if op else f"v{s}") for k, s, op, _ in rows]
        at = sorted(rng.sample(range(1, 121), 3))

        def model(upto, rows=rows):
            state = {}
            for k, s, op, v in rows:
                if s <= upto:
                    state[k] = (op, v)
            return sorted((k, v) for k, (op, v) in state.items() if op == 0)

        t = log(spark, rows)
        kept = compaction.retained(t, at, bottom=True)
        for s in (*at, 120):
            assert kv(views.as_of(t, s)) == model(s) == kv(views.as_of(kept, s))
        assert kept.count() <= len(rows)


def test_plans(spark, tmp_path):
    path = str(tmp_path / "log")
    log(spark, [(f"k{i:03d}", i + 1, 0, "v") for i in range(200)]).write.parquet(path)
    df = views.scan(spark.read.parquet(path), "k010", "k020")
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key,k010)" in plan and "LessThan(key,k020)" in plan
    assert "WindowGroupLimit" in plan


def test_counter_wraps_and_stops_at_zero(spark):
    rows = [("k", 1, "incr", 2**64 - 1), ("k", 2, "incr", 3), ("z", 1, "decr", 5), ("z", 2, "incr", 4), ("z", 3, "decr", 1)]
    t = spark.createDataFrame([(k, o, n, str(d)) for k, o, n, d in rows], "key string, ord long, name string, delta string").withColumn("delta", F.col("delta").cast("decimal(20,0)"))
    assert {r.key: int(r.value) for r in commands.counter_fold(t).collect()} == {"k": 2, "z": 3}


def test_cas():
    s = commands.State()
    assert commands.apply(s, "cas", "x", 0, None, 1) == "NOT_FOUND"
    assert commands.apply(s, "set", "x", 7, None, None) == "STORED"
    assert commands.apply(s, "cas", "y", 0, None, 1) == "EXISTS"
    assert commands.apply(s, "cas", "y", 0, None, commands.token("x")) == "STORED"
    assert commands.token("") == 14695981039346656037


def test_limiters():
    b = limits.TokenBucket(10, 2)
    assert [b.allow(0), b.allow(0), b.allow(0), b.allow(100_000)] == [True, True, False, True]
    w = limits.SlidingWindow(100, 1_000_000)
    assert all(w.allow(0) for _ in range(80)) and w.remaining() == 20
    assert round(100 - w.count(1_500_000)) == 60
    assert w.count(5_000_000) == 0


def test_bloom_filter():
    data = bytecodes.bloom_build([b"key%08d" % i for i in range(10_000)])
    assert all(bytecodes.bloom_may_contain(data, b"key%08d" % i) for i in range(10_000))
    wrong = sum(bytecodes.bloom_may_contain(data, b"notakey%08d" % i) for i in range(20_000))
    assert wrong <= 600
    assert bytecodes.crc32c_of(b"123456789") == 0xE3069283


def test_log_files(spark, tmp_path):
    rows = [(b"k%d" % i, i + 1, i % 2, None if i % 2 else b"v" * (20_000 * (i % 5))) for i in range(20)]
    data = bytearray(native.write_records([native.encode_entry(*r) for r in rows]))
    (tmp_path / "1.wal").write_bytes(bytes(data))
    got = native.recovered(native.read_logs(spark, f"file://{tmp_path}")).orderBy("seq").collect()
    assert [(bytes(r.key), r.seq, r.op, None if r.value is None else bytes(r.value)) for r in got] == rows
    data[40] ^= 1
    (tmp_path / "1.wal").write_bytes(bytes(data[: len(data) - 5]))
    bad = native.read_logs(spark, f"file://{tmp_path}")
    assert bad.where("problem is not null").count() >= 2


def test_log_record_header(spark, tmp_path):
    """A record built by hand: CRC-32C of type and payload (4 bytes), length (4), type (1), payload."""
    payload = bytes([0]) + (1).to_bytes(4, "little") + (2).to_bytes(4, "little") + (7).to_bytes(8, "little") + b"kvv"
    record = bytecodes.crc32c_of(b"\x01" + payload).to_bytes(4, "little") + len(payload).to_bytes(4, "little") + b"\x01" + payload
    assert native.write_records([payload]) == record
    big = native.write_records([b"x" * 40_000])
    assert big[8] == 2 and int.from_bytes(big[4:8], "little") == 32_768 - 9 and big[32_768 + 8] == 4
    (tmp_path / "3.wal").write_bytes(record * 2)
    assert [tuple(r)[:4] for r in native.read_logs(spark, f"file://{tmp_path}").collect()] == [(3, bytearray(b"k"), 7, 0)] * 2


def test_sliding_window_keeps_the_window_before():
    w = limits.SlidingWindow(100, 1_000_000)
    assert all(w.allow(0) for _ in range(80))
    assert w.remaining(1_500_000) == 60 and w.retry_after(now=1_500_000) == 0
    assert all(w.allow(1_500_000) for _ in range(60)) and not w.allow(1_500_000)
    assert w.retry_after() == 0.5


def test_fifo_state(spark):
    t = spark.sql("select id as file_num, 10L as size, timestamp'2024-01-01' + make_interval(0, 0, 0, id) as created_at from range(4)")
    now = F.to_timestamp(F.lit("2024-01-04 12:00:00"))
    state = lambda f, **k: tuple(f.state(t, **k).select("needs_compaction", "stalled").first())
    assert state(compaction.Fifo(most_bytes=40, stop=5)) == (False, False)
    assert state(compaction.Fifo(most_bytes=39, stop=4)) == (True, True)
    assert state(compaction.Fifo(most_bytes=40, ttl_seconds=86_400), now=now) == (True, False)
    assert state(compaction.Fifo(most_bytes=40, ttl_seconds=864_000), now=now) == (False, False)


def test_request_id(spark):
    r = spark.sql("select timestamp_millis(1700000000123) as t").select(scalar.request_id(F.lit("p"), F.lit(17), F.col("t")), scalar.request_id(F.lit("p"), F.lit(1 << 36), F.col("t"))).first()
    low = format(1700000000123 & 0xFFFFFFFF, "08x")
    assert tuple(r) == (f"p-00000011-{low}", f"p-1000000000-{low}")


def test_snapshot_of_an_empty_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    snap = store.snapshot()
    store.put(b"k", b"v")
    assert snap.get(b"k") is None and snap.view().count() == 0 and store.get(b"k") == b"v"


def test_streams(spark, tmp_path):
    rows = [("k", 1, "set", "5"), ("k", 2, "incr", None), ("k", 3, "delete", None), ("n", 1, "get", None)]
    t = spark.createDataFrame(rows, "key string, ord long, name string, data string")
    t = t.withColumn("flags", F.lit(0).cast("long")).withColumn("delta", F.lit(2).cast("decimal(20,0)")).withColumn("cas", F.lit(None).cast("decimal(20,0)"))
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = jobs.command_stream(spark.readStream.schema(t.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("replies").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.key, r.ord, r.reply) for r in spark.table("replies").collect()) == [("k", 1, "STORED"), ("k", 2, "7"), ("k", 3, "DELETED"), ("n", 1, "END")]


def test_stream_ingest(spark, tmp_path):
    log_path = str(tmp_path / "log")
    schema = "key string, seq long, op tinyint, value string, batch long"

    def read_log():
        import os

        return spark.read.schema(schema).parquet(log_path) if os.path.exists(log_path) else spark.createDataFrame([], schema)

    src = str(tmp_path / "in")
    for n in range(2):
        spark.createDataFrame([(f"k{i}", 0, f"b{n}", i) for i in range(3)], "key string, op int, value string, ord long").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("key string, op int, value string, ord long").parquet(src)
        jobs.ingest(stream, read_log, log_path, str(tmp_path / "ck")).awaitTermination()
    got = read_log().orderBy("seq").collect()
    assert [r.seq for r in got] == [1, 2, 3, 4, 5, 6]
    assert kv(views.latest(read_log())) == [("k0", "b1"), ("k1", "b1"), ("k2", "b1")]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), Config())
    assert s.put(b"a", b"1") == 1
    assert s.write_batch([(b"b", b"2"), (b"c", b"3"), (b"a", b"4"), (b"\xff\x00", b"")]) == 5
    snap = s.snapshot()
    s.delete(b"b")
    assert s.get(b"b") is None and snap.get(b"b") == b"2" and s.get(b"\xff\x00") == b"" and s.has(b"a")
    assert [bytes(r.key) for r in s.scan(b"a", b"d").collect()] == [b"a", b"c"]
    assert s.delete_range(b"c", b"d") == 1
    s.compact()
    assert s.get(b"a") == b"4" and s.get(b"c") is None and snap.get(b"c") == b"3"
    snap.release()
    with pytest.raises(SnapshotReleased):
        snap.get(b"a")
    with pytest.raises(InvalidKey):
        s.put(b"", b"x")
    s.latest("kv")
    assert spark.sql("select count(*) from kv").first()[0] == 2
    s.backup(str(tmp_path / "backup"))
    s.put(b"z", b"9")
    s.restore(str(tmp_path / "backup"))
    assert s.get(b"z") is None and s.get(b"a") == b"4"
    assert main([str(tmp_path / "store"), "get", "a"], spark) == 0
    assert main([str(tmp_path / "store"), "get", "nope"], spark) == 1


def test_csv_round_trip_keeps_empty_values(spark, tmp_path):
    rows = spark.createDataFrame([("a", ""), ("b", 'x,"y"\nz'), ("c", "é")], "key string, value string")
    transfer.write_csv(rows, str(tmp_path / "csv"))
    got, counts = transfer.read_csv(spark, str(tmp_path / "csv"))
    assert kv(got) == kv(rows) and counts.first().imported == 3


def test_tiered_limits(spark):
    t = compaction.Tiered(base=1024)
    sizes = spark.createDataFrame([(n,) for n in (0, 512, 1024, 1025, 4096, 4097, 16384, 16385, 1 << 20)], "size long")
    assert [r.b for r in sizes.select("size", t.bucket(F.col("size")).alias("b")).orderBy("size").collect()] == [0, 0, 0, 1, 1, 2, 2, 3, 5]


def test_config():
    assert Config.from_json(Config(strategy="fifo").to_json()).strategy == "fifo"
    with pytest.raises(ValueError):
        Config(strategy="none").validate()


def test_missing_llm_is_fine(monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(__spark_entry__, "_present", lambda module: False)
    assert "kv_latest" in __spark_entry__.queries() and "kv_latest" in __spark_entry__.oracle_sql()


def test_snapshots_outlast_the_process(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    s = Store(spark, at)
    s.write_batch([(b"a", b"1"), (b"b", b"2")])
    first = s.snapshot()
    s.write_batch([(b"a", b"3"), (b"b", None)])
    other = Store(spark, at)
    assert [(x.id, x.seq) for x in other.active_snapshots()] == [(1, 2)] and other.oldest_seq() == 2
    other.compact()
    assert first.get(b"a") == b"1" and other.open_snapshot(1).get(b"b") == b"2" and other.get(b"b") is None
    first.release()
    first.release()
    with pytest.raises(SnapshotReleased):
        other.open_snapshot(1)
    assert other.snapshot().id == 2


def test_one_of_two_writers_of_a_version_wins(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    old = s._state()
    s._commit(old, last_seq=7)
    with pytest.raises(WriteStalled):
        s._commit(old, last_seq=8)
    assert s.last_seq == 7 and not [n for n in s._names("_catalog") if n.endswith(".tmp")]


def test_incremental_backups_and_their_chain(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    full, inc, last = (f"file://{tmp_path}/{n}" for n in ("full", "inc", "last"))
    s.write_batch([(b"a", b"1"), (b"b", b"2")])
    s.backup(full)
    s.put(b"c", b"3")
    s.backup(inc, full)
    assert spark.read.parquet(f"{inc}/data").count() == 1  # the new run alone
    s.delete(b"a")
    s.compact()
    s.put(b"d", b"4")
    s.backup(last, inc)
    t = Store(spark, f"file://{tmp_path}/t")
    t.restore(inc)
    assert kv(t.latest()) == [(b"a", b"1"), (b"b", b"2"), (b"c", b"3")] and t.last_seq == 3
    t.restore(last)  # runs that the compaction made void don't come back
    assert kv(t.latest()) == [(b"b", b"2"), (b"c", b"3"), (b"d", b"4")]
    t.restore(inc, seq=1)
    assert kv(t.latest()) == [(b"a", b"1")]
    spark.createDataFrame([(bytearray(b"x"), 9, 0, bytearray(b"y"))], "key binary, seq long, op tinyint, value binary").write.parquet(f"{full}/data/folder=more")
    with pytest.raises(Corruption):
        t.restore(inc)


def test_strategies_drive_compaction(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", Config(level0_trigger=2, level0_stop=3))
    for i in range(3):
        s.write_batch([(b"k%d" % (i % 2), b"%d" % i), (b"gone", None if i == 2 else b"x")])
    with pytest.raises(WriteStalled):
        s.put(b"more", b"")
    assert s.run_compactions() == 1 and [(r["level"], r["num_keys"]) for r in s._state()["runs"]] == [(1, 2)]
    assert kv(s.latest()) == [(b"k0", b"2"), (b"k1", b"1")]
    p = s.properties().first()
    assert (p.compactions, p.dropped_entries, p.live_keys, p.live_bytes, p.tombstones) == (1, 4, 2, 6, 0)
    s.delete(b"k0")
    s.delete(b"nope")
    s.set_strategy("tiered")
    assert s.compact_step() is False  # three runs, four make a merge
    s.put(b"z", b"")
    assert s.run_compactions() == 1 and kv(s.latest()) == [(b"k1", b"1"), (b"z", b"")]
    s.set_strategy("fifo")
    s.put(b"y", b"")
    s.config.fifo_bytes = s._state()["runs"][-1]["size"]
    assert s.run_compactions() == 1 and kv(s.latest()) == [(b"y", b"")]


def test_checksums_and_hashes_of_many():
    rng = random.Random(5)
    parts = [rng.randbytes(rng.choice([0, 1, 3, 4, 5, 40, 300])) for _ in range(60)] + [rng.randbytes(3000)]
    assert bytecodes.crc32c_many(parts).tolist() == [bytecodes.crc32c_of(p) for p in parts]
    assert bytecodes.bloom_hashes(parts).tolist() == [bytecodes.bloom_hash(p) for p in parts]
    assert bytecodes.crc32c_many([]).tolist() == [] and bytecodes.crc32c_many([b"123456789"]).tolist() == [0xE3069283]


def test_table_file_bytes(spark, tmp_path):
    one = tablefiles.build([(b"k", 7, 0, b"v")])
    # by hand: type, key length, value length, sequence number, key, value; one restart at 0
    entry = bytes([0]) + b"\x01\0\0\0" + b"\x01\0\0\0" + b"\x07" + bytes(7) + b"kv"
    block = entry + bytes(4) + b"\x01\0\0\0"
    assert one.startswith(block + bytecodes.crc32c_of(block).to_bytes(4, "little"))
    assert one[-8:] == b"LBTdipaR" and one[-16:-8] == b"\x01" + bytes(7) and tablefiles.index_of(one) == [(b"k", 0, len(block) + 4)]
    assert bytecodes.bloom_may_contain(tablefiles.filter_of(one), b"k")
    entries = [(b"key%05d" % (i // 2), 5000 - i, i % 3 == 0, None if i % 3 == 0 else b"x" * (i % 50)) for i in range(3000)]
    data = tablefiles.build([(k, s, int(o), v) for k, s, o, v in entries])
    assert [(k, s, bool(o), v) for (k, s, o, v), _ in tablefiles.read(data)] == entries and len(tablefiles.index_of(data)) > 10
    broken = bytearray(data)
    broken[20] ^= 1
    got = list(tablefiles.read(bytes(broken)))
    assert got[0] == (None, "bad checksum") and len(got) > 2000
    (tmp_path / "000012.sst").write_bytes(bytes(broken))
    (tmp_path / "000013.sst").write_bytes(b"nothing")
    (tmp_path / "000014.sst").write_bytes(tablefiles.build([]))
    rows = tablefiles.read_tables(spark, str(tmp_path))
    assert {(r.file_num, r.problem) for r in rows.where("problem is not null").collect()} == {(12, "bad checksum"), (13, "short footer")}


def test_manifest_bytes(spark):
    edits = [
        manifests.Edit("bytewise", 1, 5, 9, [], [(0, 2, 100, b"a", b"c", 1, 4, 4), (0, 3, 50, b"b", b"d", 5, 9, 5)]),
        manifests.Edit(last_seq=12, next_file=6, deleted=[(0, 2)], added=[(1, 4, 70, b"a" * 40_000, b"z", 1, 12, 6)]),
    ]
    data = manifests.write_manifest(edits)
    assert list(manifests.read_manifest(data)) == edits
    assert data[9:22] == b"\x01\x08\0\0\0bytewise"
    rows = manifests.edit_rows(spark.createDataFrame([(bytearray(data),)], "content binary"))
    assert sorted(map(tuple, compaction.fold_edits(rows.where("file_num is not null")).collect())) == [(3, 0), (4, 1)]
    assert tuple(compaction.counters(rows).first()) == (6, 12, 1)
    with pytest.raises(Corruption):
        list(manifests.read_manifest(data[:-1]))


def test_token_bucket_surface():
    b = limits.TokenBucket(2, 4)
    assert b.allow(0, 4) and b.reserve(0) == 0.5 and b.reserve(250_000) == 0.25 and b.limit == 4 and b.reset_at() == 2_000_000
    assert b.wait(250_000) == 0.25 and b.remaining() == 0
    b.set_rate(10, 500_000)
    assert b.available(600_000) == pytest.approx(1)
    b.set_burst(0.5, 600_000)
    assert b.remaining() == 0.5
    b.reset(600_000)
    assert b.remaining() == 0.5 and not b.allow(600_000)


def test_files_for_keys_without_files_and_with_ties(spark):
    files = spark.createDataFrame([(i, b"%02d" % (i % 40), b"%02d" % (i % 40 + i % 3)) for i in range(300)], "file_num long, min_key binary, max_key binary")
    asked = spark.createDataFrame([(b"%02d" % i,) for i in range(50)] + [(b"",), (b"\xff",)], "key binary")
    want = {(k.key, f.file_num) for k in asked.collect() for f in files.collect() if f.min_key <= k.key <= f.max_key}
    got = [(r.key, r.file_num) for r in compaction.files_for_keys(files, asked, cells=8).collect()]
    assert set(got) == want and len(got) == len(want)
    assert compaction.files_for_keys(files.limit(0), asked).count() == 0


def test_leveled_pick_by_size_passes_over_a_full_level_0(spark):
    rows = [(i, 0, 10, "a", "z") for i in range(1, 5)] + [(5, 1, 900, "d", "f"), (6, 1, 900, "b", "c"), (7, 2, 400, "c", "e"), (8, 2, 400, "x", "y")]
    files = spark.createDataFrame(rows, "file_num long, level int, size long, min_key string, max_key string")
    tasks = lambda df: sorted(map(tuple, df.collect()))
    by_size = [(6, 1, "input", 2), (7, 2, "overlap", 2)]
    for trigger in (4, 5):
        assert tasks(compaction.Leveled(trigger=trigger, base=1000).pick_by_size(files)) == by_size
    assert tasks(compaction.Leveled(trigger=5, base=1000).pick(files)) == by_size
    assert tasks(compaction.Leveled(trigger=4, base=1000).pick(files)) == [(i, 0, "input", 1) for i in range(1, 5)] + [(5, 1, "overlap", 1), (6, 1, "overlap", 1)]
    assert tasks(compaction.Leveled(trigger=4, base=1800).pick_by_size(files)) == []


def test_leveled_pick_by_size_of_many_files(spark, tmp_path):
    """More level-0 files than the query's trigger of 100 (one event in each of 303 files), against its SQL."""
    import duckdb

    from deltagrove.plans import catalog

    events = spark.range(303).select((F.col("id") * 1000).alias("event_id"), (F.col("id") * 7 % 50).alias("user_id"), F.lit("view").alias("event_type"), F.lit("{}").alias("props"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()["leveled_pick_by_size"]).fetchall())
    assert want and sorted(map(tuple, catalog.queries()["leveled_pick_by_size"](spark, str(tmp_path)).collect())) == want


def test_gauges_without_labels(spark):
    m = spark.createDataFrame([(1, "inc", None), (2, "set", 5.0), (3, "dec", None), (4, "add", 2.5)], "ord long, move string, amount double")
    assert stats.gauge_moves(m, [], "ord").first().value == 6.5 and stats.gauge_moves(m.where("ord = 1"), [], "ord").first().value == 1.0


def test_command_line(spark, tmp_path, capsys):
    at, copies = f"file://{tmp_path}/s", f"file://{tmp_path}/copies"
    run = lambda *a: main([at, *a], spark)
    assert run("ping") == run("set", "a", "1") == run("put", "b", "2") == run("del", "a") == 0
    assert run("backup", f"{copies}/one") == run("set", "c", "3") == run("backup", f"{copies}/two", f"{copies}/one") == 0
    capsys.readouterr()
    assert run("backups", copies) == 0
    assert [x.split("\t")[1:] for x in capsys.readouterr().out.split("\n")[:-1]] == [["full", "3", "3"], [f"{copies}/one", "4", "1"]]
    assert run("levels") == run("sstables") == run("flush") == run("info") == run("stats") == run("compact") == 0
    with pytest.raises(StoreError):
        Store(spark, at).delete_backup(copies, f"{copies}/one")
    Store(spark, at).delete_backup(copies, f"{copies}/two")
    assert len(Store(spark, at).backups(copies)) == 1 and Store(spark, at).get(b"c") == b"3"
