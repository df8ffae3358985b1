"""A store in a folder: an append-only log in Parquet, one run a write, and a catalog of versions.

log/commit=N-id holds a run of rows, sorted by key, with bloom filters on it. A version is there once its file
_catalog/N.json is; it is published by a rename or link that fails where the name is taken, so of two writers of one version
one gets WriteStalled. The catalog lists the live runs with level, size, key and sequence bounds: what the compaction
strategies choose from. _snapshots/N.json holds an open snapshot, for all processes."""

from __future__ import annotations

import json
import threading
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import STRATEGIES, Config
from .operators import compaction, views
from .operators.sequence import numbered
from .schema import DELETE, FILES, LOG, PUT, Corruption, InvalidKey, JobRunning, SnapshotReleased, StoreError, WriteStalled, problem
from .sources import transfer

_EMPTY = {"version": 0, "runs": [], "last_seq": 0, "next_run": 1, "compactions": 0, "compacted_in": 0, "compacted_out": 0, "dropped_entries": 0}


class Snapshot:
    """A sequence number that compactions respect until it is released; one found by id in another process is the same."""

    def __init__(self, store: Store, snapshot_id: int, seq: int) -> None:
        self.store, self.id, self.seq = store, snapshot_id, seq

    @property
    def released(self) -> bool:
        return not self.store._exists(f"_snapshots/{self.id:012d}.json")

    def view(self) -> DataFrame:
        if self.released:
            raise SnapshotReleased(f"snapshot {self.id}")
        return views.as_of(self.store.log(), self.seq)

    def get(self, key: bytes) -> bytes | None:
        if self.released:
            raise SnapshotReleased(f"snapshot {self.id}")
        return self.store.get(key, self.seq)

    def release(self) -> None:
        """Releasing one twice does nothing."""
        self.store._fs.delete(self.store._path(f"{self.store.path}/_snapshots/{self.id:012d}.json"), False)


class Store:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None) -> None:
        self.spark, self.path, self.config = spark, path.rstrip("/"), (config or Config()).validate()
        self._job = threading.Lock()
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- small files ---------------------------------------------------------------------------------------------------------

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _load(self, path: str) -> dict:
        return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(self._opened(path), "UTF-8"))

    def _opened(self, path: str):
        at = self._path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).open(at)

    def _publish(self, name: str, content: dict) -> bool:
        """Writes a small file whole or not at all; False if the name is taken."""
        part, at = self._path(f"{self.path}/{name}.{uuid.uuid4().hex}.tmp"), self._path(f"{self.path}/{name}")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # a rename here would replace
                files = self._jvm.java.nio.file.Files
                files.createLink(self._jvm.java.io.File(at.toUri().getPath()).toPath(), self._jvm.java.io.File(part.toUri().getPath()).toPath())
            else:
                none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(part, at, none)
        except Exception:
            if self._fs.exists(at):
                return False
            raise
        finally:
            self._fs.delete(part, False)
        return True

    # -- the catalog -------------------------------------------------------------------------------------------------------

    def _state(self) -> dict:
        names = [n for n in self._names("_catalog") if n.endswith(".json")]
        return self._load(f"{self.path}/_catalog/{names[-1]}") if names else dict(_EMPTY)

    def _commit(self, old: dict, **new) -> None:
        """Publishes the version after old."""
        state = {**old, **new, "version": old["version"] + 1}
        if not self._publish(f"_catalog/{state['version']:012d}.json", state):
            raise WriteStalled("another writer has made this version")

    def _run(self, state: dict, level: int, write) -> dict | None:
        """Writes a run by write(path) and gives its entry; none if it came out empty."""
        folder = f"commit={state['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.path}/log/{folder}"
        write(path)
        rows = self.spark.read.schema(LOG).parquet(path)
        r = rows.agg(F.hex(F.min("key")).alias("min_key"), F.hex(F.max("key")).alias("max_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count("*").alias("num_keys")).first()
        if not r.num_keys:
            return None
        size = self._fs.getContentSummary(self._path(path)).getLength()
        return {"file_num": state["next_run"], "folder": folder, "level": level, "size": size, "created_at": time.time(), **r.asDict()}

    def log(self) -> DataFrame:
        return self._read([r["folder"] for r in self._state()["runs"]])

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*(f"{self.path}/log/{f}" for f in folders))

    def files(self, state: dict | None = None) -> DataFrame:
        """The live runs as a catalog of files, a row a run."""
        runs = (state or self._state())["runs"]
        key = lambda h: bytearray.fromhex(h)
        rows = [(r["file_num"], r["level"], r["size"], key(r["min_key"]), key(r["max_key"]), r["min_seq"], r["max_seq"], r["num_keys"], datetime.fromtimestamp(r["created_at"], timezone.utc)) for r in runs]
        return self.spark.createDataFrame(rows, FILES)

    @property
    def last_seq(self) -> int:
        return self._state()["last_seq"]

    # -- writes ------------------------------------------------------------------------------------------------------------

    def stalled(self, state: dict | None = None) -> bool:
        """Whether the strategy's stop limit is reached: level-0 runs (leveled), runs in all (the others)."""
        runs = (state or self._state())["runs"]
        if self.config.strategy == "leveled":
            return sum(r["level"] == 0 for r in runs) >= self.config.level0_stop
        return len(runs) >= self._strategy().stop

    def write(self, rows: DataFrame, order: str | None = None) -> int:
        """rows: key, op, value; one run with consecutive numbers by order (else by key). Gives the last number."""
        state = self._state()
        if self.stalled(state):
            raise WriteStalled("too many runs; compact first")
        bad = rows.where(problem(F.col("key"), F.col("value")).isNotNull()).limit(1).collect()
        if bad:
            raise InvalidKey("a key or value is out of bounds")
        new = numbered(rows, [F.col(order)] if order else [F.col("key"), F.col("op"), F.col("value")], "seq", state["last_seq"] + 1)
        new = new.select("key", F.col("seq").cast("long").alias("seq"), F.col("op").cast("tinyint").alias("op"), "value")
        run = self._run(state, 0, lambda path: transfer.write_table(new, path, self.config.rows_per_file))
        if run is None:
            return state["last_seq"]
        self._commit(state, runs=[*state["runs"], run], last_seq=run["max_seq"], next_run=state["next_run"] + 1)
        return run["max_seq"]

    def _rows(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame([(i, bytearray(k), op, None if v is None else bytearray(v)) for i, (k, op, v) in enumerate(rows)], "ord long, key binary, op tinyint, value binary")

    def write_batch(self, entries: list[tuple[bytes, bytes | None]]) -> int:
        """(key, value) in order; a value of None deletes."""
        return self.write(self._rows([(k, DELETE if v is None else PUT, v) for k, v in entries]), "ord")

    def put(self, key: bytes, value: bytes) -> int:
        return self.write_batch([(key, value)])

    def delete(self, key: bytes) -> int:
        return self.write_batch([(key, None)])

    def delete_range(self, lower: bytes, upper: bytes) -> int:
        if not lower or not upper or lower >= upper:
            raise InvalidKey("a range needs both keys, the first below the second")
        rows = views.range_tombstones(self.log(), lower, upper)
        n = rows.count()
        if n:
            self.write(rows)
        return n

    # -- reads -------------------------------------------------------------------------------------------------------------

    def get(self, key: bytes, seq: int | None = None) -> bytes | None:
        if not key:
            raise InvalidKey("empty key")
        row = views.get(self.log(), bytearray(key), seq).first()
        return None if row is None else bytes(row["value"])

    def has(self, key: bytes) -> bool:
        return self.get(key) is not None

    def scan(self, lower: bytes | None = None, upper: bytes | None = None, prefix: bytes | None = None, seq: int | None = None) -> DataFrame:
        return views.scan(self.log(), lower, upper, prefix, seq).select("key", "value").orderBy("key")

    def latest(self, view: str | None = None) -> DataFrame:
        """The live rows; with a name, also as a view for SQL."""
        out = views.latest(self.log()).select("key", "value", "seq")
        if view:
            out.createOrReplaceTempView(view)
        return out

    # -- snapshots ---------------------------------------------------------------------------------------------------------

    def snapshot(self) -> Snapshot:
        """Pins the present number. A version published between its reading and the pin means another try, so a compaction
        that began before either sees the pin or has this number as its newest."""
        while True:
            state = self._state()
            names = self._names("_snapshots")
            n = 1 + max((int(x.split(".")[0]) for x in names), default=0)
            if not self._publish(f"_snapshots/{n:012d}.id", {}):
                continue
            self._publish(f"_snapshots/{n:012d}.json", {"id": n, "seq": state["last_seq"]})
            s = Snapshot(self, n, state["last_seq"])
            if self._state()["version"] == state["version"]:
                return s
            s.release()

    def open_snapshot(self, snapshot_id: int) -> Snapshot:
        name = f"_snapshots/{snapshot_id:012d}.json"
        if not self._exists(name):
            raise SnapshotReleased(f"snapshot {snapshot_id}")
        return Snapshot(self, snapshot_id, self._load(f"{self.path}/{name}")["seq"])

    def active_snapshots(self) -> list[Snapshot]:
        return [self.open_snapshot(int(n[:-5])) for n in self._names("_snapshots") if n.endswith(".json")]

    def oldest_seq(self) -> int:
        """Of the open snapshots; the present number if there is none."""
        return min((s.seq for s in self.active_snapshots()), default=self.last_seq)

    # -- upkeep ------------------------------------------------------------------------------------------------------------

    def set_strategy(self, name: str) -> None:
        if name not in STRATEGIES:
            raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")
        self.config.strategy = name

    def _strategy(self):
        c = self.config
        return {
            "leveled": lambda: compaction.Leveled(c.level0_trigger, c.level0_stop, c.level_base_bytes, c.level_ratio),
            "tiered": lambda: compaction.Tiered(least=c.tier_least, most=c.tier_most, ratio=c.tier_ratio),
            "fifo": lambda: compaction.Fifo(c.fifo_bytes, c.fifo_ttl_seconds),
        }[c.strategy]()

    def _merge(self, state: dict, chosen: set[int], level: int) -> None:
        """Makes the chosen runs one run of a level. Tombstones go only if no other run overlaps their keys."""
        old = [r for r in state["runs"] if r["file_num"] in chosen]
        rest = [r for r in state["runs"] if r["file_num"] not in chosen]
        low, high = min(r["min_key"] for r in old), max(r["max_key"] for r in old)  # hex keeps the order of bytes
        bottom = not any(r["min_key"] <= high and r["max_key"] >= low for r in rest)
        active = [s.seq for s in self.active_snapshots()]
        run = self._run(state, level, lambda path: compaction.compact(self._read([r["folder"] for r in old]), active, path, bottom, self.config.rows_per_file))
        entries, size = sum(r["num_keys"] for r in old), sum(r["size"] for r in old)
        self._commit(
            state,
            runs=[*rest, *([run] if run else [])],
            next_run=state["next_run"] + 1,
            compactions=state["compactions"] + 1,
            compacted_in=state["compacted_in"] + size,
            compacted_out=state["compacted_out"] + (run["size"] if run else 0),
            dropped_entries=state["dropped_entries"] + entries - (run["num_keys"] if run else 0),
        )

    def compact_step(self) -> bool:
        """One compaction as the strategy chooses; False if nothing is to be done. What it reads of the choice is a row a run."""
        state = self._state()
        files, strategy = self.files(state), self._strategy()
        if self.config.strategy == "fifo":
            now = F.lit(datetime.now(timezone.utc))
            late = strategy.expired(files, now).select("file_num")
            gone = {r.file_num for r in late.unionByName(strategy.excess(files).select("file_num")).distinct().collect()}
            if gone:
                dropped = [r for r in state["runs"] if r["file_num"] in gone]
                self._commit(state, runs=[r for r in state["runs"] if r["file_num"] not in gone], compactions=state["compactions"] + 1, compacted_in=state["compacted_in"] + sum(r["size"] for r in dropped), dropped_entries=state["dropped_entries"] + sum(r["num_keys"] for r in dropped))
            return bool(gone)
        picked = strategy.pick(files).collect()
        if not picked:
            return False
        level = picked[0].target_level if self.config.strategy == "leveled" else 0
        self._merge(state, {r.file_num for r in picked}, level)
        return True

    def run_compactions(self, most: int = 1000) -> int:
        """Steps until there is no more work; gives their number."""
        for n in range(most):
            if not self.compact_step():
                return n
        raise StoreError(f"compaction goes on after {most} steps")

    def compact(self) -> None:
        """Makes the whole log one run of the last level; what an open snapshot sees stays."""
        state = self._state()
        if state["runs"]:
            self._merge(state, {r["file_num"] for r in state["runs"]}, compaction.LEVELS - 1 if self.config.strategy == "leveled" else 0)

    def flush(self) -> int:
        """Writes are there when they return, so this only gives the last number."""
        return self.last_seq

    def import_rows(self, rows: DataFrame) -> int:
        """One import at a time in a process."""
        if not self._job.acquire(blocking=False):
            raise JobRunning("an import is running")
        try:
            return self.write(rows.select(F.col("key").cast("binary").alias("key"), F.lit(PUT).cast("tinyint").alias("op"), F.col("value").cast("binary").alias("value")))
        finally:
            self._job.release()

    def export(self, **range_) -> DataFrame:
        return transfer.export_rows(self.log(), **range_)

    def backup(self, path: str, parent: str | None = None) -> DataFrame:
        """Copies the live runs at the present version, with a parent only those that its chain of backups lacks, and gives the
        listing (folder, name, size, mtime, checksum) of what was copied. Runs never change, so equal folders hold equal files.

        data/folder=X holds a run's rows, listing the copied files with SHA-256, manifest.json (last) the live runs and the
        parent."""
        state = self._state()
        held = {f for m in self._chain(parent) for f in m["copied"]} if parent else set()
        live = [r["folder"] for r in state["runs"]]
        new = [f for f in live if f not in held]
        rows = self._read(new).withColumn("folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2) if new else F.lit(""))
        rows.write.partitionBy("folder").option("parquet.bloom.filter.enabled#key", "true").parquet(f"{path}/data")
        transfer.listing(self.spark, f"{path}/data", "*.parquet").write.parquet(f"{path}/listing")
        manifest = {"path": path, "parent": parent, "version": state["version"], "last_seq": state["last_seq"], "runs": state["runs"], "copied": new, "created_at": time.time()}
        at = self._path(f"{path}/manifest.json")
        out = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return self.spark.read.parquet(f"{path}/listing")

    def backups(self, folder: str) -> list[dict]:
        """The manifests of the finished backups in a folder, by their start."""
        at = self._path(folder)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.globStatus(self._path(f"{folder.rstrip('/')}/*/manifest.json")) or []
        return sorted((self._load(f.getPath().toString()) for f in found), key=lambda m: m["created_at"])

    def delete_backup(self, folder: str, path: str) -> None:
        """Refused while another backup of the folder names it as its parent."""
        strip = lambda p: p.rstrip("/").split("/")[-1]
        if any(m["parent"] and strip(m["parent"]) == strip(path) for m in self.backups(folder)):
            raise StoreError(f"{path} is the parent of another backup")
        at = self._path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _chain(self, path: str) -> list[dict]:
        """The manifests of a backup and its parents, itself first."""
        out, seen = [], set()
        at: str | None = path
        while at:
            if at in seen:
                raise Corruption(f"the chain of {path} goes in a circle")
            seen.add(at)
            m = self._load(f"{at}/manifest.json")
            out.append({**m, "path": at})
            at = m["parent"]
        return out

    def verify_backup(self, path: str) -> None:
        """Raises Corruption if a file of the chain is missing, new or changed against its listing."""
        for m in self._chain(path):
            kept = self.spark.read.parquet(f"{m['path']}/listing").select("name", "size", "checksum")
            now = transfer.listing(self.spark, f"{m['path']}/data", "*.parquet").select("name", "size", "checksum")
            if kept.exceptAll(now).unionByName(now.exceptAll(kept)).limit(1).count():
                raise Corruption(f"the files of {m['path']} differ from its listing")

    def restore(self, path: str, seq: int | None = None, verify: bool = True) -> None:
        """Makes what a backup and its parents hold the log; with seq, as of that number."""
        if verify:
            self.verify_backup(path)
        chain = self._chain(path)
        home = {f: m["path"] for m in reversed(chain) for f in m["copied"]}
        live = [r["folder"] for r in chain[0]["runs"]]
        if lost := [f for f in live if f not in home]:
            raise Corruption(f"no backup of the chain holds {lost[0]}")
        rows = self.spark.read.schema(LOG).parquet(*(f"{home[f]}/data/folder={f.replace('=', '%3D')}" for f in live)) if live else self._read([])
        if seq is not None:
            rows = rows.where(F.col("seq") <= seq)
        state = self._state()
        run = self._run(state, 0, lambda p: transfer.write_table(rows, p, self.config.rows_per_file))
        last = chain[0]["last_seq"] if seq is None else min(seq, chain[0]["last_seq"])
        self._commit(state, runs=[run] if run else [], last_seq=last, next_run=state["next_run"] + 1)

    def properties(self) -> DataFrame:
        """One row: entries, tombstones, keys, live keys and their bytes, last number, runs, their bytes, snapshots, compactions."""
        state = self._state()
        newest = views.newest(self._read([r["folder"] for r in state["runs"]]).withColumn("_size", F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))))
        live = F.col("op") == PUT
        one = newest.agg(F.count("*").alias("keys"), F.count_if(live).alias("live_keys"), F.coalesce(F.sum(F.when(live, F.col("_size"))), F.lit(0)).alias("live_bytes"))
        log = self._read([r["folder"] for r in state["runs"]]).agg(F.count("*").alias("entries"), F.count_if(F.col("op") == DELETE).alias("tombstones"))
        return log.crossJoin(one).select(  # one row each
            "*",
            F.lit(state["last_seq"]).cast("long").alias("last_seq"),
            F.lit(len(state["runs"])).alias("runs"),
            F.lit(sum(r["size"] for r in state["runs"])).cast("long").alias("bytes"),
            F.lit(len(self.active_snapshots())).alias("snapshots"),
            *(F.lit(state[c]).cast("long").alias(c) for c in ("compactions", "compacted_in", "compacted_out", "dropped_entries")),
        )
