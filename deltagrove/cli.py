"""python -m deltagrove.cli PATH COMMAND [ARGS]: get, put (set), delete (del, rm), scan (keys), stats, ping, info, flush, compact,
levels, sstables, import-csv, import-json, export-csv, export-json, backup TO [PARENT], backups DIR, restore FROM."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import compaction
from .sources import transfer
from .store import Store


COMMANDS = "get put delete scan stats ping info flush compact levels sstables import-csv import-json export-csv export-json backup backups restore".split()
ALIASES = {"set": "put", "del": "delete", "rm": "delete", "keys": "scan"}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="deltagrove", description=__doc__)
    p.add_argument("path")
    p.add_argument("command", choices=(*COMMANDS, *ALIASES))
    p.add_argument("args", nargs="*")
    p.add_argument("--prefix")
    p.add_argument("--limit", type=int, default=100)
    a = p.parse_args(args)
    a.command = ALIASES.get(a.command, a.command)
    spark = spark or SparkSession.builder.getOrCreate()
    s = Store(spark, a.path)
    x = [v.encode() for v in a.args]
    if a.command == "get":
        got = s.get(x[0])
        print("NOT FOUND" if got is None else got.decode("utf-8", "replace"))
        return int(got is None)
    if a.command == "put":
        print(s.put(x[0], x[1]))
    elif a.command == "delete":
        print(s.delete(x[0]))
    elif a.command == "scan":
        for k, v in s.scan(*x[:2], prefix=a.prefix.encode() if a.prefix else None).limit(a.limit).collect():
            print(bytes(k).decode("utf-8", "replace"), bytes(v).decode("utf-8", "replace"), sep="\t")
    elif a.command == "stats":
        print(s.properties().first().asDict())
    elif a.command == "ping":
        print("PONG")
    elif a.command == "info":
        print(s.config.to_json())
    elif a.command == "flush":
        print(s.flush())
    elif a.command == "compact":
        s.compact()
    elif a.command == "levels":
        c = s.config
        for r in compaction.level_stats(s.files(), c.level0_trigger, c.level_base_bytes, c.level_ratio).orderBy("level").collect():  # a row a level
            print(r.level, r.files, r.size, r.target, f"{r.score:.2f}", sep="\t")
    elif a.command == "sstables":
        for r in s.files().orderBy("level", "file_num").limit(a.limit).collect():
            print(r.file_num, r.level, r.size, r.num_keys, bytes(r.min_key).decode("utf-8", "replace"), bytes(r.max_key).decode("utf-8", "replace"), sep="\t")
    elif a.command.startswith("import"):
        read = transfer.read_csv if a.command == "import-csv" else transfer.read_jsonl
        rows, counts = read(spark, a.args[0])
        s.import_rows(rows)
        print(counts.first().asDict())
    elif a.command.startswith("export"):
        rows = s.export(prefix=a.prefix, limit=0)
        (transfer.write_csv if a.command == "export-csv" else transfer.write_jsonl)(rows, a.args[0])
    elif a.command == "backup":
        print(s.backup(*a.args).count())
    elif a.command == "backups":
        for m in s.backups(a.args[0]):
            print(m["path"], m["parent"] or "full", m["last_seq"], len(m["copied"]), sep="\t")
    elif a.command == "restore":
        s.restore(a.args[0])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
