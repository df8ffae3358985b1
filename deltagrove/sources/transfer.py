"""Import and export: CSV, JSON Lines and table files; and backups as copies of file listings."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..keys import prefix_end
from ..operators.views import scan

MAX_LINE = 10 << 20


def read_csv(spark: SparkSession, path: str, header: bool = False, key_column: int = 0, value_column: int = 1, delimiter: str = ",", key_prefix: str = "", multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(key, value) rows, and the counts total, imported and failed. Quotes are doubled inside quotes; a row too short for
    the key or value column fails. Key and value column both 0 means value column 1."""
    if key_column == value_column == 0:
        value_column = 1
    width = max(key_column, value_column) + 1
    schema = ", ".join(f"c{i} string" for i in range(max(width, 2))) + ", _bad string"
    rows = spark.read.schema(schema).option("sep", delimiter).option("header", header).option("enforceSchema", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("emptyValue", "").csv(path)
    key, value = F.col(f"c{key_column}"), F.col(f"c{value_column}")
    # an empty field reads as null too; the row is short only if it was marked and lacks the delimiters
    there = value.isNotNull() | F.col("_bad").isNull() | (F.size(F.split("_bad", re.escape(delimiter))) > value_column)
    good = key.isNotNull() & (F.length(key) > 0) & there
    kept = rows.where(good).select(F.concat(F.lit(key_prefix), key).alias("key"), F.coalesce(value, F.lit("")).alias("value"))
    counts = rows.agg(F.count("*").alias("total"), F.count_if(good).alias("imported"), F.count_if(~good).alias("failed"))
    return kept, counts


def read_jsonl(spark: SparkSession, path: str, key_field: str = "key", value_field: str = "value", key_prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """(key, value) of JSON lines; blank lines don't count. Strings come unquoted, other values as their JSON text; a JSON
    null is the text null; a line without key or value fails."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    m = F.from_json("value", "map<string,string>")
    raw = lines.select(F.length("value").alias("_n"), F.element_at(F.coalesce(m, F.create_map().cast("map<string,string>")), key_field).alias("k"), F.coalesce(F.element_at(F.coalesce(m, F.create_map().cast("map<string,string>")), value_field), F.when(F.array_contains(F.map_keys(m), value_field), "null")).alias("v"))
    good = F.coalesce((F.length("k") > 0) & F.col("v").isNotNull() & (F.col("_n") <= MAX_LINE), F.lit(False))
    kept = raw.where(good).select(F.concat(F.lit(key_prefix), F.col("k")).alias("key"), F.col("v").alias("value"))
    return kept, raw.agg(F.count("*").alias("total"), F.count_if(good).alias("imported"), F.count_if(~good).alias("failed"))


def export_rows(log: DataFrame, prefix: str | None = None, start=None, end=None, limit: int = 0, seq: int | None = None) -> DataFrame:
    """Live rows in key order. Start and end go before what the prefix gives."""
    if prefix and not (start or end):
        rows = scan(log, prefix=prefix, seq=seq)
    else:
        last = prefix_end(prefix.encode()) if prefix else None
        rows = scan(log, start or prefix, end or (last.decode("utf-8", "surrogateescape") if last else None), seq=seq)
    out = rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")).orderBy("key")
    return out.limit(limit) if limit else out


def write_csv(rows: DataFrame, path: str, header: bool = False, delimiter: str = ",") -> None:
    rows.write.option("sep", delimiter).option("header", header).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.select("key", "value").write.json(path)


def write_table(rows: DataFrame, path: str, max_records: int = 0) -> None:
    """A table file folder: sorted, with bloom filters on keys."""
    w = rows.repartitionByRange("key").sortWithinPartitions("key", F.desc("seq")).write.option("parquet.bloom.filter.enabled#key", "true")
    (w.option("maxRecordsPerFile", max_records) if max_records else w).parquet(path)


def import_tables(spark: SparkSession, path: str, first_number: int) -> DataFrame:
    """The catalog rows of a folder's table files, numbered in name order from first_number. One row for each file."""
    from pyspark.sql import Window

    rows = spark.read.parquet(path).select("key", "seq", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"))
    files = rows.groupBy("name").agg(F.max("size").alias("size"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count("*").alias("num_keys"))
    return files.withColumn("file_num", F.row_number().over(Window.orderBy("name")) + (first_number - 1)).withColumn("level", F.lit(0))


def import_stats(rows: DataFrame, per_row: int = 3) -> DataFrame:
    """records and bytes (key, value and so many more for each: 3 for CSV, 20 for JSON)."""
    return rows.agg(F.count("*").alias("records"), F.sum(F.octet_length("key") + F.octet_length("value") + per_row).cast("long").alias("bytes"))


# -- backups ---------------------------------------------------------------------------------------------------------------

LISTING = ("name", "size", "mtime")


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """name, size, mtime and SHA-256 of the files below a path."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("checksum"))


def incremental(current: DataFrame, parent: DataFrame) -> DataFrame:
    """The files that the parent doesn't have as they are."""
    return current.join(parent.select(*LISTING), list(LISTING), "left_anti")


def parent_of(backups: DataFrame, backup_id: str | None = None) -> DataFrame:
    """The given backup, or the last completed full one. backups: id, kind, status, parent_id, start_time."""
    if backup_id:
        return backups.where(F.col("id") == backup_id)
    return backups.where("kind = 'full' and status = 'completed'").orderBy(F.desc("start_time"), F.desc("id")).limit(1)


def chain(backups: DataFrame, backup_id: str) -> DataFrame:
    """A backup and its parents, the base at depth 0. A loop of self-joins over one row each."""
    at = backups.where(F.col("id") == backup_id).select("id", "parent_id", F.lit(0).alias("up"))
    out, n = at, 0
    while at.where("parent_id is not null").limit(1).count():
        n += 1
        at = at.select(F.col("parent_id").alias("id")).join(backups.select("id", "parent_id"), "id").withColumn("up", F.lit(n))
        out = out.unionByName(at)
        if n > 1000:
            raise ValueError("a chain of backups goes in a circle")
    return out.select("id", "parent_id", (F.lit(n) - F.col("up")).alias("depth"))


def restored(chain_files: DataFrame) -> DataFrame:
    """chain_files: depth, name and more. Of each name the file of the deepest backup that has it."""
    from pyspark.sql import Window

    w = Window.partitionBy("name").orderBy(F.desc("depth"))
    return chain_files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def overall_checksum(files: DataFrame) -> DataFrame:
    """SHA-256 over name and checksum of each file in name order; a catalog is a row a file."""
    parts = F.array_sort(F.collect_list(F.struct("name", "checksum")))
    joined = F.array_join(F.transform(parts, lambda x: F.concat(x["name"], x["checksum"])), "")
    return files.agg(F.sha2(joined.cast("binary"), 256).alias("checksum"), F.count("*").alias("files"))


def deletable(backups: DataFrame) -> DataFrame:
    """Backups that no other names as its parent."""
    return backups.join(backups.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct(), "id", "left_anti")


def backend_url(url):
    """scheme, bucket and path of a backend's URL; without a scheme it is a local path."""
    has = url.contains("://")
    rest = F.regexp_extract(url, r"^[a-z0-9+.-]+://(.*)$", 1)
    scheme = F.when(has, F.regexp_extract(url, r"^([a-z0-9+.-]+)://", 1)).otherwise("file")
    remote = has & (scheme != "file")
    return F.struct(scheme.alias("scheme"), F.when(remote, F.regexp_extract(rest, "^[^/]*", 0)).alias("bucket"), F.when(remote, F.regexp_extract(rest, "^[^/]*/?(.*)$", 1)).when(has, rest).otherwise(url).alias("path"))


def new_id() -> str:
    return uuid.uuid4().hex
