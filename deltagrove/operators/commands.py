"""The command protocol: parsing lines, conditional writes in bulk, and the ordered fold of commands key by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fnv1a
from ..schema import MAX_PROTOCOL_VALUE, PROTOCOL_KEY

STORAGE = ("set", "add", "replace", "append", "prepend", "cas")


def parse(lines: DataFrame, column: str = "line") -> DataFrame:
    """name, keys, flags, exptime, bytes, cas, delta, noreply and error of each command line."""
    words = F.split(F.trim(F.col(column)), r" +")
    n = F.size(words)
    at = lambda i: F.try_element_at(words, F.lit(i))
    name = F.lower(at(1))
    noreply = (F.element_at(words, -1) == "noreply") & (n > 1)
    n_args = n - noreply.cast("int")
    number = lambda i, kind="long": F.when(at(i).rlike("^[0-9]+$"), at(i).try_cast(kind))
    storage, counter = name.isin(*STORAGE), name.isin("incr", "decr")
    need = F.when(name == "cas", 6).when(storage, 5).when(counter | (name == "touch"), 3).when(name.isin("get", "gets", "delete"), 2).otherwise(1)
    keys = F.when(name.isin("get", "gets"), F.slice(words, 2, F.greatest(n_args - 1, F.lit(0)))).when(storage | counter | name.isin("delete", "touch"), F.slice(words, 2, 1)).otherwise(F.array().cast("array<string>"))
    known = name.isin(*STORAGE, "get", "gets", "delete", "incr", "decr", "touch", "flush_all", "stats", "version", "verbosity", "quit")
    size = F.when(storage, number(5, "int"))
    bad_key = F.exists(keys, lambda k: ~k.rlike(PROTOCOL_KEY))
    error = (
        F.when(~known | name.isNull(), "ERROR")
        .when(n_args < need, "ERROR")
        .when(bad_key, "CLIENT_ERROR bad key")
        .when(storage & (number(3).isNull() | size.isNull()), "CLIENT_ERROR bad command line format")
        .when(size > MAX_PROTOCOL_VALUE, "SERVER_ERROR object too large for cache")
        .when(counter & number(3, "decimal(20,0)").isNull(), "CLIENT_ERROR invalid numeric delta argument")
    )
    return lines.select(
        "*",
        name.alias("name"),
        keys.alias("keys"),
        F.when(storage, number(3)).alias("flags"),
        F.when(storage, number(4)).when(name == "touch", number(3)).alias("exptime"),
        size.alias("bytes"),
        F.when(name == "cas", number(6, "decimal(20,0)")).alias("cas"),
        F.when(counter, number(3, "decimal(20,0)")).alias("delta"),
        noreply.alias("noreply"),
        error.alias("error"),
    )


def data_blocks(stream: bytes, most: int = MAX_PROTOCOL_VALUE) -> Iterator[tuple[str, bytes | None, str | None]]:
    """The lines of one connection's bytes, with the data block behind a storage line, or an error. A block must end with CRLF;
    one too large is passed over."""
    at = 0
    while at < len(stream):
        end = stream.find(b"\n", at)
        end = len(stream) if end < 0 else end
        line = stream[at:end].removesuffix(b"\r").decode("utf-8", "replace")
        at = end + 1
        words = line.split()
        if not words:
            return  # an empty line ends the input
        if words[0].lower() not in STORAGE or len(words) < 5 or not (words[4].isascii() and words[4].isdigit()):
            yield line, None, None
            continue
        size = int(words[4])
        data, close = stream[at : at + size], stream[at + size : at + size + 2]
        at += size + 2
        if size > most:
            yield line, None, "SERVER_ERROR object too large for cache"
        elif len(data) < size or close != b"\r\n":
            yield line, None, "CLIENT_ERROR bad data chunk"
        else:
            yield line, data, None


def read_connections(connections: DataFrame) -> DataFrame:
    """connections: conn, stream (binary). The parsed commands of each, numbered by ord, with their data. A connection's bytes
    are one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(c, i, *x) for c, s in zip(pdf["conn"], pdf["stream"], strict=True) for i, x in enumerate(data_blocks(bytes(s or b"")))]
            yield pd.DataFrame(rows, columns=["conn", "ord", "line", "data", "chunk_error"])

    lines = connections.select("conn", "stream").mapInPandas(run, f"conn {connections.schema['conn'].dataType.simpleString()}, ord long, line string, data binary, chunk_error string")
    return parse(lines).withColumn("error", F.coalesce("error", "chunk_error")).drop("chunk_error")


def value_reply(key, flags, data, cas=None):
    """VALUE with flags, length in bytes and, if given, the token; then the data, each ended by CRLF. END follows the last."""
    words = [F.lit("VALUE"), key, F.coalesce(flags, F.lit(0)).cast("string"), F.octet_length(data).cast("string"), *([cas.cast("string")] if cas is not None else [])]
    return F.concat(F.concat_ws(" ", *words), F.lit("\r\n"), data, F.lit("\r\n"))


def get_replies(asked: DataFrame, view: DataFrame, tokens: bool = False) -> DataFrame:
    """asked: request, pos, key (a key of a get line each). view: key, flags, value. The whole reply of each request: the keys
    that are there in the order asked, then END."""
    hit = asked.join(view, "key", "left")
    text = F.when(F.col("value").isNotNull(), value_reply(F.col("key"), F.col("flags"), F.col("value"), fnv1a(F.col("value")) if tokens else None))
    parts = F.array_sort(F.collect_list(F.struct("pos", text.alias("t"))))
    return hit.groupBy("request").agg(F.concat(F.array_join(F.transform(parts, lambda x: F.coalesce(x["t"], F.lit(""))), ""), F.lit("END\r\n")).alias("reply"))


def gets(view: DataFrame) -> DataFrame:
    """key, value and the compare-and-swap token."""
    return view.select("key", "value", fnv1a(F.coalesce("value", F.lit(""))).alias("cas"))


def add(view: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows that add stores: keys that aren't there."""
    return rows.join(view.select("key"), "key", "left_anti")


def replace(view: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.join(view.select("key"), "key", "left_semi")


delete = replace


def counter_fold(commands: DataFrame, limit: int = 1 << 64) -> DataFrame:
    """commands: key, ord, name (incr or decr), delta. A counter from 0: incr wraps at limit, decr stops at 0.

    Runs of increments are summed in the shuffle's partial aggregation; only the runs, one row between decrements, are
    folded in order."""
    w = Window.partitionBy("key").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    down = F.col("name") == "decr"
    runs = commands.withColumn("_run", F.sum(F.when(down, 1).otherwise(0)).over(w))
    wide = "decimal(38,0)"
    steps = runs.groupBy("key", "_run").agg(F.coalesce(F.sum(F.when(~down, F.col("delta"))), F.lit(0)).cast(wide).alias("up"), F.coalesce(F.max(F.when(down, F.col("delta"))), F.lit(0)).cast(wide).alias("down"))
    per = steps.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_run", "up", "down"))).alias("_s"))
    top = F.lit(str(limit)).cast(wide)
    step = lambda a, x: ((F.greatest(F.lit(0).cast(wide), a - x["down"]) + x["up"]) % top).cast(wide)
    return per.select("key", F.aggregate("_s", F.lit(0).cast(wide), step).cast("decimal(20,0)").alias("value"))


class State:
    """What a key holds while commands are applied to it."""

    __slots__ = ("value", "flags", "seq")

    def __init__(self, value: str | None = None, flags: int = 0, seq: int = 0) -> None:
        self.value, self.flags, self.seq = value, flags, seq


def token(value: str) -> int:
    h = 0xCBF29CE484222325
    for b in value.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


def apply(state: State, name: str, data: str | None, flags: int | None, delta: int | None, cas: int | None) -> str:
    """Applies one command to a key's state and gives the reply."""
    there = state.value is not None

    def store(value: str, new_flags: int | None) -> str:
        state.value, state.flags, state.seq = value, int(new_flags or 0), state.seq + 1
        return "STORED"

    if name == "set" or (name == "add" and not there) or (name == "replace" and there):
        return store(data or "", flags)
    if name in ("add", "replace"):
        return "NOT_STORED"
    if name in ("append", "prepend"):
        if not there:
            return "NOT_STORED"
        return store(state.value + (data or "") if name == "append" else (data or "") + state.value, state.flags)
    if name == "cas":
        if not there:
            return "NOT_FOUND"
        return store(data or "", flags) if token(state.value) == cas else "EXISTS"
    if name in ("delete", "touch", "incr", "decr") and not there:
        return "NOT_FOUND"
    if name == "delete":
        state.value, state.seq = None, state.seq + 1
        return "DELETED"
    if name == "touch":
        return "TOUCHED"
    if name in ("incr", "decr"):
        if not (state.value.isascii() and (state.value.isdigit() or state.value == "")):
            return "CLIENT_ERROR cannot increment non-numeric value"
        old = int(state.value or 0)
        new = (old + delta) % (1 << 64) if name == "incr" else max(0, old - delta)
        store(str(new), state.flags)
        return str(new)
    if name in ("get", "gets"):
        return f"VALUE {state.value}" if there else "END"
    return "ERROR"


FOLDED = "key string, ord bigint, name string, reply string"
COMMANDS = ("key", "ord", "name", "data", "flags", "delta", "cas")


def command_fold(commands: DataFrame) -> DataFrame:
    """The reply to each command, applied in order key by key. A key's commands come sorted, in Arrow batches, and pass
    through one after the other, so a key may have any number of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, State()
        for pdf in batches:
            replies = []
            for r in pdf.itertuples(index=False):
                if r.key != key:
                    key, state = r.key, State()
                whole = lambda x: None if pd.isna(x) else int(x)
                replies.append(apply(state, r.name, None if pd.isna(r.data) else r.data, whole(r.flags), whole(r.delta), whole(r.cas)))
            yield pd.DataFrame({"key": pdf["key"], "ord": pdf["ord"], "name": pdf["name"], "reply": replies})

    return commands.select(*COMMANDS).repartition("key").sortWithinPartitions("key", "ord").mapInPandas(run, FOLDED)


def stats(commands: DataFrame) -> DataFrame:
    """Counts by command, hits and misses. commands: name, hit."""
    c = lambda *names: F.count_if(F.col("name").isin(*names))
    read = F.col("name").isin("get", "gets")
    return commands.agg(c("get", "gets").alias("cmd_get"), c("set").alias("cmd_set"), c("delete").alias("cmd_delete"), c("incr", "decr").alias("cmd_counter"), F.count_if(read & F.col("hit")).alias("get_hits"), F.count_if(read & ~F.col("hit")).alias("get_misses"))


def unexpired(view: DataFrame, now) -> DataFrame:
    return view.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def flush_all(view: DataFrame) -> DataFrame:
    """A tombstone for every live key."""
    return view.select("key", F.lit(1).cast("tinyint").alias("op"), F.lit(None).cast("string").alias("value"))
