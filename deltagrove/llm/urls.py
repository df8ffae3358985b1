"""URL filters by host and path-prefix rules, as a sort-merge range join.

A host's canonical key is its labels in reverse order, each followed by a dot, so a rule for a host and its subdomains is
the interval of the keys that start with the rule's own key. Urls are dealt to ranges of (key, path), and each rule to all
ranges that its interval meets; a task then sweeps its sorted rules and urls together, with a stack of the nested rules whose
interval holds the current key. So a range has from its start the rules that opened before it, no task holds more rules than
are open at once, and a host with many urls has many ranges. The bounds of the ranges come from a sample of the urls; they
decide which task does what, never a result.

A null url, or one without "://", has an empty host and path and fits no rule. A rule fits when the path starts with the
rule's; the longest (host and path together, then host) wins; of equal rules the greatest verdict, as text. Rules with a null
host or path are left out, a null verdict gives the default. Urls of any length go whole. Repeated rows are judged each, extra columns
dropped. An empty table of urls gives no rows; without rules every url gets the default.
The id column may have any name but those of the other columns given (host, path, rule, verdict): that is an error.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Urls sampled for each range, and the longest part of a key or path that a bound keeps (a prefix is a bound as well).
SAMPLED, BOUND_CHARS = 20, 256
_AFTER_DOT = chr(ord(".") + 1)


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class _Sweep:
    """Takes rules and urls in key order, a key's rules first; the stack holds (key, rules by path, lengths of their paths)
    of those whose interval holds the key last seen."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def _close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, host: str, path: str, verdict: str | None) -> None:
        self._close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, rules, sizes = self.stack[-1]
        rules[path] = max(rules.get(path, (host + path, "")), (host + path, verdict or ""))
        if len(path) not in sizes:
            sizes.append(len(path))
            sizes.sort(reverse=True)

    def at(self, key: str, path: str) -> tuple[str | None, str | None]:
        self._close(key)
        best: tuple[str | None, str | None] = (None, None)
        for _, rules, sizes in reversed(self.stack):
            found = next((rules[path[:n]] for n in sizes if n <= len(path) and path[:n] in rules), None)
            if found and (best[0] is None or len(found[0]) > len(best[0])):
                best = found
        return best


def _bounds(urls: DataFrame, parts: int) -> list[tuple[str, str, int]]:
    """Where the ranges after the first begin, at most parts - 1. Collects about SAMPLED bounds a range."""
    share = min(1.0, SAMPLED * parts / max(1, urls.count()))
    cut = [F.substring(c, 1, BOUND_CHARS).alias(c) for c in ("_key", "path")]
    keys = sorted(map(tuple, urls.sample(share, seed=1).select(*cut, "_salt").collect()))
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", parts: int | None = None) -> DataFrame:
    """rules: host, path, verdict. Gives id, host, path, rule (null: none fits) and verdict. parts: ranges, by default the
    session's shuffle partitions."""
    if id_col in ("host", "path", "rule", "verdict", "_key"):
        raise ValueError(f"an id column called {id_col} would clash with a column of the result")
    parts = parts or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"), F.xxhash64(id_col, url_col).alias("_salt"))
    urls = urls.withColumn("_key", host_key(F.col("host")))
    ruled = rules.where("host is not null and path is not null").select("host", "path", "verdict", host_key(F.col("host")).alias("_key"))
    kind = pages.schema[id_col].dataType.simpleString()
    bounds = _bounds(urls, parts)

    def place_urls(batches):
        for b in batches:
            at = [bisect_right(bounds, x) for x in zip(b.column("_key").to_pylist(), b.column("path").to_pylist(), b.column("_salt").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(b.column(c) for c in ("_key", "_id", "host", "path"))], ["_part", "_key", "_id", "host", "path"])

    def place_rules(batches):
        for b in batches:
            rows, at = [], []
            for i, key in enumerate(b.column("_key").to_pylist()):
                met = range(bisect_right(bounds, (key,)), bisect_right(bounds, (key[:-1] + _AFTER_DOT,)) + 1)  # keys end with a dot
                rows += [i] * len(met)
                at += met
            own = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(own.column(c) for c in ("_key", "host", "path", "verdict"))], ["_part", "_key", "host", "path", "verdict"])

    def sweep(batches):
        state, part = _Sweep(), None
        for b in batches:
            urls_at, got = [], []
            columns = [b.column(c).to_pylist() for c in ("_part", "_key", "_url", "host", "path", "verdict")]
            for i, (p, key, is_url, host, path, verdict) in enumerate(zip(*columns, strict=True)):
                if p != part:
                    state, part = _Sweep(), p
                if is_url:
                    urls_at.append(i)
                    got.append(state.at(key, path))
                else:
                    state.open(key, host, path, verdict)
            own = b.take(pa.array(urls_at, pa.int64()))
            rule, verdict = pa.array([g[0] for g in got], pa.string()), pa.array([g[1] or default for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([own.column("_id"), own.column("host"), own.column("path"), rule, verdict], [id_col, "host", "path", "rule", "verdict"])

    placed = urls.mapInArrow(place_urls, f"_part int, _key string, _id {kind}, host string, path string").withColumn("_url", F.lit(True))
    sent = ruled.mapInArrow(place_rules, "_part int, _key string, host string, path string, verdict string").withColumn("_url", F.lit(False))
    both = placed.unionByName(sent, allowMissingColumns=True)
    dealt = both.repartitionById(parts, F.col("_part")).sortWithinPartitions("_part", "_key", "_url")
    return dealt.mapInArrow(sweep, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
