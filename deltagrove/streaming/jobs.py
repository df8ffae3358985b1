"""Structured Streaming forms: ingest into a log, command folds, limiters, windowed counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.commands import State, apply
from ..operators.limits import TokenBucket
from ..operators.views import append


def ingest(source: DataFrame, read_log: Callable[[], DataFrame], path: str, checkpoint: str, order: str = "ord"):
    """Appends each micro-batch (key, op, value, ord) to the log at path, one commit a batch. A batch that runs again after a
    failure overwrites its own folder, so entries are there once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        log = read_log()
        before = log.where(F.col("batch") < batch_id) if "batch" in log.columns else log
        base = before.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        columns = [c for c in before.columns if c != "batch"]
        rows = append(before.select(*columns).limit(0), batch, order, base)
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class CommandProcessor(StatefulProcessor):
    """Applies commands to a key's state, in the order of their numbers within a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "value string, flags bigint, seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        s = State(*self.state.get()) if self.state.exists() else State()
        pdf = pd.concat(rows).sort_values("ord")
        out = []
        for r in pdf.itertuples(index=False):
            whole = lambda x: None if pd.isna(x) else int(x)
            out.append((r.key, r.ord, r.name, apply(s, r.name, None if pd.isna(r.data) else r.data, whole(r.flags), whole(r.delta), whole(r.cas))))
        self.state.update((s.value, s.flags, s.seq))
        yield pd.DataFrame(out, columns=["key", "ord", "name", "reply"])

    def close(self) -> None:
        pass


def command_stream(commands: DataFrame) -> DataFrame:
    return commands.groupBy("key").transformWithStateInPandas(CommandProcessor(), "key string, ord bigint, name string, reply string", "Append", "none")


class LimitProcessor(StatefulProcessor):
    """A token bucket for each client, forgotten after some idle time."""

    def __init__(self, rate: float, burst: float, idle_ms: int) -> None:
        self.rate, self.burst, self.idle_ms = rate, burst, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens double, last bigint", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        b = TokenBucket(self.rate, self.burst)
        if self.state.exists():
            b.tokens, b.last = self.state.get()
        pdf = pd.concat(rows).sort_values(["us", "ord"])
        allowed = [b.allow(int(us)) for us in pdf["us"]]
        self.state.update((b.tokens, b.last))
        yield pd.DataFrame({"client": pdf["client"], "ord": pdf["ord"], "allowed": allowed})

    def close(self) -> None:
        pass


def limit_stream(requests: DataFrame, rate: float, burst: float, idle_ms: int = 300_000) -> DataFrame:
    """requests: client, ord, us (microseconds)."""
    return requests.groupBy("client").transformWithStateInPandas(LimitProcessor(rate, burst, idle_ms), "client string, ord bigint, allowed boolean", "Append", "processingTime")


def window_count_stream(events: DataFrame, window: str, late: str) -> DataFrame:
    """Counts by event time; what is later than `late` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.count("*").alias("requests")).select(F.col("window.start").alias("window_start"), "requests")
