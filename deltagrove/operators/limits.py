"""Admission control: token buckets, sliding windows, per client and global.

The folds pass over each client's requests in time order, in Arrow batches, so a client may have any number of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class TokenBucket:
    """Starts full; tokens come back at rate a second up to burst; denied requests cost nothing. Times in microseconds."""

    def __init__(self, rate: float, burst: float | None = None) -> None:
        self.rate = rate if rate > 0 else 1.0
        self.burst = burst if burst and burst > 0 else self.rate
        self.tokens, self.last = self.burst, None

    def available(self, now: int) -> float:
        """The tokens at a time; time doesn't go back."""
        if self.last is not None and now > self.last:
            self.tokens = min(self.burst, self.tokens + (now - self.last) / 1e6 * self.rate)
        self.last = now if self.last is None else max(now, self.last)
        return self.tokens

    def allow(self, now: int, n: float = 1) -> bool:
        if self.available(now) >= n:
            self.tokens -= n
            return True
        return False

    def reserve(self, now: int, n: float = 1) -> float:
        """Seconds until n tokens are there; takes none."""
        self.available(now)
        return self.retry_after(n)

    def wait(self, now: int) -> float:
        """Seconds that a caller who waits for one token spends; the token is taken at their end."""
        seconds = self.reserve(now)
        self.available(now + round(seconds * 1e6))
        self.tokens -= 1
        return seconds

    def set_rate(self, rate: float, now: int) -> None:
        """What came back until now came at the old rate. Rates of 0 or less change nothing."""
        self.available(now)
        self.rate = rate if rate > 0 else self.rate

    def set_burst(self, burst: float, now: int) -> None:
        self.available(now)
        if burst > 0:
            self.burst, self.tokens = burst, min(self.tokens, burst)

    def reset(self, now: int) -> None:
        self.tokens, self.last = self.burst, now

    def remaining(self) -> float:
        return self.tokens

    def retry_after(self, n: float = 1) -> float:
        return max(0.0, (n - self.tokens) / self.rate)

    @property
    def limit(self) -> float:
        return self.burst

    def reset_at(self) -> int:
        """When the bucket is full again, if nothing is taken."""
        return (self.last or 0) + round((self.burst - self.tokens) / self.rate * 1e6)


class SlidingWindow:
    """Two fixed windows; the one before counts by the share of it that the sliding window still covers."""

    def __init__(self, limit: int, window_us: int) -> None:
        self.limit, self.window = limit, window_us
        self.at, self.now_count, self.before, self.last = None, 0, 0, 0

    def count(self, now: int) -> float:
        self.last = now = max(self.last, now)
        start = now // self.window * self.window
        if self.at is not None and start > self.at:
            self.before = self.now_count if start == self.at + self.window else 0
            self.now_count = 0
        self.at = start if self.at is None else max(self.at, start)
        return self.before * (1 - (now - self.at) / self.window) + self.now_count

    def allow(self, now: int, n: int = 1) -> bool:
        if self.count(now) + n <= self.limit:
            self.now_count += n
            return True
        return False

    def remaining(self, now: int | None = None) -> float:
        """What is left of the limit at a time, or at the last one asked about."""
        return max(0.0, self.limit - self.count(self.last if now is None else now))

    def retry_after(self, n: int = 1, now: int | None = None) -> float:
        """Seconds until the current window ends, where the limit is reached; else 0."""
        now = self.last if now is None else now
        return 0.0 if self.count(now) < self.limit else (self.at + self.window - now) / 1e6

    def reset_at(self) -> int:
        """The end of the current window."""
        return (self.at or 0) + self.window

    def reset(self, now: int) -> None:
        self.at, self.now_count, self.before, self.last = None, 0, 0, now


ADMITTED = "client string, ord long, allowed boolean, remaining double, limit double, retry_after double, reset_us long"


def admit(requests: DataFrame, limiter) -> DataFrame:
    """requests: client, ord, ts. limiter() makes a client's limiter. The answers: allowed, remaining, limit, retry_after
    (seconds, 0 if allowed) and reset_us (when the limit is whole again, microseconds of the epoch)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, own = None, None
        for pdf in batches:
            out = []
            for c, us in zip(pdf["client"], pdf["us"], strict=True):
                if own is None or c != client:
                    client, own = c, limiter()
                ok = own.allow(us)
                out.append((ok, own.remaining(), float(own.limit), 0.0 if ok else own.retry_after(), own.reset_at()))
            a, r, m, w, t = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pd.DataFrame({"client": pdf["client"], "ord": pdf["ord"], "allowed": a, "remaining": r, "limit": m, "retry_after": w, "reset_us": t})

    t = requests.select("client", "ord", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return t.repartition("client").sortWithinPartitions("client", "us", "ord").mapInPandas(run, ADMITTED)


def token_bucket(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    return admit(requests, lambda: TokenBucket(rate, burst))


def sliding_window(requests: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    return admit(requests, lambda: SlidingWindow(limit, window_seconds * 1_000_000))


def two_level(requests: DataFrame, global_rate: float, client_rate: float, global_burst: float | None = None, client_burst: float | None = None) -> DataFrame:
    """First the limiter of all, then the client's; what the first admitted is spent though the second denies. The global
    limiter is one ordered stream by its nature."""
    first = admit(requests.withColumn("client", F.lit("*")), lambda: TokenBucket(global_rate, global_burst)).select("ord", F.col("allowed").alias("global_allowed"))
    asked = requests.join(first, "ord")
    second = token_bucket(asked.where("global_allowed"), client_rate, client_burst or client_rate).select("ord", F.col("allowed").alias("client_allowed"))
    return asked.join(second, "ord", "left").select("client", "ord", "global_allowed", (F.col("global_allowed") & F.coalesce("client_allowed", F.lit(False))).alias("allowed"))


def window_counts(events: DataFrame, window: str, *keys: str) -> DataFrame:
    w = F.window("ts", window)
    return events.groupBy(*keys, w.alias("_w")).agg(F.count("*").alias("requests")).select(*keys, F.col("_w.start").alias("window_start"), "requests")


def sliding_rate(counts: DataFrame, seconds: int, *keys: str, elapsed: float = 0.5) -> DataFrame:
    """The weighted count at a share of each window: the window before counts by what is still covered of it."""
    w = Window.partitionBy(*keys).orderBy("window_start")
    follows = F.lag("window_start").over(w) == F.col("window_start") - F.make_interval(secs=F.lit(seconds))
    before = F.when(follows, F.lag("requests").over(w)).otherwise(0)
    return counts.withColumn("weighted", (F.coalesce(before, F.lit(0)) * (1 - elapsed) + F.col("requests")).cast("double"))


def idle_clients(events: DataFrame, now, seconds: int) -> DataFrame:
    return events.groupBy("client").agg(F.max("ts").alias("last_seen")).where(F.col("last_seen") < now - F.make_interval(secs=F.lit(seconds)))
