"""State of feeds and caches in streams: circuit breakers and caches whose entries run out, by event time.

Both keep state by key with timers in event time, so a retried batch or a lost executor goes on from the checkpoint, and what
has run out leaves the state by itself. Rows later than the watermark are dropped by Spark; rows that are earlier than one
already handled of their key, but within the watermark, are marked ``late`` and change nothing. A session needs the RocksDB
state store (``spark.sql.streaming.stateStore.providerClass``). Null keys are a key of their own; rows without a time are left
out.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Failures up to a block, its length, the rest after each earlier failure, and statuses that block at once.
BLOCK_AFTER, BLOCK_MS, REST_MS, BLOCKED_AT_ONCE = 3, 24 * 3_600_000, 30 * 60_000, (403, 404)
# Runs of a domain a day.
RUNS_A_DAY = 20
IDLE_MS = 30 * 24 * 3_600_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(ts: Any) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


def _time(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)


def _sorted(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A key's rows of one batch in order; a feed has few."""
    parts = list(rows)
    return pd.concat(parts).sort_values(by, kind="stable") if parts else pd.DataFrame()


def breaker_step(failures: int, until: int, at: int, ok: bool, status: int | None, html: bool) -> tuple[int, int, str]:
    """(failures, blocked until, what happened) after one outcome."""
    if at < until:
        return failures, until, "skipped"
    if status in BLOCKED_AT_ONCE or html:
        return BLOCK_AFTER, at + BLOCK_MS, "blocked_at_once"
    if ok:
        return 0, 0, "ok"
    failures += 1
    return (failures, at + BLOCK_MS, "blocked") if failures >= BLOCK_AFTER else (failures, at + REST_MS * failures, "resting")


class Breaker(StatefulProcessor):
    """Failures in a row and the end of the block of each feed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", "failures int, until long, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        failures, until, last = self.state.get() if self.state.exists() else (0, 0, -(1 << 62))
        out, before = [], (until, last)
        for r in _sorted(rows, ["ts"]).itertuples():
            at = _ms(r.ts)
            if at < last:
                out.append((key[0], r.ts, "late", failures, _time(until) if until else None))
                continue
            failures, until, what = breaker_step(failures, until, at, bool(r.ok), None if pd.isna(r.status) else int(r.status), bool(r.html))
            last = at
            out.append((key[0], r.ts, what, failures, _time(until) if until else None))
        for timer in (before[0], before[1] + IDLE_MS):
            if timer > 0:
                self.handle.deleteTimer(timer)
        if until > last:
            self.handle.registerTimer(until)
        self.handle.registerTimer(last + IDLE_MS)
        self.state.update((failures, until, last))
        yield pd.DataFrame(out, columns=["feed", "ts", "what", "failures", "until"]).astype({"ts": "datetime64[us]", "until": "datetime64[us]"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        failures, until, last = self.state.get() if self.state.exists() else (0, 0, 0)
        if at >= last + IDLE_MS:
            self.state.clear()
            what = "forgotten"
        else:
            what = "open"
        yield pd.DataFrame([(key[0], _time(at), what, failures, None)], columns=["feed", "ts", "what", "failures", "until"]).astype({"ts": "datetime64[us]", "until": "datetime64[us]"})

    def close(self) -> None:
        pass


def breaker_events(outcomes: DataFrame, late: str = "1 hour") -> DataFrame:
    """(feed, ts, what, failures, until) of a stream of outcomes (feed, ts, ok, status, html): ok, resting, blocked,
    blocked_at_once, skipped (the feed is not asked), late, open (a block has ended) and forgotten (no outcome for thirty days).
    """
    rows = outcomes.where("ts IS NOT NULL").select("feed", "ts", F.coalesce("ok", F.lit(False)).alias("ok"), F.col("status").cast("int").alias("status"), F.coalesce("html", F.lit(False)).alias("html"))
    return rows.withWatermark("ts", late).groupBy("feed").transformWithStateInPandas(Breaker(), "feed string, ts timestamp, what string, failures int, until timestamp", "Append", "EventTime")


class Cache(StatefulProcessor):
    """Addresses that a domain's cache holds until they run out, and the domain's runs of the day."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "url string", "until long")
        self.runs = handle.getValueState("runs", "day long, n int, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        day, n, last = self.runs.get() if self.runs.exists() else (-1, 0, -(1 << 62))
        out = []
        for r in _sorted(rows, ["ts", "url"]).itertuples():
            at, url = _ms(r.ts), (r.url,)
            if at < last:
                out.append((key[0], r.url, r.ts, "late", None))
                continue
            last = at
            today = at // 86_400_000
            day, n = (day, n) if today == day else (today, 0)
            until = self.entries.getValue(url)[0] if self.entries.containsKey(url) else 0
            if until > at:
                out.append((key[0], r.url, r.ts, "hit", _time(until)))
            elif n >= RUNS_A_DAY:
                out.append((key[0], r.url, r.ts, "refused", None))
            else:
                n += 1
                until = at + int(r.ttl_ms)
                self.entries.updateValue(url, (until,))
                self.handle.registerTimer(until)
                out.append((key[0], r.url, r.ts, "fetched", _time(until)))
        self.runs.update((day, n, last))
        yield pd.DataFrame(out, columns=["domain", "url", "ts", "what", "until"]).astype({"ts": "datetime64[us]", "until": "datetime64[us]"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        gone = [url[0] for url, until in list(self.entries.iterator()) if until[0] <= at]
        for url in gone:
            self.entries.removeKey((url,))
        yield pd.DataFrame([(key[0], url, _time(at), "expired", None) for url in sorted(gone)], columns=["domain", "url", "ts", "what", "until"]).astype({"ts": "datetime64[us]", "until": "datetime64[us]"})

    def close(self) -> None:
        pass


def cache_events(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """(domain, url, ts, what, until) of a stream of requests (domain, url, ts, ttl_ms): fetched, hit, refused (over the runs of
    a day), late and expired.
    """
    rows = requests.where("ts IS NOT NULL AND url IS NOT NULL").select("domain", "url", "ts", F.coalesce("ttl_ms", F.lit(0)).cast("long").alias("ttl_ms"))
    return rows.withWatermark("ts", late).groupBy("domain").transformWithStateInPandas(Cache(), "domain string, url string, ts timestamp, what string, until timestamp", "Append", "EventTime")
