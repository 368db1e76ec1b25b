"""Streaming forms of the caches and breakers, and windows of engine health.

State lives in Spark's state store by key; nothing is kept in a process. Times are event times, which is a
deliberate extension: replays give the same answers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How long a failure refuses a key, in seconds.
NEGATIVE_TTL = 300


def engine_windows(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Tumbling or sliding windows of events by type, with a watermark for late ones."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"), F.count_if(F.col("event_type") == "error").alias("errors"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each key: events closer than ``gap``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


class _Refusals(StatefulProcessor):
    """The time of the last failure of each key; an event within the lifetime of a failure is refused."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failed = handle.getValueState("failed", "failed timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last = self.failed.get()[0] if self.failed.exists() else None
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        refused = []
        for ts, kind in zip(batch["ts"], batch["event_type"], strict=True):
            refused.append(last is not None and pd.Timestamp(ts) - pd.Timestamp(last) < pd.Timedelta(seconds=NEGATIVE_TTL))
            if kind == "error":
                last = ts
        if last is not None:
            self.failed.update((pd.Timestamp(last).to_pydatetime(),))
        yield pd.DataFrame({"event_id": batch["event_id"], "refused": refused})

    def close(self) -> None:
        pass


def negative_cache(events: DataFrame, key: str = "user_id") -> DataFrame:
    """``event_id``, ``refused`` of a stream of events by ``key``; needs the RocksDB state store.

    With the engine as key this is the breaker of each engine: it refuses while a failure is less than NEGATIVE_TTL back.
    """
    return events.select(key, "event_id", "ts", "event_type").groupBy(key).transformWithStateInPandas(_Refusals(), "event_id bigint, refused boolean", "Append", "None")


#: Lifetime of an entry of a process's own cache in seconds, and how many it holds.
MEMORY_TTL, MEMORY_ENTRIES = 600, 200


class Fifo:
    """The cache of one process: entries live MEMORY_TTL, and beyond MEMORY_ENTRIES the one inserted first goes; neither a hit nor a rewrite moves an entry."""

    def __init__(self, entries: list[tuple[str, float]] = ()) -> None:  # type: ignore[assignment]
        self.until: dict[str, float] = dict(entries)

    def ask(self, key: str, now: float) -> bool:
        until = self.until.get(key)
        if until is None:
            return False
        if until > now:
            return True
        del self.until[key]
        return False

    def write(self, key: str, now: float) -> None:
        self.until[key] = now + MEMORY_TTL
        if len(self.until) > MEMORY_ENTRIES:
            del self.until[next(iter(self.until))]


class _Memory(StatefulProcessor):
    """A Fifo for each process, kept between batches; it never holds more than MEMORY_ENTRIES entries."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getValueState("entries", "entries string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        cache = Fifo(json.loads(self.entries.get()[0])) if self.entries.exists() else Fifo()
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for event_id, ts, query, kind in zip(batch["event_id"], batch["ts"], batch["query_hash"], batch["kind"], strict=True):
            now = pd.Timestamp(ts).timestamp()
            if kind == "write":
                cache.write(query, now)
            else:
                out.append((event_id, cache.ask(query, now)))
        self.entries.update((json.dumps(list(cache.until.items())),))
        yield pd.DataFrame({"process": [key[0]] * len(out), "event_id": [x[0] for x in out], "hit": [x[1] for x in out]})

    def close(self) -> None:
        pass


def memory_cache(events: DataFrame) -> DataFrame:
    """``process``, ``event_id``, ``hit`` of each question in a stream of ``process``, ``event_id``, ``ts``, ``query_hash``, ``kind`` ('ask' or 'write'); needs the RocksDB state store.

    Counters of hits and questions are sums over the result.
    """
    own = events.select("process", "event_id", "ts", "query_hash", "kind").groupBy("process")
    return own.transformWithStateInPandas(_Memory(), "process string, event_id bigint, hit boolean", "Append", "None")


def latest_by_key(batch: DataFrame, path: str) -> None:
    """``foreachBatch`` sink of a last-write-wins cache: each batch is reduced to one row for a key and appended; readers take the latest."""
    batch.groupBy("query_hash").agg(F.max_by(F.struct("results", "engine"), "created_at").alias("v"), F.max("created_at").alias("created_at")).select("query_hash", "v.*", "created_at").write.mode("append").parquet(path)
