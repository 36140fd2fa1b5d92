"""Streams with state of their own: bursts that end with quiet, keys that are forgotten, memory ingested once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import memory
from ..store import Store

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BURST = "first long, last long, n long, paths array<string>"


class Bursts(StatefulProcessor):
    """Changes (at in ms, path) of a key less than `gap` ms apart are one burst; after one, changes are dropped for `rest` ms.

    With event time a burst ends when the key's next change is too late for it, or the watermark passes its last change by gap. With processing time it
    ends once nothing came for gap ms of the clock: a debounced trigger.
    """

    def __init__(self, by: list[str], gap: int, rest: int = 0, clock: bool = False) -> None:
        self.by, self.gap, self.rest, self.clock = by, gap, rest, clock

    def init(self, handle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", f"{BURST}, due long")
        self.ended = handle.getValueState("ended", "at long")

    def _made(self, key: tuple, bursts: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, first, last, n, sorted(paths)) for first, last, n, paths, _ in bursts], columns=[*self.by, "first", "last", "n", "paths"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # state is asked for and told once a key, and a key's bursts go out together: each of these is a message to the JVM
        changes = sorted((a, p) for part in rows for a, p in zip(part["at"].tolist(), part["path"], strict=True))
        burst, now = self.burst.get(), timerValues.getCurrentProcessingTimeInMs() if self.clock else None
        burst, had, made = [*burst[:3], set(burst[3]), burst[4]] if burst else None, bool(burst), []
        ended = self.ended.get() if self.rest else None
        ended = ended[0] if ended else None
        for at, path in changes:
            t = now if self.clock else at
            if burst and not self.clock and at - burst[1] >= self.gap:
                made.append(burst)
                burst, ended = None, burst[4]
            if burst is None:
                if self.rest and ended is not None and t - ended < self.rest:
                    continue
                burst = [at, at, 0, set(), 0]
            burst[0], burst[1], burst[2] = min(burst[0], at), max(burst[1], at), burst[2] + 1
            burst[3].add(path)
            burst[4] = (now if self.clock else burst[1]) + self.gap
        if self.rest and made:
            self.ended.update((ended,))
        if burst:
            self.burst.update((*burst[:3], sorted(burst[3]), burst[4]))
            self.handle.registerTimer(burst[4])
        elif had:
            self.burst.clear()
        if made:
            yield self._made(key, made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # timers of a burst that went on, or has ended, are none of its own
        burst = self.burst.get()
        if burst and expiredTimerInfo.getExpiryTimeInMs() >= burst[4]:
            self.burst.clear()
            if self.rest:
                self.ended.update((burst[4],))
            yield self._made(key, [burst])

    def close(self) -> None:
        pass


class Firsts(StatefulProcessor):
    """The first row of a key (at in ms), and again the first that comes `keep` ms or more after the last one given; the watermark drops keys that are older."""

    def __init__(self, by: list[str], keep: int) -> None:
        self.by, self.keep = by, keep

    def init(self, handle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, given = self.last.get(), []
        last = last[0] if last else None
        for at in sorted(a for part in rows for a in part["at"].tolist()):
            if last is None or at - last >= self.keep:
                last = at
                given.append((*key, at))
        if given:
            self.last.update((last,))
            self.handle.registerTimer(last + self.keep)
            yield pd.DataFrame(given, columns=[*self.by, "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()
        if last and expiredTimerInfo.getExpiryTimeInMs() >= last[0] + self.keep:
            self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def _with_state(rows: DataFrame, by: list[str], made: StatefulProcessor, columns: str, mode: str) -> DataFrame:
    """State and timers need the state store on disk, which also holds more keys than memory does."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kinds = dict(rows.dtypes)
    return rows.groupBy(*by).transformWithStateInPandas(made, ", ".join([*(f"{c} {kinds[c]}" for c in by), columns]), "Append", mode)


def debounced(changes: DataFrame, by: list[str], gap: int, rest: int = 0, late: str | None = None, ts: str = "ts") -> DataFrame:
    """Bursts of a stream changes(by, ts, path): by, first, last, n, paths. With `late` by event time, else by the clock (see Bursts)."""
    rows = changes.select(*by, F.col(ts).alias("ts"), F.unix_millis(F.col(ts)).alias("at"), "path")
    rows = rows.withWatermark("ts", late) if late else rows
    return _with_state(rows, by, Bursts(by, gap, rest, late is None), BURST, "EventTime" if late else "ProcessingTime")


def first_again(events: DataFrame, by: list[str], keep: int, late: str, ts: str = "ts") -> DataFrame:
    """by, at: rows of a stream events(by, ts) whose key wasn't given in the `keep` ms before."""
    rows = events.select(*by, F.col(ts).alias("ts"), F.unix_millis(F.col(ts)).alias("at")).withWatermark("ts", late)
    return _with_state(rows, by, Firsts(by, keep), "at long", "EventTime")


def remembered(batch: DataFrame, store: Store, table: str, key: str) -> DataFrame:
    """The store's table with the events of a batch that it doesn't have: the first of each (repo_id, content_hash), as a version named by key.

    A batch that comes again under its key changes nothing.
    """
    if store.last_key(table) == key:
        return store.read(table)
    old = store.read(table)
    first = batch.groupBy("repo_id", "content_hash").agg(F.min("id").alias("id"))
    new = batch.join(first, ["repo_id", "content_hash", "id"], "left_semi").dropDuplicates(["repo_id", "content_hash"])
    if old is None:
        return store.write(table, new.where(F.trim("content") != ""), key)
    return store.write(table, memory.upsert(old, memory.fresh(new, old).select(*old.columns)), key)


def remember_stream(events: DataFrame, store: Store, checkpoint: str, table: str = "events") -> None:
    """Everything that a stream of events has now goes into the store exactly once; a run that was cut off goes on where it stopped."""
    q = events.writeStream.foreachBatch(lambda batch, n: remembered(batch, store, table, f"batch{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
