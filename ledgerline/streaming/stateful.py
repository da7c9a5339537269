"""Stateful operators on streams with value, list and map state, timers and time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.sequences import circuit

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """These operators need a state store with several kinds of state; a session that names a provider keeps it."""
    if "RocksDB" not in (spark.conf.get(PROVIDER, None) or ""):
        spark.conf.set(PROVIDER, ROCKS)


def _ordered(rows: Iterator[pd.DataFrame], at: str, tie: str) -> tuple[pd.DataFrame, list[int]]:
    """A micro-batch's rows of a key in order, and their times in microseconds."""
    frame = pd.concat(list(rows)).sort_values([at, tie], kind="stable")
    return frame, frame[at].astype("datetime64[us]").astype("int64").tolist()


class Breaker(StatefulProcessor):
    """Recent failures as a list and the end of a rest as a value; a timer clears both when nothing of them can matter any more."""

    def __init__(self, at: str, tie: str, failed: str, threshold: int, window: float, open_for: float):
        self.at, self.tie, self.failed = at, tie, failed
        self.threshold, self.window, self.open_for = threshold, int(window * 1e6), int(open_for * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures, self.until = handle.getListState("failures", "at long"), handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame, times = _ordered(rows, self.at, self.tie)
        recent = [r[0] for r in self.failures.get()] if self.failures.exists() else []
        until = self.until.get()[0] if self.until.exists() else None
        states, recent, until = circuit(times, frame[self.failed].tolist(), recent, until, self.threshold, self.window, self.open_for)
        self.failures.put([(x,) for x in recent]) if recent else self.failures.clear()
        if until is not None:
            self.until.update((until,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = max([until or 0, *(x + self.window for x in recent)])
        if last:
            self.handle.registerTimer(max(last // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield frame.assign(state=states)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.failures.clear()
        self.until.clear()
        yield from ()


class Limit(StatefulProcessor):
    """How many rows of each window a key has had, as a map by window; timers remove windows that are over."""

    def __init__(self, at: str, tie: str, window: float, limit: int):
        self.at, self.tie, self.window, self.limit = at, tie, int(window * 1e6), limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "window long", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame, times = _ordered(rows, self.at, self.tie)
        counts: dict[int, int] = {}
        allowed = []
        for now in times:
            start = now - now % self.window
            if start not in counts:
                counts[start] = self.counts.getValue((start,))[0] if self.counts.containsKey((start,)) else 0
            counts[start] += 1
            allowed.append(counts[start] <= self.limit)
        for start, n in counts.items():
            self.counts.updateValue((start,), (n,))
            self.handle.registerTimer(max((start + self.window) // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield frame.assign(allowed=allowed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for (start,) in list(self.counts.keys()):
            if start + self.window <= now:
                self.counts.removeKey((start,))
        yield from ()


def _run(rows: DataFrame, key: str, processor: StatefulProcessor, added: str) -> DataFrame:
    state_store(rows.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{schema}, {added}", "Append", "EventTime")


def breaker(rows: DataFrame, key: str, at: str, tie: str, failed: str, threshold: int, window: float, open_for: float) -> DataFrame:
    """rows with state, as the batch operator of that name gives it; rows have a watermark on at.

    Rows of a micro-batch are put in order; what comes later than rows of its key that an earlier micro-batch held is
    judged by what was known then.
    """
    return _run(rows.select(key, at, tie, failed), key, Breaker(at, tie, failed, threshold, window, open_for), "state string")


def fixed_window_limit(rows: DataFrame, key: str, at: str, tie: str, window: float, limit: int) -> DataFrame:
    """rows with allowed: the first `limit` rows of each key and window of so many seconds, as the batch operator; rows have a watermark on at."""
    return _run(rows.select(key, at, tie), key, Limit(at, tie, window, limit), "allowed boolean")
