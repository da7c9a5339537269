"""Structured Streaming counterparts of the ordered-event operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sequences import circuit
from ..sources.files import upsert_parts, upsert_table


def event_time(rows: DataFrame, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """at as a timestamp with a watermark; rows later than that are dropped by what follows."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def window_counts(rows: DataFrame, keys: list[str], window: str, slide: str | None = None, at: str = "ts", value: str = "value") -> DataFrame:
    """started, keys, n, total of tumbling or sliding windows; rows must have a watermark for append mode."""
    grouped = rows.groupBy(F.window(at, window, slide) if slide else F.window(at, window), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("started"), *keys, "n", "total")


def session_counts(rows: DataFrame, keys: list[str], gap: str, at: str = "ts") -> DataFrame:
    s = rows.groupBy(*keys, F.session_window(at, gap)).agg(F.count("*").alias("n"))
    return s.select(*keys, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def first_only(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key within the watermark's delay."""
    return rows.dropDuplicatesWithinWatermark(keys)


def suppress_repeats(rows: DataFrame, key: str, seconds: float, at: str = "ts", tie: str = "event_id") -> DataFrame:
    """key, tie, at, emitted: as the batch operator of that name, with the last row's time as state.

    Rows of a micro-batch are put in order first; a key's state goes when the
    watermark passes its last row by the window.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values([at, tie])
        emitted = []
        for now in rows[at]:
            micros = int(now.value // 1000)
            emitted.append(last is None or (micros - last) / 1e6 >= seconds)
            last = micros
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + int(seconds * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: k[0], tie: rows[tie].to_numpy(), at: rows[at].to_numpy(), "emitted": emitted})

    kind = dict(rows.dtypes)
    return rows.select(key, tie, at).groupBy(key).applyInPandasWithState(run, f"{key} {kind[key]}, {tie} {kind[tie]}, {at} timestamp, emitted boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def incidents(rows: DataFrame, key: str, bad: str, clean_to_close: int, at: str = "ts", tie: str = "event_id") -> DataFrame:
    """key, at, change: an incident opens at a bad row and closes after so many clean rows in a row."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        is_open, clean = state.get if state.exists else (False, 0)
        changes = []
        for row in pd.concat(list(batches)).sort_values([at, tie]).itertuples(index=False):
            if getattr(row, bad):
                clean = 0
                if not is_open:
                    is_open = True
                    changes.append((k[0], getattr(row, at), "opened"))
            elif is_open:
                clean += 1
                if clean >= clean_to_close:
                    is_open, clean = False, 0
                    changes.append((k[0], getattr(row, at), "closed"))
        state.update((is_open, clean))
        yield pd.DataFrame(changes, columns=[key, at, "change"])

    kind = dict(rows.dtypes)
    return rows.select(key, tie, at, bad).groupBy(key).applyInPandasWithState(run, f"{key} {kind[key]}, {at} timestamp, change string", "is_open boolean, clean int", "append", GroupStateTimeout.NoTimeout)


def upsert_stream(rows: DataFrame, path: str, keys: list[str], checkpoint: str, how: dict[str, str] | None = None, order: list[str] | None = None, parts: int | None = None) -> StreamingQuery:
    """Writes each micro-batch over the table at path by key: a repeated batch changes nothing.

    With parts the table is laid out in so many parts by key, and a batch rewrites only those that it touches.
    """
    if parts:
        return for_each_batch(rows, lambda batch: upsert_parts(batch.sparkSession, path, batch, keys, how, order, parts), checkpoint)
    return for_each_batch(rows, lambda batch: upsert_table(batch.sparkSession, path, batch, keys, how, order), checkpoint)


def for_each_batch(rows: DataFrame, act: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    return rows.writeStream.outputMode("update").foreachBatch(lambda batch, _: act(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
