"""Ordered data: change detection, islands, sessions, state machines and windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed(rows: DataFrame, keys: list[str], order: list[str], fingerprint: str) -> DataFrame:
    """Rows whose fingerprint differs from the one before; a key's first row is the baseline and never changed."""
    before = F.lag(fingerprint).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_before", before).filter(F.col("_before").isNotNull() & (F.col("_before") != F.col(fingerprint))).drop("_before")


def field_changes(rows: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """keys, order, field, before, after: one row for each field that differs from the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    entries = [F.when(~first & ~F.lag(f).over(w).eqNullSafe(F.col(f)), F.struct(F.lit(f).alias("field"), F.lag(f).over(w).cast("string").alias("before"), F.col(f).cast("string").alias("after"))) for f in fields]
    compared = rows.select(*keys, *order, F.array_compact(F.array(*entries)).alias("c"))
    return compared.select(*keys, *order, F.explode("c").alias("c")).select(*keys, *order, "c.*")


def islands(rows: DataFrame, keys: list[str], order: list[str], bad: Column, clean_to_close: int) -> DataFrame:
    """keys, opened, last_bad, n_bad: incidents that close after so many clean rows in a row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    # Clean rows since the last bad one, and so whether a bad row opens a new incident.
    marked = rows.withColumn("_bad", bad).withColumn("_i", F.row_number().over(w))
    bads = marked.filter("_bad").withColumn("_gap", F.col("_i") - F.lag("_i").over(w) - 1)
    opened = bads.withColumn("_incident", F.sum(F.when(F.col("_gap").isNull() | (F.col("_gap") >= clean_to_close), 1).otherwise(0)).over(w))
    return opened.groupBy(*keys, "_incident").agg(F.min(order[0]).alias("opened"), F.max(order[0]).alias("last_bad"), F.count("*").alias("n_bad")).drop("_incident")


def illegal_transitions(rows: DataFrame, keys: list[str], order: list[str], state: str, legal: list[tuple[str, str]]) -> DataFrame:
    """Rows that follow a state from which theirs may not be reached, with the state before."""
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy(*order))
    allowed = F.lit(False)
    for a, b in legal:
        allowed = allowed | ((F.col("before") == a) & (F.col(state) == b))
    return rows.withColumn("before", before).filter(F.col("before").isNotNull() & ~allowed)


def retries(rows: DataFrame, keys: list[str], at: str, tie: str, failed: Column, most: int = 3, base: float = 30) -> DataFrame:
    """Failed rows with attempt, state and due: the n-th failure in a row is tried again after base * 2 ** n seconds, until the `most`-th is dead.

    A row that did not fail starts the count anew. due is null for dead ones.
    """
    w = Window.partitionBy(*keys).orderBy(at, tie)
    runs = rows.withColumn("_failed", failed).withColumn("_run", F.sum(F.when(F.col("_failed"), 0).otherwise(1)).over(w)).filter("_failed")
    attempt = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(at, tie))
    tried = runs.withColumn("attempt", attempt).drop("_failed", "_run")
    alive = F.col("attempt") < most
    due = F.timestamp_micros((F.unix_micros(F.col(at).cast("timestamp")) + F.pow(F.lit(2.0), F.col("attempt")) * F.lit(base * 1e6)).cast("long"))
    return tried.withColumn("state", F.when(alive, "retry").otherwise("dead")).withColumn("due", F.when(alive, due))


def dead_letters(rows: DataFrame, keys: list[str], order: list[str], failed: Column, most: int = 5) -> DataFrame:
    """rows with failures (so far) and state: live, or dead_letter from a key's `most`-th failure on."""
    so_far = F.sum(F.when(failed, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("failures", so_far).withColumn("state", F.when(F.col("failures") >= most, "dead_letter").otherwise("live"))


def fixed_window_limit(rows: DataFrame, keys: list[str], at: str, window: str, limit: int, tie: str) -> DataFrame:
    """rows with allowed: the first `limit` rows of each key and fixed window."""
    rank = F.row_number().over(Window.partitionBy(*keys, F.window(at, window)).orderBy(at, tie))
    return rows.withColumn("allowed", rank <= limit)


def sessions(rows: DataFrame, keys: list[str], at: str, gap: str) -> DataFrame:
    """keys, started, ended, n by gaps."""
    s = rows.groupBy(*keys, F.session_window(at, gap)).agg(F.count("*").alias("n"), F.min(at).alias("started"), F.max(at).alias("ended"))
    return s.drop("session_window")


def suppress_repeats(rows: DataFrame, keys: list[str], at: str, tie: str, seconds: float) -> DataFrame:
    """rows with emitted: false within so many seconds of the row before it, emitted or not.

    A suppressed row extends the silence, so the row before decides and a lag suffices.
    """
    w = Window.partitionBy(*keys).orderBy(at, tie)
    since = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))) / 1e6
    return rows.withColumn("emitted", since.isNull() | (since >= seconds))


def circuit(at: list[int], failed: list[bool], recent: list[int], until: int | None, threshold: int, window: int, open_for: int) -> tuple[list[str], list[int], int | None]:
    """States of a key's next rows, and its recent failures and end of rest after them; times are microseconds.

    The breaker of batches and that of streams both go through this.
    """
    states = []
    for now, bad in zip(at, failed, strict=True):
        if until is not None and now < until:
            states.append("open")
            continue
        states.append("closed")
        if not bad:
            recent = []
            continue
        recent = [x for x in recent if now - x <= window] + [now]
        if len(recent) >= threshold:
            until, recent = now + open_for, []
    return states, recent, until


def breaker(rows: DataFrame, keys: list[str], at: str, tie: str, failed: str, threshold: int, window: float, open_for: float) -> DataFrame:
    """rows with state: closed, or open while a circuit that failed `threshold` times within `window` seconds rests.

    A success resets the failures. The state depends on all rows before, so each
    key's rows go in order through one loop that holds only the recent failures.
    """
    fields = [*keys, at, tie, failed]
    size, rest = int(window * 1e6), int(open_for * 1e6)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent, until = None, [], None
        for batch in batches:
            names = list(zip(*(batch[k] for k in keys), strict=True))
            times, bad = batch[at].astype("datetime64[us]").astype("int64").tolist(), batch[failed].tolist()
            starts = [i for i, n in enumerate(names) if i == 0 or n != names[i - 1]]
            states = []
            for p, q in zip(starts, [*starts[1:], len(names)], strict=True):
                if names[p] != current:
                    current, recent, until = names[p], [], None
                found, recent, until = circuit(times[p:q], bad[p:q], recent, until, threshold, size, rest)
                states += found
            yield batch.assign(state=states)

    narrow = rows.select(*fields)
    schema = narrow.schema.add("state", "string")
    return narrow.repartition(*keys).sortWithinPartitions(*keys, at, tie).mapInPandas(run, schema)
