"""Structured Streaming forms of the stateful operators.

Counter deltas keep one row of state for each interface, change scores and trends a short list for each graph or
series; keys spread over all tasks. With idle_ms, state of keys that are idle so long is dropped (the stream then runs on without
new data); without, it stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.operators.interfaces import COUNTERS

DELTAS = "device string, name string, ts double, " + ", ".join(f"{c}_delta bigint" for c in COUNTERS)


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout


def counter_deltas(polls: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Growth of each interface's counters since its poll before, over a stream of (device, name, ts, counters)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        kept = state.getOption
        out = []
        for r in rows[["ts", *COUNTERS]].itertuples(index=False):
            if kept is not None and r[0] > kept[0]:
                out.append((*key, float(r[0]), *(max(int(n) - int(o), 0) for n, o in zip(r[1:], kept[1:]))))
            if kept is None or r[0] > kept[0]:
                kept = (float(r[0]), *(int(x) for x in r[1:]))
        state.update(kept)
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["device", "name", "ts", *[f"{c}_delta" for c in COUNTERS]])

    schema = "ts double, " + ", ".join(f"{c} bigint" for c in COUNTERS)
    return polls.groupBy("device", "name").applyInPandasWithState(step, DELTAS, schema, "append", _timeout(idle_ms))


def rolling_z(series: DataFrame, key: str, ts: str, value: str, window: int = 10, idle_ms: int | None = None) -> DataFrame:
    """(key, ts, value, z): each value against the window that ends with it."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = list(state.getOption[0]) if state.exists else []
        out = []
        for t, v in pd.concat(list(batches)).sort_values(ts)[[ts, value]].itertuples(index=False):
            seen = [*seen, float(v)][-window:]
            std = float(np.std(seen))
            out.append((k[0], float(t), float(v), (float(v) - float(np.mean(seen))) / std if std > 0 else 0.0))
        state.update((seen,))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["key", "ts", "value", "z"])

    return series.groupBy(F.col(key).cast("string").alias("key")).applyInPandasWithState(step, "key string, ts double, value double, z double", "seen array<double>", "append", _timeout(idle_ms))


def rolling_trend(series: DataFrame, key: str, ts: str, value: str, lookback: int = 10, idle_ms: int | None = None) -> DataFrame:
    """(key, ts, value, trend): the slope of the last values, 0 for fewer than three."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = list(state.getOption[0]) if state.exists else []
        out = []
        for t, v in pd.concat(list(batches)).sort_values(ts)[[ts, value]].itertuples(index=False):
            seen = [*seen, float(v)][-lookback:]
            out.append((k[0], float(t), float(v), float(np.polyfit(np.arange(len(seen)), seen, 1)[0]) if len(seen) >= 3 else 0.0))
        state.update((seen,))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["key", "ts", "value", "trend"])

    return series.groupBy(F.col(key).cast("string").alias("key")).applyInPandasWithState(step, "key string, ts double, value double, trend double", "seen array<double>", "append", _timeout(idle_ms))


def windowed_errors(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events, errors (events of type error) and the mean value of each event-time window; rows later than `late` are left out."""
    rows = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("value").alias("mean_value"))


def append_snapshots(rows: DataFrame, path: str, kept: int = 1000):
    """A writer that stores each micro-batch of a stream under path as the snapshot seq=<batch id>, the last `kept` of them.

    A batch that is written again after a failure replaces itself. Start it with .start(); read path as (seq, ...).
    """

    def store(batch: DataFrame, seq: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/seq={seq}")
        if seq >= kept:
            old = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/seq={seq - kept}")
            old.getFileSystem(batch.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return rows.writeStream.foreachBatch(store)
