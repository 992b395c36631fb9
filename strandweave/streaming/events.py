"""Streams of events and messages.  State is bounded by watermarks or by the keys' own small states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType


def windowed(events: DataFrame, at: str, length: str, slide: str | None = None, late: str = "1 hour", keys: tuple[str, ...] = ()) -> DataFrame:
    """(start, *keys, n) of tumbling or sliding windows; rows more than ``late`` behind the newest are dropped."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    found = events.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), *keys, "n")


def once(events: DataFrame, at: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once, also when a source replays; keys are forgotten after ``late``."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def idle(messages: DataFrame, at: str, key: str, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """(key, start, stop, n): sessions that a gap ends, sent when the watermark has passed their end."""
    found = messages.withWatermark(at, late).groupBy(F.col(key), F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def limited(events: DataFrame, key: str, at: str, most: int, seconds: float, late: str = "1 hour") -> DataFrame:
    """(key, at, allowed): at most ``most`` accepted events of a key in any ``seconds``; refused ones don't count.

    A key's state is its last ``most`` accepted times; within a trigger its events go in order of time.  The state goes
    when the watermark, ``late`` behind the newest event, has passed the end of its span; events that are later still
    are dropped.
    """
    kind = events.schema[key].dataType.simpleString()

    def ruled(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        times = pd.concat([b[at] for b in batches], ignore_index=True).sort_values()
        flags = []
        for t in times.astype("datetime64[us]").astype("int64") / 1e6:
            recent = [x for x in recent if x > t - seconds]
            flags.append(len(recent) < most)
            if flags[-1]:
                recent.append(float(t))
        state.update((recent,))
        end = int((max(recent, default=0.0) + seconds) * 1000) + 1
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(flags), at: times.to_numpy(), "allowed": flags})

    rows = events.select(key, at).withWatermark(at, late).groupBy(key)
    return rows.applyInPandasWithState(ruled, f"{key} {kind}, {at} timestamp, allowed boolean", "recent array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def deltas(messages: DataFrame, key: str, at: str, most: int, order: str | None = None, wait_ms: int = 0) -> DataFrame:
    """The whole rows of ``messages`` and ``truncated``: per trigger and key the oldest ``most`` that are new, by ``at``
    and then ``order``; ``truncated`` tells that more of the key wait.

    What is beyond waits in the key's state and goes out by a timer, ``most`` a trigger, whether or not the key gets new
    rows, so nothing is lost and a message is handed on once.  A key without waiting rows has no state.  The stream runs
    with processing-time triggers and the RocksDB state store (:func:`stateful`).
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    columns, schema = messages.columns, messages.schema
    sort = [at] + ([order] if order else [])

    class Handed(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", schema)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            yield from self.step(list(rows), timerValues.getCurrentProcessingTimeInMs())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            yield from self.step([], timerValues.getCurrentProcessingTimeInMs())

        def step(self, new: list[pd.DataFrame], now: int) -> Iterator[pd.DataFrame]:
            old = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=columns)
            every = pd.concat([x for x in (old, *new) if len(x)] or [old], ignore_index=True)
            every = every.sort_values(sort, kind="stable")
            out, rest = every.iloc[:most], every.iloc[most:]
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if len(rest):
                self.waiting.put([tuple(_plain(v) for v in r) for r in rest.itertuples(index=False, name=None)])
                self.handle.registerTimer(now + wait_ms)
            elif len(old):
                self.waiting.clear()
            if len(out):
                yield out[columns].assign(truncated=len(rest) > 0)

        def close(self) -> None:
            pass

    out = StructType([*schema.fields, StructField("truncated", BooleanType())])
    return messages.groupBy(key).transformWithStateInPandas(Handed(), out, "append", "ProcessingTime")


def _plain(value):
    """A cell as the state store takes it."""
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    if value is pd.NaT or isinstance(value, float) and value != value:
        return None
    return value.item() if hasattr(value, "item") else value


def stateful(spark: SparkSession) -> None:
    """Choose the state store that timers and lists need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
