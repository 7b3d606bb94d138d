"""Keyed state with event-time timers (STM6, STM7): rows wait until the watermark has passed them, are taken in time order
whatever the order of their arrival, and the state of keys that stay silent is freed.

``transformWithStateInPandas`` keeps its state in RocksDB; the processors see one key at a time. A key's waiting rows are
those of the watermark's delay; nothing else grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ALERT_OUT = "rule_name string, host string, fired_ts timestamp_ntz"
HISTORY_OUT = "station_id string, n_rows long, change_pct double, std double"
#: Milliseconds of event time after its newest row at which a silent key is forgotten.
IDLE_MS = 7 * 86_400_000


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Timed(StatefulProcessor):
    """One timer per key at a time; its time is part of the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")

    def set_timer(self, at: int) -> None:
        if self.timer.exists():
            old = self.timer.get()[0]
            if old == at:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))


class Alerts(_Timed):
    """STM6: breach streak and last firing per (rule, host). An alert fires when the streak has lasted for the rule's samples
    and the rule's pause since the last firing is over."""

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "t long, event_id long, breach boolean, samples long, pause long")
        self.run = handle.getValueState("run", "streak long, last_fired long, seen long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            new = list(zip(pdf["t"].tolist(), pdf["event_id"].tolist(), pdf["breach"].tolist(), pdf["samples"].tolist(), pdf["pause"].tolist()))
            if new:
                self.waiting.appendList(new)
                first = min(new)[0] if first is None else min(first, min(new)[0])
        if first is not None:
            due = self._due(first, timerValues)
            if not self.timer.exists() or not self._has_older(due):
                self.set_timer(due)
        return iter([])

    def _has_older(self, due: int) -> bool:
        return self.timer.get()[0] <= due and not self._idle()

    def _idle(self) -> bool:
        """Whether the timer waits for silence, not for rows."""
        return self.run.exists() and self.timer.get()[0] == self.run.get()[2] // 1000 + self.idle_ms

    @staticmethod
    def _due(t: int, timerValues) -> int:
        return max(-(-t // 1000), timerValues.getCurrentWatermarkInMs() + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        if not rows:                                   # the key was silent
            self.run.clear()
            return
        streak, last, seen = self.run.get() if self.run.exists() else (0, None, None)
        fired = []
        for t, _, breach, samples, pause in ready:
            if seen is not None and t - seen > self.idle_ms * 1000:       # silent for so long: forgotten, timer or not
                streak, last = 0, None
            seen = t
            streak = streak + 1 if breach else 0
            if breach and streak >= samples and (last is None or t >= last + pause * 60_000_000):
                last = t
                fired.append(t)
        if ready:
            self.run.update((streak, last, seen))
        if rest:
            self.waiting.put(rest)
            self.set_timer(self._due(rest[0][0], timerValues))
        else:
            self.waiting.clear()
            self.set_timer(max(seen // 1000 + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        if fired:
            yield pd.DataFrame({"rule_name": key[0], "host": key[1], "fired_ts": pd.to_datetime(pd.Series(fired, dtype="int64"), unit="us")})


class History(_Timed):
    """STM7: the newest ``keep`` rows per station, by time."""

    def __init__(self, keep: int, last: int, idle_ms: int = IDLE_MS):
        self.keep, self.last, self.idle_ms = keep, last, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.rows = handle.getListState("rows", "t long, event_id long, v double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.rows.get()) if self.rows.exists() else []
        for pdf in rows:                               # never more than one chunk and the newest rows in memory
            held = sorted(held + list(zip(pdf["t"].tolist(), pdf["event_id"].tolist(), pdf["v"].tolist())))[-self.keep:]
        if not held:
            return
        self.rows.put(held)
        self.set_timer(max(held[-1][0] // 1000 + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        recent = np.array([v for _, _, v in held[-self.last:]], float)
        change = (recent[-1] - recent[0]) / abs(recent[0] + 1e-6) * 100
        yield pd.DataFrame({"station_id": [key[0]], "n_rows": [len(recent)], "change_pct": [change], "std": [float(recent.std())]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        self.rows.clear()
        return iter([])


def stream_alerts(rule_rows: DataFrame, watermark: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """STM6: sustained breach with cool-down, equal to WIN10 / WIN11 over the rows within the watermark.

    ``rule_rows`` = metric samples joined with rules and flagged (``breach``), as from ``monitor.evaluate_rules`` before the
    streak step. Rows are taken in the order of (metric_ts, event_id) when the watermark passes them, so late files and
    mixed batches change nothing; rows behind the watermark are dropped by Spark. A key without rows for ``idle_ms`` is forgotten:
    its streak and its last firing with it.
    """
    use_rocksdb(rule_rows.sparkSession)
    et = F.col("metric_ts").cast("timestamp")
    d = rule_rows.select("rule_name", "host", et.alias("_et"), F.unix_micros(et).alias("t"), F.col("event_id").cast("long").alias("event_id"),
                         "breach", F.col("duration_samples").cast("long").alias("samples"), F.col("cooldown_minutes").cast("long").alias("pause"))
    return d.withWatermark("_et", watermark).groupBy("rule_name", "host").transformWithStateInPandas(
        Alerts(idle_ms), ALERT_OUT, "append", "EventTime")


def stream_history_trends(obs: DataFrame, value: str = "temperature_c", keep: int = 100, last: int = 24,
                          watermark: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """STM7: first->last change and pop-std over the newest ``last`` of at most ``keep`` held rows, emitted per micro-batch
    (update mode). Rows count by (obs_ts, event_id), whatever the order of arrival."""
    use_rocksdb(obs.sparkSession)
    et = F.col("obs_ts").cast("timestamp")
    d = obs.select("station_id", et.alias("_et"), F.unix_micros(et).alias("t"), F.col("event_id").cast("long").alias("event_id"),
                   F.col(value).cast("double").alias("v"))
    return d.withWatermark("_et", watermark).groupBy("station_id").transformWithStateInPandas(
        History(keep, last, idle_ms), HISTORY_OUT, "update", "EventTime")
