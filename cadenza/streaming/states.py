"""The monitor's state machine on streams as they arrive.

Rows come in any order within the watermark's delay. Each stream keeps the rows that the watermark hasn't
passed, and the state behind those that it has; a timer at the earliest kept row lets them go on, in event
time order, when the watermark passes it, whether or not the stream gets new rows. Rows that arrive behind
the watermark are left out, as it says. A stream without rows for so many hours of event time loses its state and
begins anew. What is emitted is what the batch operator gives for the same rows; a replay of a finished
query changes nothing, for state and output go forward together at each checkpoint of the query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from cadenza.operators.monitor import Hysteresis

_ROW = "ts_us long, key long, score double, threshold double, reset double, early boolean"
OUTPUT = "stream string, ts timestamp, key long, state string, consecutive long, released long"


class _Judge(StatefulProcessor):
    """State of one stream: what is kept, and the machine's state with the time of its last row."""

    def __init__(self, persistence: int, release: int, idle_ms: int):
        self.machine, self.idle_ms = Hysteresis(persistence, release), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", _ROW)
        self.reached = handle.getValueState("reached", "state long, ts_us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        new = []
        for frame in rows:
            for r in frame[["ts_us", "key", "score", "threshold", "reset", "early"]].itertuples(index=False, name=None):
                if r[0] >= passed * 1000:
                    new.append((int(r[0]), int(r[1]), *(None if pd.isna(x) else float(x) for x in r[2:5]), bool(r[5])))
        if new:
            self.kept.appendList(new)
            self._wake(min(r[0] for r in new))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        kept = sorted(map(tuple, self.kept.get())) if self.kept.exists() else []
        due = [r for r in kept if r[0] < passed]
        rest = kept[len(due) :]
        state, last = tuple(self.reached.get()) if self.reached.exists() else (0, None)
        if due:
            yield self._judged(key[0], due, state, last)
        elif last is not None and passed - last > self.idle_ms * 1000:
            self.reached.clear()
        if rest:
            self.kept.put(rest)
            self._wake(rest[0][0])
        elif kept:
            self.kept.clear()

    def _judged(self, stream: str, rows: list[tuple], state: int, last: int | None) -> pd.DataFrame:
        ts = np.array([r[0] for r in rows])
        score, high, low = (np.array([np.nan if r[k] is None else r[k] for r in rows], float) for k in (2, 3, 4))
        symbols = self.machine.symbols(score, high, low, np.array([r[5] for r in rows]))
        gone = np.diff(ts, prepend=ts[0] if last is None else last) > self.idle_ms * 1000
        states, begin = np.zeros(len(rows), np.int64), 0
        for end in [*np.flatnonzero(gone).tolist(), len(rows)]:
            if end > begin:
                states[begin:end] = self.machine.states(symbols[begin:end], 0 if gone[begin] else state)
                state = int(states[end - 1])
            begin = end
        self.reached.update((state, int(ts[-1])))
        self._wake(int(ts[-1]) + self.idle_ms * 1000 + 1000)
        name, up, down = self.machine.named(symbols, states)
        return pd.DataFrame({"stream": stream, "ts": pd.to_datetime(ts, unit="us", utc=True).tz_localize(None), "key": [r[1] for r in rows], "state": name, "consecutive": up, "released": down})

    def _wake(self, ts_us: int) -> None:
        """A timer when the watermark is past the row's millisecond."""
        self.handle.registerTimer(ts_us // 1000 + 1)

    def close(self) -> None:
        pass


def monitor_stream(scores: DataFrame, persistence: int = 6, release: int = 6, late: str = "10 minutes", idle_hours: float = 720) -> DataFrame:
    """scores, a stream: stream, ts, key (tells rows of one time apart, and orders them), score, threshold,
    reset, in_baseline. Returns stream, ts, key, state, consecutive, released, once for each row, when the
    watermark has passed it. Rows without a stream, time or key have no place and are left out. Needs the
    state store of RocksDB."""
    rows = scores.where("stream IS NOT NULL AND ts IS NOT NULL AND key IS NOT NULL").withWatermark("ts", late)
    rows = rows.select(F.col("stream").cast("string").alias("stream"), "ts", F.unix_micros("ts").alias("ts_us"), F.col("key").cast("long").alias("key"), *(F.col(c).cast("double").alias(c) for c in ("score", "threshold", "reset")), F.coalesce("in_baseline", F.lit(False)).alias("early"))
    return rows.groupBy("stream").transformWithStateInPandas(_Judge(persistence, release, int(idle_hours * 3_600_000)), OUTPUT, "append", "EventTime")
