"""Indicators of a bar stream, bar by bar, whatever order and batches the bars come in.

A bar waits in state until the watermark has passed it; then it and the bars before it are final, and the recurrences
of their symbol step over them in time order. So the result depends on the bars alone: any split into micro-batches
and any order within the allowed lateness gives what the batch operators give. A symbol's state is one row of levels
and the bars of the last `lateness`; it is dropped by an event-time timer once the symbol has been silent for `idle`,
and a series that comes back after such a gap starts anew, in the stream as in the batch twin.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.indicators import trend_step

NAN = float("nan")
#: microseconds of a millisecond, the unit of timers
MS = 1000


class Levels(NamedTuple):
    """All that a symbol's recurrences remember: time and number of the last bar, and their levels."""

    at: int = 0
    bars: int = 0
    close: float = NAN
    smooth: float = NAN
    gain: float = NAN
    loss: float = NAN
    span: float = NAN
    band_span: float = NAN
    upper: float = NAN
    lower: float = NAN
    direction: int = 0


LEVELS = "at long, bars long, close double, smooth double, gain double, loss double, span double, band_span double, upper double, lower double, direction int"
BAR = "at long, high double, low double, close double"
OUT = "symbol string, ts timestamp, bars long, smoothed double, rsi double, atr double, supertrend double, direction int"


class Windows(NamedTuple):
    smooth: int = 14
    rsi: int = 14
    atr: int = 14
    band: int = 10
    multiplier: float = 3.0


def _blend(level: float, x: float, n: int) -> float:
    return x if math.isnan(level) else level * (1 - 1 / n) + x / n


def advance(s: Levels, at: int, high: float, low: float, close: float, w: Windows) -> tuple[Levels, tuple]:
    """One bar: the levels after it, and (bars, smoothed, rsi, atr, supertrend, direction), None during warm-up."""
    bars, smooth = s.bars + 1, _blend(s.smooth, close, w.smooth)
    gain, loss, span, band_span = s.gain, s.loss, s.span, s.band_span
    if s.bars:
        move, reach = close - s.close, max(high - low, abs(high - s.close), abs(low - s.close))
        gain, loss = _blend(gain, max(move, 0.0), w.rsi), _blend(loss, max(-move, 0.0), w.rsi)
        span, band_span = _blend(span, reach, w.atr), _blend(band_span, reach, w.band)
    steps = bars - 1  # changes seen so far
    state = (None if math.isnan(s.upper) else s.upper, None if math.isnan(s.lower) else s.lower, s.direction, s.close)
    (upper, lower, direction, _), line, shown = trend_step(state, (high + low) / 2, w.multiplier * band_span if steps >= w.band else NAN, close)
    rsi = None if steps < w.rsi else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
    made = (bars, smooth if bars >= w.smooth else None, rsi, span if steps >= w.atr else None, None if math.isnan(line) else line, shown)
    return Levels(at, bars, close, smooth, gain, loss, span, band_span, NAN if upper is None else upper, NAN if lower is None else lower, direction), made


class OnlineIndicators(StatefulProcessor):
    def __init__(self, windows: Windows, idle: timedelta):
        self.windows, self.idle = windows, idle // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.levels = handle.getValueState("levels", LEVELS)
        self.waiting = handle.getListState("waiting", BAR)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest, passed = None, timerValues.getCurrentWatermarkInMs() * MS
        for frame in rows:
            at = frame["ts"].astype("datetime64[us]").astype("int64")
            frame, at = frame[at > passed], at[at > passed]  # what the watermark has passed is final
            if frame.empty:
                continue
            self.waiting.appendList(list(zip(at.tolist(), frame["high"].tolist(), frame["low"].tolist(), frame["close"].tolist())))
            earliest = int(at.min()) if earliest is None else min(earliest, int(at.min()))
        if earliest is not None:
            self.handle.registerTimer(earliest // MS)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * MS
        bars = sorted(self.waiting.get()) if self.waiting.exists() else []
        final = {b[0]: b for b in bars if b[0] <= passed}  # of bars with one time the greatest counts
        rest = [b for b in bars if b[0] > passed]
        state = Levels(*self.levels.get()) if self.levels.exists() else Levels()
        out = []
        for at, high, low, close in final.values():
            if state.bars and at - state.at > self.idle:
                state = Levels()
            state, made = advance(state, at, high, low, close, self.windows)
            out.append((key[0], pd.Timestamp(at, unit="us"), *made))
        if final:
            self.levels.update(tuple(state))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if rest:
            self.handle.registerTimer(rest[0][0] // MS)
        elif state.bars and state.at + self.idle < passed:
            self.levels.clear()
        elif state.bars:
            self.handle.registerTimer((state.at + self.idle) // MS + 1)
        if out:
            yield pd.DataFrame(out, columns=["symbol", "ts", "bars", "smoothed", "rsi", "atr", "supertrend", "direction"])

    def close(self) -> None:
        pass


def online_indicators(bars: DataFrame, lateness: str, idle: timedelta, windows: Windows = Windows()) -> DataFrame:
    """(symbol, ts, bars, smoothed, rsi, atr, supertrend, direction) of each bar that the watermark has passed, as an
    append stream. `bars` streams (symbol, ts, high, low, close) in any order; bars later than `lateness` are dropped,
    of repeated ones (same symbol and time) the greatest counts. Needs the state store set by `state_store`."""
    timed = bars.select("symbol", "ts", "high", "low", "close").withWatermark("ts", lateness)
    return timed.groupBy("symbol").transformWithStateInPandas(OnlineIndicators(windows, idle), OUT, "Append", "EventTime")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that processors with several states and timers need, set while a query starts and runs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
