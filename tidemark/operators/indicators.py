"""Bar resampling and technical indicators. Bars carry (symbol, tf, ts, open, high, low, close, volume),
unique per key, so a window over (symbol, tf) is bounded by the calendar at that bar size."""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType

OPEN_MINUTE = 570  # 09:30
MIN_BARS = 30
# fixed values: label -> (stored interval, minutes of the coarser bar or None)
TIMEFRAMES = {
    "1m": ("1m", None), "5m": ("5m", None), "15m": ("15m", None), "30m": ("30m", None), "60m": ("60m", None),
    "120m": ("60m", 120), "240m": ("60m", 240), "480m": ("60m", 480),
}


def _ohlcv(order: str = "ts", has_bars: bool = True) -> list[Column]:
    first, high, low, last = ("open", "high", "low", "close") if has_bars else ("price",) * 4
    return [
        F.min_by(first, order).alias("open"), F.max(high).alias("high"), F.min(low).alias("low"), F.max_by(last, order).alias("close"),
        F.sum("volume").alias("volume"),
    ]


def intraday_window(minutes: int, ts: str = "ts") -> Column:
    """Tumbling bins anchored at 09:30. The offset is taken from midnight, so it folds into one bin."""
    return F.window(F.col(ts), f"{minutes} minutes", f"{minutes} minutes", f"{OPEN_MINUTE % minutes} minutes")


def bars_from_ticks(ticks: DataFrame, minutes: int) -> DataFrame:
    """(symbol, ts, price, volume) -> bars. Ticks collapse map-side, so a hot symbol costs one row per bin."""
    out = ticks.groupBy("symbol", intraday_window(minutes).alias("w")).agg(*_ohlcv(has_bars=False))
    return out.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def resample_intraday(bars: DataFrame, minutes: int) -> DataFrame:
    out = bars.groupBy("symbol", intraday_window(minutes).alias("w")).agg(*_ohlcv())
    return out.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def resample_weekly(bars: DataFrame, date: str = "date") -> DataFrame:
    """Monday-to-Sunday bars labelled by the Sunday."""
    week = F.date_add(F.date_trunc("week", date).cast("date"), 6)
    return bars.groupBy("symbol", week.alias(date)).agg(*_ohlcv(date))


def _frame(by: Sequence[str], ts: str) -> Window:
    return Window.partitionBy(*by).orderBy(ts)


#: decay (in e-folds) after which what is older no longer shows in a double: e**-40 = 4e-18
DECAY = 40.0


def smoothed(df: DataFrame, by: Sequence[str], ts: str, columns: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Adds exponentially smoothed columns, name -> (column, n), weight 1/n, seeded with the first non-NULL value and
    NULL until n of them. Over NULLs the last value stands, and its weight decays by one step per row, so the value
    after a gap counts for more.

    Every value is an affine step s -> a s + b, and steps compose: (a, b) after (c, d) is (a c, a d + b). A row takes in
    the 1, 2, 4, ... values before it, so a few passes of one ordering give all columns their whole past, until what is
    left out has decayed by DECAY e-folds. Rows without a value take no part, however long a gap is.
    """
    w = _frame(by, ts)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    over = f"OVER (PARTITION BY {', '.join(f'`{c}`' for c in by)} ORDER BY `{ts}`)"
    sources = {c: f"_{i}" for i, c in enumerate(dict.fromkeys(c for c, _ in columns.values()))}
    names = {name: f"_s{i}" for i, name in enumerate(columns)}
    out = df.withColumn("_row", F.row_number().over(w))
    out = out.select("*", *[F.count(c).over(upto).alias(f"{p}_seen") for c, p in sources.items()], *[F.when(F.col(c).isNotNull(), F.col("_row")).alias(f"{p}_at") for c, p in sources.items()])
    out = out.select("*", *[(F.col("_row") - F.expr(f"lag({p}_at) IGNORE NULLS {over}")).alias(f"{p}_gap") for p in sources.values()])

    def step(name: str) -> list[Column]:
        c, n = columns[name]
        gap = F.col(f"{sources[c]}_gap")
        old = F.when(gap == 1, F.lit(1 - 1 / n)).otherwise(F.pow(F.lit(1 - 1 / n), gap.cast("double")))
        weight = F.when(gap.isNull(), F.lit(1.0)).when(gap == 1, F.lit(1 / n)).otherwise((1 / n) / (old + 1 / n))
        there = F.col(c).isNotNull()
        return [F.when(there, 1 - weight).alias(f"{names[name]}_a"), F.when(there, weight * F.col(c)).alias(f"{names[name]}_b")]

    scanned = [name for name, (_, n) in columns.items() if n > 1]
    out = out.select("*", *[x for name in scanned for x in step(name)])
    reach = {name: DECAY / -math.log(1 - 1 / columns[name][1]) for name in scanned}
    span = 1
    while now := [names[name] for name in scanned if span < reach[name]]:
        before = [F.expr(f"lag({p}_{x}, {span}) IGNORE NULLS {over}").alias(f"{p}_{x}0") for p in now for x in "ab"]
        taken = {f"{p}_b": F.col(f"{p}_b") + F.coalesce(F.col(f"{p}_a") * F.col(f"{p}_b0"), F.lit(0.0)) for p in now}
        taken |= {f"{p}_a": F.col(f"{p}_a") * F.coalesce(F.col(f"{p}_a0"), F.lit(0.0)) for p in now}
        out = out.select("*", *before).withColumns(taken).drop(*[f"{p}_{x}0" for p in now for x in "ab"])
        span *= 2
    value = lambda name, c, n: F.last(F.col(f"{names[name]}_b") if n > 1 else F.col(c), ignorenulls=True).over(upto)
    seen = lambda c, n: F.col(f"{sources[c]}_seen") >= n
    return out.select(*df.columns, *[F.when(seen(c, n), value(name, c, n)).alias(name) for name, (c, n) in columns.items()])


def true_range(w: Window) -> Column:
    prev = F.lag("close").over(w)
    spread = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    return F.when(prev.isNotNull(), spread)


def indicators(bars: DataFrame, by: Sequence[str] = ("symbol",), ts: str = "date", rsi_n: int = 14, atr_n: int = 14, iix_n: int = 21) -> DataFrame:
    """Per bar: change %, RSI, true range, ATR, alligator lines, intensity index raw and rolled.
    RSI is NULL during warm-up; a window without losses gives 100."""
    by = list(by)
    w = _frame(by, ts)
    prev = F.lag("close").over(w)
    delta = F.col("close") - prev
    base = bars.select(
        *by, ts, "open", "high", "low", "close", "volume",
        F.when(prev != 0, (F.col("close") / F.nullif(prev, F.lit(0.0)) - 1) * 100).alias("change_pct"),
        F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))).alias("_gain"), F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0))).alias("_loss"),
        true_range(w).alias("true_range"), ((F.col("high") + F.col("low")) / 2).alias("_median"),
        intensity_raw().alias("iix_raw"),
    )
    sm = smoothed(base, by, ts, {
        "_avg_gain": ("_gain", rsi_n), "_avg_loss": ("_loss", rsi_n), "atr": ("true_range", atr_n),
        "_jaw": ("_median", 13), "_teeth": ("_median", 8), "_lips": ("_median", 5),
    })
    roll = w.rowsBetween(1 - iix_n, 0)
    volume = F.sum("volume").over(roll)
    g, l = F.col("_avg_gain"), F.col("_avg_loss")
    return sm.select(
        *by, ts, "open", "high", "low", "close", "volume", "change_pct",
        F.when(g.isNotNull(), F.when(l == 0, 100.0).otherwise(100 - 100 / (1 + g / F.nullif(l, F.lit(0.0))))).alias("rsi"),
        "true_range", "atr", F.lag("_jaw", 8).over(w).alias("jaw"), F.lag("_teeth", 5).over(w).alias("teeth"), F.lag("_lips", 3).over(w).alias("lips"),
        "iix_raw",
        F.when((F.count("iix_raw").over(roll) == iix_n) & (volume != 0), 100 * F.sum("iix_raw").over(roll) / F.nullif(volume, F.lit(0).cast("long"))).alias("iix"),
    )


def intensity_raw() -> Column:
    spread = F.col("high") - F.col("low")
    return F.coalesce((2 * F.col("close") - F.col("high") - F.col("low")) / F.nullif(spread, F.lit(0.0)) * F.col("volume"), F.lit(0.0))


def alligator_state() -> Column:
    up = (F.col("lips") > F.col("teeth")) & (F.col("teeth") > F.col("jaw"))
    down = (F.col("lips") < F.col("teeth")) & (F.col("teeth") < F.col("jaw"))
    return F.when(up, "up").when(down, "down").otherwise("sleeping")


def trend_step(state: tuple, mid: float, band: float, close: float) -> tuple[tuple, float, int]:
    """One bar of the ratcheting band: state = (upper, lower, direction, previous close) or None."""
    if band != band:  # no ATR yet
        return (None, None, 0, close), float("nan"), 0
    up, low = mid + band, mid - band
    upper, lower, direction, last = state
    if upper is None:
        direction = 1 if close >= mid else -1
    else:
        if up >= upper and last <= upper:
            up = upper
        if low <= lower and last >= lower:
            low = lower
        direction = (-1 if close < low else 1) if direction == 1 else (1 if close > up else -1)
    return (up, low, direction, close), (low if direction == 1 else up), direction


def supertrend(bars: DataFrame, by: Sequence[str] = ("symbol",), ts: str = "date", period: int = 10, multiplier: float = 3.0) -> DataFrame:
    """Band value and direction per bar (+1 up, -1 down, 0 before the first ATR).

    The ratchet depends on its own past in a way no window frame expresses, so sorted partitions stream
    through a small stepper: only the current state of the current key is held, never a whole group.
    """
    by = list(by)
    w = _frame(by, ts)
    base = bars.select(*by, ts, "high", "low", "close", true_range(w).alias("_tr"))
    atr = smoothed(base, by, ts, {"_atr": ("_tr", period)})
    ready = atr.select(*by, ts, ((F.col("high") + F.col("low")) / 2).alias("mid"), (F.col("_atr") * multiplier).alias("band"), "close")
    ordered = ready.repartition(*by).sortWithinPartitions(*by, ts)
    schema = ready.select(*by, ts).schema.add("supertrend", DoubleType()).add("direction", IntegerType())
    names = schema.fieldNames()

    def walk(batches):
        key, state = None, (None, None, 0, float("nan"))
        for pdf in batches:
            keys = list(zip(*[pdf[c] for c in by]))
            value, direction = np.empty(len(pdf)), np.empty(len(pdf), dtype="int32")
            for i, (k, mid, band, close) in enumerate(zip(keys, pdf["mid"].to_numpy(), pdf["band"].to_numpy(), pdf["close"].to_numpy())):
                if k != key:
                    key, state = k, (None, None, 0, float("nan"))
                state, value[i], direction[i] = trend_step(state, mid, band, close)
            out = pdf[[*by, ts]].assign(supertrend=value, direction=direction)
            yield out[names]

    out = ordered.mapInPandas(walk, schema)
    return out.select(*by, ts, F.when(~F.isnan("supertrend"), F.col("supertrend")).alias("supertrend"), "direction")


def snapshots(bars: DataFrame, by: Sequence[str] = ("symbol", "tf"), ts: str = "ts") -> DataFrame:
    """Latest indicator values of every (symbol, timeframe) with at least 30 bars."""
    by = list(by)
    full = indicators(bars, by, ts).join(supertrend(bars, by, ts), [*by, ts])
    fields = ["close", "change_pct", "rsi", "atr", "supertrend", "direction", "lips", "teeth", "jaw", "iix"]
    last = full.groupBy(*by).agg(F.max_by(F.struct(*fields), ts).alias("s"), F.count(F.lit(1)).alias("bars")).where(F.col("bars") >= MIN_BARS)
    return last.select(*by, "bars", "s.*").withColumn("alligator", alligator_state()).drop("lips", "teeth", "jaw")


def all_timeframes(intraday: DataFrame, daily: DataFrame) -> DataFrame:
    """Stored intraday intervals (column `interval`), the coarser bars built from them, daily and weekly
    bars, as one long table keyed (symbol, tf, ts)."""
    cols = ["symbol", "tf", "ts", "open", "high", "low", "close", "volume"]
    stored = intraday.withColumnRenamed("interval", "tf").select(*cols)
    out = stored
    for label, (source, minutes) in TIMEFRAMES.items():
        if minutes:
            out = out.unionByName(resample_intraday(stored.where(F.col("tf") == source), minutes).withColumn("tf", F.lit(label)).select(*cols))
    day = lambda d, label: d.withColumn("tf", F.lit(label)).withColumn("ts", F.col("date").cast("timestamp_ntz")).select(*cols)
    return out.unionByName(day(daily, "daily")).unionByName(day(resample_weekly(daily), "weekly"))


def technical_votes(snap: DataFrame) -> DataFrame:
    """Mean of four votes and its label. Missing values vote neutral."""
    above = lambda c, hi, lo: F.when(c > hi, 1).when(c < lo, -1).otherwise(0)
    rsi = F.when(F.col("rsi") < 30, 1).when(F.col("rsi") > 70, -1).otherwise(0)
    ali = F.when(F.col("alligator") == "up", 1).when(F.col("alligator") == "down", -1).otherwise(0)
    score = (rsi + F.col("direction") + ali + above(F.col("iix"), 10, -10)) / 4
    label = F.when(score > 0.5, "Strong buy").when(score > 0.1, "Buy").when(score < -0.5, "Strong sell").when(score < -0.1, "Sell").otherwise("Neutral")
    return snap.withColumn("vote", score).withColumn("label", label)


__all__ = ["bars_from_ticks", "resample_intraday", "resample_weekly", "smoothed", "indicators", "supertrend", "snapshots", "all_timeframes", "technical_votes"]
