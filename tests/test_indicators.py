import math

import numpy as np
import pandas as pd
from helpers import approx, bars, d, rows
from pyspark.sql import functions as F

from tidemark.operators import indicators as ind


def collect(df):
    return df.orderBy("date").toPandas()


def test_rsi_extremes(spark):
    assert collect(ind.indicators(bars(spark, range(1, 40))))["rsi"].iloc[-1] == 100
    assert collect(ind.indicators(bars(spark, range(40, 1, -1))))["rsi"].iloc[-1] == 0


def test_atr_of_constant_range(spark):
    out = collect(ind.indicators(bars(spark, [100.0] * 30)))
    assert approx(out["atr"].iloc[-1], 2.0) and math.isnan(out["true_range"].iloc[0]) and math.isnan(out["atr"].iloc[13]) and approx(out["atr"].iloc[14], 2.0)


def test_smoothing_equals_the_recurrence_across_blocks(spark):
    closes = [100 + 30 * math.sin(i / 3) + (i % 17) for i in range(2300)]
    out = collect(ind.smoothed(bars(spark, closes), ["symbol"], "date", {"s5": ("close", 5), "s14": ("close", 14), "s1": ("close", 1)}))
    for n in (1, 5, 14):
        want = pd.Series(closes).ewm(alpha=1 / n, min_periods=n, adjust=False).mean()
        assert np.nanmax(np.abs(out[f"s{n}"] - want)) < 1e-9
        assert out[f"s{n}"].isna().sum() == n - 1


def test_smoothing_over_gaps_equals_pandas(spark):
    r = np.random.default_rng(3)
    values = np.where(r.random(700) < 0.3, np.nan, r.normal(50, 9, 700))
    values[:5], values[300:420] = np.nan, np.nan
    df = bars(spark, np.nan_to_num(values, nan=-1.0)).withColumn("close", F.when(F.col("close") != -1.0, F.col("close")))
    out = collect(ind.smoothed(df, ["symbol"], "date", {"s1": ("close", 1), "s5": ("close", 5), "s21": ("close", 21)}))
    for n in (1, 5, 21):
        want = pd.Series(values).ewm(alpha=1 / n, min_periods=n, adjust=False).mean()
        assert (out[f"s{n}"].isna() == want.isna()).all() and np.nanmax(np.abs(out[f"s{n}"] - want)) < 1e-9


def test_alligator_and_intensity(spark):
    out = collect(ind.indicators(bars(spark, [float(x) for x in range(60)])))
    first = {c: out[c].first_valid_index() for c in ("jaw", "teeth", "lips")}
    assert first == {"jaw": 20, "teeth": 12, "lips": 7}
    top = bars(spark, [100.0 + i for i in range(59)]).withColumn("high", F.col("close"))
    assert approx(collect(ind.indicators(top))["iix"].iloc[-1], 100.0)
    flat = bars(spark, [5.0], spread=0.0)
    assert collect(ind.indicators(flat))["iix_raw"].iloc[0] == 0


def test_supertrend_direction(spark):
    up = collect(ind.supertrend(bars(spark, np.linspace(10, 100, 60)))).iloc[-1]
    down = collect(ind.supertrend(bars(spark, np.linspace(100, 10, 60)))).iloc[-1]
    assert up["direction"] == 1 and up["supertrend"] < 100 and down["direction"] == -1 and down["supertrend"] > 10
    early = collect(ind.supertrend(bars(spark, np.linspace(10, 100, 60))))
    assert (early["direction"].iloc[:10] == 0).all() and early["direction"].iloc[10] != 0


def test_supertrend_keeps_symbols_apart(spark):
    a, b = bars(spark, np.linspace(10, 100, 40), "A"), bars(spark, np.linspace(100, 10, 40), "B")
    both = ind.supertrend(a.unionByName(b))
    assert rows(both.where("symbol = 'B'")) == rows(ind.supertrend(b))


def test_weekly_bars(spark):
    out = ind.resample_weekly(bars(spark, range(1, 15))).orderBy("date").first()
    assert (out["date"], out["open"], out["high"], out["low"], out["close"], out["volume"]) == (d("2024-01-07"), 1.0, 8.0, 0.0, 7.0, 7000)


def test_snapshot_needs_thirty_bars(spark):
    short, full = bars(spark, range(1, 30), "S"), bars(spark, range(1, 31), "L")
    both = short.unionByName(full).withColumn("tf", F.lit("daily")).withColumnRenamed("date", "ts")
    out = ind.technical_votes(ind.snapshots(both)).collect()
    assert [r["symbol"] for r in out] == ["L"] and out[0]["rsi"] == 100 and out[0]["alligator"] == "up" and out[0]["label"] in ("Buy", "Neutral", "Strong buy")
