import datetime as dt
import math
import statistics

import pytest
from helpers import approx, bars, d, rows
from pyspark.sql import functions as F

from tidemark.operators import asof, portfolio as pf, prices as px, ranks as rk, scoring as sc, spells as sp


def series(n, growth=1.001):
    return [100 * growth**i for i in range(n)]


def test_price_factors_against_direct_formulas(spark):
    closes = [100 + 10 * math.sin(i / 7) + i * 0.05 for i in range(300)]
    out = [r.asDict() for r in px.price_factors(bars(spark, closes)).orderBy("date").collect()]
    i = 280
    rets = [closes[j] / closes[j - 1] - 1 for j in range(i - 59, i + 1)]
    assert approx(out[i]["ret_1m"], closes[i] / closes[i - 21] - 1)
    assert approx(out[i]["ret_12m_ex_1m"], closes[i - 21] / closes[i - 252] - 1)
    assert approx(out[i]["sma200_gap"], closes[i] / statistics.mean(closes[i - 199 : i + 1]) - 1)
    assert approx(out[i]["vol_60d"], statistics.stdev(rets) * math.sqrt(252))
    assert approx(out[i]["drawdown_252d"], closes[i] / max(closes[i - 251 : i + 1]) - 1)
    assert out[198]["sma200_gap"] is None and out[199]["sma200_gap"] is not None
    assert out[59]["vol_60d"] is None and out[60]["vol_60d"] is not None
    assert out[250]["drawdown_252d"] is None and out[251]["drawdown_252d"] is not None


def test_rolling_frames_of_any_length(spark):
    values = [((i * 7919) % 101) / 3 for i in range(60)]
    df = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(values)], "symbol string, date int, x double")
    w = px._by_symbol()
    out = px.rolling(df, w, {f"{k}{n}": ("x", k, n) for k in ("sum", "max", "min") for n in (1, 5, 8, 23)}).orderBy("date").collect()
    for n in (1, 5, 8, 23):
        for i, r in enumerate(out):
            window = values[i - n + 1 : i + 1]
            for k, f in (("sum", sum), ("max", max), ("min", min)):
                assert (r[f"{k}{n}"] is None) if i + 1 < n else approx(r[f"{k}{n}"], f(window), 1e-9)


def test_event_features_do_not_look_ahead(spark):
    b = bars(spark, series(800), business=True, start="2020-01-01")
    dates = [r[0] for r in b.select("date").orderBy("date").collect()]
    t = dates[500]
    later = b.withColumn("adj_close", F.when(F.col("date") > F.lit(t), F.col("adj_close") * 10).otherwise(F.col("adj_close")))
    events = spark.createDataFrame([("A", t), ("A", dates[100])], "symbol string, rec_date date")
    idx = b.withColumn("symbol", F.lit("SPY"))
    one, two = (rows(px.event_features(events, x, idx).select("rec_date", *[F.round(c, 12) for c in px.EVENT_FEATURES])) for x in (b, later))
    assert one == two
    out = {r["rec_date"]: r for r in px.event_features(events, b, idx).collect()}
    assert approx(out[t]["ret_1m"], 1.001**21 - 1) and approx(out[t]["rel_ret_3m"], 0.0) and out[t]["ret_36m"] is None
    assert out[dates[100]]["ret_1m"] is None


def test_event_volatility_is_population_and_factor_volatility_is_sample(spark):
    closes = [100 + 5 * math.sin(i) for i in range(300)]
    b = bars(spark, closes)
    last = b.agg(F.max("date")).first()[0]
    ev = px.event_features(spark.createDataFrame([("A", last)], "symbol string, rec_date date"), b, b.withColumn("symbol", F.lit("SPY"))).first()["vol_60d"]
    f = px.price_factors(b).orderBy(F.col("date").desc()).first()["vol_60d"]
    assert approx(ev / f, math.sqrt(59 / 60), 1e-9)


def test_later_splits(spark):
    b = bars(spark, [10.0] * 300)
    dates = [r[0] for r in b.select("date").orderBy("date").collect()]
    splits = spark.createDataFrame([("A", dates[200], 4.0), ("A", dates[250], 2.0), ("A", dates[250], 2.0)], "symbol string, date date, ratio double")
    out = {r["date"]: r["raw_close"] for r in px.with_raw_close(b, splits).collect()}
    assert (out[dates[100]], out[dates[199]], out[dates[200]], out[dates[220]], out[dates[280]]) == (80.0, 80.0, 20.0, 20.0, 10.0)


def test_asof_variants_against_search(spark):
    left = [("A", d("2024-01-10")), ("A", d("2024-01-12")), ("A", d("2024-02-20")), ("B", d("2024-01-10")), ("A", d("2024-01-10"))]
    right = [("A", d("2024-01-10"), 1), ("A", d("2024-01-11"), 2), ("A", d("2024-01-15"), None)]
    l = spark.createDataFrame(left, "symbol string, t date")
    r = spark.createDataFrame(right, "symbol string, u date, v int")
    for direction in ("backward", "forward"):
        for strict in (False, True):
            for tol in (None, 3):
                for block in (None, "month"):
                    got = rows(asof.asof_join(l, r, ["symbol"], "t", "u", ["v"], direction=direction, strict=strict, tolerance_days=tol, matched_time="at", block=block).select("symbol", "t", F.col("at").cast("string")).na.fill("-"))
                    want = []
                    for s, t in left:
                        ok = [u for q, u, _ in right if q == s and ((u < t if strict else u <= t) if direction == "backward" else (u > t if strict else u >= t))]
                        hit = (max(ok) if direction == "backward" else min(ok)) if ok else None
                        if hit and tol is not None and abs((t - hit).days) > tol:
                            hit = None
                        want.append((s, t, str(hit) if hit else "-"))
                    assert got == sorted(want), (direction, strict, tol, block)


def test_percentiles_match_average_ranks_with_ties(spark):
    import pandas as pd

    vals = [0.1, 0.1, -3.0, 0.0, 7e5, 7e5, 7e5, None, 1e-9, -2e-8, 5.0]
    df = spark.createDataFrame([(f"s{i}", "d", v) for i, v in enumerate(vals)], "symbol string, as_of string, x double")
    for up in (True, False):
        got = {r["symbol"]: r["x_pct"] for r in rk.percentiles(df, ["symbol"], ["as_of"], {"x": up}).collect()}
        want = pd.Series(vals, dtype=float).rank(pct=True, ascending=up)
        assert all(approx(got[f"s{i}"], want[i]) for i in range(len(vals)) if vals[i] is not None)


def test_quantiles_interpolate(spark):
    import numpy as np

    vals = [((i * 37) % 101) / 7 - 5 for i in range(57)] + [3.0] * 20
    df = spark.createDataFrame([(1, float(v)) for v in vals], "g int, x double")
    r = rk.quantiles(df, ["g"], "x", {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    assert all(approx(r[n], float(np.percentile(vals, q)), 1e-9) for n, q in (("a", 25), ("b", 50), ("c", 90)))


def test_score_directions_and_missing_factors(spark):
    df = spark.createDataFrame([("A", d("2024-01-31"), 0.1, 10.0, None), ("B", d("2024-01-31"), 0.2, 20.0, None), ("C", d("2024-01-31"), 0.3, 30.0, None), ("D", d("2024-01-31"), None, None, None)], "symbol string, as_of date, roe double, pe double, vol_60d double")
    out = {r["symbol"]: r for r in sc.score(df).collect()}
    assert out["C"]["quality"] > out["A"]["quality"] and out["A"]["value"] > out["C"]["value"] and out["A"]["risk"] is None
    assert out["D"]["total"] is None and len(out) == 4


def spell_table(spark):
    return spark.createDataFrame([("A", d("2020-01-01"), None), ("B", d("2010-01-01"), d("2021-01-01")), ("B", d("2022-06-01"), None), ("A", d("2020-01-15"), None)], "symbol string, start date, end date")


def test_members_only(spark):
    p = spark.createDataFrame([("A", d("2019-12-31")), ("A", d("2020-01-31")), ("B", d("2020-06-30")), ("B", d("2021-01-01")), ("B", d("2022-06-30")), ("C", d("2020-06-30"))], "symbol string, as_of date")
    assert rows(sp.members_only(p, spell_table(spark))) == [("A", d("2020-01-31")), ("B", d("2020-06-30")), ("B", d("2022-06-30"))]
    assert sp.members_only(p, None).count() == 6


def test_member_counts_keep_empty_dates(spark):
    dates = spark.createDataFrame([(d(x),) for x in ("2009-01-01", "2010-01-01", "2020-01-20", "2021-01-01", "2022-06-01")], "as_of date")
    assert rows(sp.member_counts(dates, spell_table(spark))) == [(d("2009-01-01"), 0), (d("2010-01-01"), 1), (d("2020-01-20"), 3), (d("2021-01-01"), 2), (d("2022-06-01"), 3)]


T1, T2, T3 = d("2024-01-31"), d("2024-02-29"), d("2024-03-31")


def book(spark):
    scores = spark.createDataFrame([(T1, "A", 90.0), (T1, "B", 80.0), (T1, "C", 10.0), (T2, "A", 10.0), (T2, "B", 80.0), (T2, "C", 90.0), (T3, "A", 1.0)], "as_of date, symbol string, total double")
    fwd = spark.createDataFrame([(T1, "A", 0.10), (T1, "B", 0.0), (T1, "C", 0.0), (T2, "A", 0.0), (T2, "B", 0.0), (T2, "C", 0.20), (T3, "A", None)], "as_of date, symbol string, fwd double")
    return scores, fwd


@pytest.mark.parametrize("bps,net", [(0.0, [0.05, 0.10]), (100.0, [0.04, 0.09])])
def test_rebalance(spark, bps, net):
    scores, fwd = book(spark)
    out = pf.rebalance(scores, fwd, "total", 2, bps).orderBy("as_of").collect()
    assert [round(r["strategy"], 12) for r in out] == net and [r["turnover"] for r in out] == [0.5, 0.5]


def test_skipped_date_keeps_the_last_book(spark):
    scores = spark.createDataFrame([(T1, "A", 1.0), (T2, "B", 1.0), (T3, "A", 1.0)], "as_of date, symbol string, total double")
    fwd = spark.createDataFrame([(T1, "A", 0.1), (T2, "B", None), (T3, "A", 0.1)], "as_of date, symbol string, fwd double")
    out = pf.rebalance(scores, fwd, "total", 1).orderBy("as_of").collect()
    assert [r["turnover"] for r in out] == [0.5, 0.0]


def test_sector_benchmark_mean(spark):
    scores = spark.createDataFrame([(T1, "A", 2.0), (T1, "B", 1.0)], "as_of date, symbol string, total double")
    fwd = spark.createDataFrame([(T1, "A", 0.1), (T1, "B", 0.0), (T1, "XLK", 0.04), (T1, "XLE", 0.02)], "as_of date, symbol string, fwd double")
    uni = spark.createDataFrame([("A", "Technology"), ("B", "Energy")], "symbol string, sector string")
    assert approx(pf.rebalance(scores, fwd, "total", 2, 0.0, pf.sector_benchmark(uni)).first()["sector_benchmark"], 0.03)


def test_forward_uses_the_global_grid(spark):
    prices = spark.createDataFrame([("A", T1, 10.0), ("A", T3, 20.0), ("B", T2, 5.0), ("B", T3, 6.0)], "symbol string, as_of date, adj_close double")
    got = {(r["symbol"], r["as_of"]): r["fwd"] for r in pf.forward_returns(prices, prices).collect()}
    assert got[("A", T1)] is None and approx(got[("B", T2)], 0.2) and got[("A", T3)] is None


def test_performance(spark):
    def stats(rets, name="x"):
        df = spark.createDataFrame([(dt.date(2024, i + 1, 1), name, r) for i, r in enumerate(rets)], "as_of date, name string, ret double")
        return pf.performance(df).first()

    p = stats([0.10, -0.10, 0.10, 0.10])
    assert approx(p["max_drawdown"], -0.1) and approx(p["cagr"], (1.1 * 0.9 * 1.1 * 1.1) ** 3 - 1) and p["sortino"] is None
    up = stats([0.01, 0.02, 0.03])
    assert up["sortino"] is None and up["max_drawdown"] == 0.0
    both = stats([0.10, -0.10, 0.10, -0.02])
    down = statistics.stdev([-0.10, -0.02]) * math.sqrt(12)
    assert approx(both["sortino"], statistics.mean([0.10, -0.10, 0.10, -0.02]) * 12 / down)
    assert stats([0.1, -1.0, 0.5])["max_drawdown"] == -1.0
