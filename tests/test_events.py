import datetime as dt

from helpers import approx, bars, d, rows
from pyspark.sql import functions as F

from tidemark.operators import events as ev, learning as lr, metrics as mt, prices as px
from tidemark.sources import text_files as tf


def test_market_cap_text(spark):
    df = spark.createDataFrame([("$152B",), ("$177M",), ("text",), (None,)], "t string")
    assert [r[0] for r in df.select(tf.parse_market_cap(F.col("t"))).collect()] == [152e9, 177e6, None, None]


def test_two_digit_years(spark):
    df = spark.createDataFrame([("02/20/15",), ("12/31/99",), ("01/05/68",)], "t string")
    assert [r[0] for r in df.select(tf.two_digit_date(F.col("t"))).collect()] == [d("2015-02-20"), d("1999-12-31"), d("2068-01-05")]


def sheet(spark):
    cols = "rec_date date, company string, ticker_raw string, ticker string, delisted boolean, closed_date date, market_cap double, team string, risk_rating double, rec_price double, return double, spx_return double, excess_return double, price_unavailable boolean"
    row = lambda day, t, ret: (d(day), f"{t} Inc", t, t, False, None, 1e9, "Tom", None, 1.0, ret, None, None, False)
    return spark.createDataFrame([row("2015-02-20", "FEYE", 0.5), row("2016-01-01", "OLD", None)], cols)


def test_merge_sources(spark):
    new = spark.createDataFrame([(d("2015-02-20"), "MNDT", "Mandiant", "BUY"), (d("2020-05-20"), "MNDT", "Mandiant", "BUY"), (d("2020-01-16"), "A", "Nice", "SELL")], "date date, symbol string, name string, recommendation string")
    got = {(r["rec_date"], r["symbol"]): r for r in ev.merge_sources(sheet(spark), new).collect()}
    both, later, fixed, only = got[(d("2015-02-20"), "MNDT")], got[(d("2020-05-20"), "MNDT")], got[(d("2020-01-16"), "NICE")], got[(d("2016-01-01"), "OLD")]
    assert (both["source"], later["source"], only["source"]) == ("both", "newrecs", "xlsx")
    assert (both["ticker_at_rec"], later["ticker_at_rec"]) == ("FEYE", "MNDT")
    assert both["mf_return_end"] == d("2020-04-08") and only["mf_return_end"] is None
    assert (both["buy_number"], later["buy_number"], fixed["buy_number"]) == (1, 2, None) and later["is_repeat"] and not fixed["is_repeat"]


def recs(spark, items):
    return spark.createDataFrame([(d(x), s, s, a) for x, s, a in items], "rec_date date, symbol string, yf_symbol string, action string")


def test_forward_returns_count_from_the_recommendation(spark):
    b = bars(spark, [100.0 + i for i in range(500)], "A", "2020-01-01").where("date not in (date'2020-03-01', date'2020-03-31') and not date between date'2020-06-01' and date'2020-06-06'")
    idx = bars(spark, [50.0 + i for i in range(900)], "SPY", "2019-06-01")
    out = {r["rec_date"]: r for r in ev.forward_returns(recs(spark, [("2020-03-01", "A", "BUY"), ("2020-06-01", "A", "BUY"), ("2021-03-01", "A", "BUY"), ("2020-03-05", "Z", "BUY")]), b, idx).collect()}
    px_at = lambda day: 100.0 + (d(day) - d("2020-01-01")).days
    ix_at = lambda day: 50.0 + (d(day) - d("2019-06-01")).days
    r = out[d("2020-03-01")]
    assert r["entry_date"] == d("2020-03-02")  # first bar on or after
    assert approx(r["ret_30d"], px_at("2020-04-01") / px_at("2020-03-02") - 1)  # 03-31 is missing: next bar, not entry + 30
    assert approx(r["spy_30d"], ix_at("2020-04-01") / ix_at("2020-03-02") - 1)
    late = out[d("2020-06-01")]  # next bar is six days away
    assert late["entry_date"] is None and late["ret_30d"] is None and late["spy_90d"] is None
    young = out[d("2021-03-01")]
    assert young["ret_30d"] is not None and young["ret_365d"] is None and young["excess_365d"] is None
    assert out[d("2020-03-05")]["entry_date"] is None
    labels = {r["rec_date"]: r["beat_spy_30d"] for r in ev.beat_label(ev.forward_returns(recs(spark, [("2020-03-01", "A", "BUY"), ("2020-06-01", "A", "BUY")]), b, idx), "30d").collect()}
    assert labels[d("2020-06-01")] is None and labels[d("2020-03-01")] in (True, False)


def test_controls(spark):
    b = bars(spark, [1.0] * 500, "AAA", "2020-01-01").unionByName(bars(spark, [1.0] * 500, "BBB", "2020-01-01")).unionByName(bars(spark, [1.0] * 500, "CCC", "2020-01-01")).unionByName(bars(spark, [1.0] * 500, "SPY", "2020-01-01")).unionByName(bars(spark, [1.0] * 50, "NEW", "2021-03-20"))
    picks = recs(spark, [("2021-04-01", "AAA", "BUY")])
    assert rows(ev.sample_controls(picks, b), "symbol") == [("BBB",), ("CCC",)]
    assert ev.sample_controls(picks, b, per_pick=1).count() == 1
    assert rows(ev.sample_controls(picks, b, per_pick=1)) == rows(ev.sample_controls(picks, b.orderBy(F.rand()), per_pick=1))


def test_exit_uses_the_first_buy(spark):
    b = bars(spark, [100.0 + i for i in range(800)], "A", "2020-01-01")
    idx = bars(spark, [100.0] * 900, "SPY", "2019-12-01")
    r = ev.forward_returns(recs(spark, [("2020-02-01", "A", "BUY"), ("2020-05-01", "A", "BUY"), ("2020-08-01", "A", "SELL"), ("2020-01-05", "A", "SELL"), ("2021-12-01", "A", "REDUCE")]), b, idx)
    out = {x["sell"]: x for x in ev.exit_review(r, b, idx).collect()}
    assert set(out) == {d("2020-08-01"), d("2021-12-01")}
    at = lambda day: 100.0 + (d(day) - d("2020-01-01")).days
    x = out[d("2020-08-01")]
    assert x["buy"] == d("2020-02-01") and approx(x["hold_ret"], at("2020-08-01") / at("2020-02-01") - 1) and approx(x["after_365d"], at("2021-08-01") / at("2020-08-01") - 1)
    assert out[d("2021-12-01")]["after_365d"] is None


def test_trimmed_mean_drops_the_largest(spark):
    df = spark.createDataFrame([(d("2020-01-01") + dt.timedelta(days=i), "A", float(i % 150), float(i)) for i in range(250)], "rec_date date, symbol string, ret double, ex double")
    out = ev.trimmed_mean(df, "ret", "ex").first()
    # two rows go: ret 149 is row 149; ret 148 is row 148 (rows 248, 249 have ret 98, 99)
    keep = [float(i) for i in range(250) if i not in (148, 149)]
    assert out["dropped"] == 2 and approx(out["mean_trimmed"], sum(keep) / len(keep), 1e-9)


def test_auc_ties_and_average_precision(spark):
    data = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.4), (0, 0.4), (1, 0.4), (0, 0.1)]
    df = spark.createDataFrame([("g", y, s, i) for i, (y, s) in enumerate(data)], "g string, y int, s double, i int")
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for ya, a in data if ya for yb, b in data if not yb]
    assert approx(mt.roc_auc(df, ["g"], "y", "s").first()["roc_auc"], sum(pairs) / len(pairs))
    want, seen, hit = 0.0, 0, 0
    for s in sorted({s for _, s in data}, reverse=True):
        new = [y for y, v in data if v == s]
        seen, hit = seen + len(new), hit + sum(new)
        want += sum(new) / 3 * hit / seen
    assert approx(mt.average_precision(df, ["g"], "y", "s").first()["pr_auc"], want)
    assert mt.roc_auc(df.where("y = 1"), ["g"], "y", "s").first()["roc_auc"] is None


def test_top_decile_rounds_half_to_even(spark):
    def frame(n, positives):
        return spark.createDataFrame([("c", int(i in positives), float(n - i), i) for i in range(n)], "c string, y int, s double, i int")

    recall = lambda n, pos: mt.top_decile_recall(frame(n, pos), "c", "y", "s", "i").first()["top_decile_recall"]
    assert recall(25, {0, 1, 2}) == 2 / 3  # 2.5 -> 2
    assert recall(35, {0, 1, 2, 3, 4}) == 4 / 5  # 3.5 -> 4
    assert recall(3, {0}) == 1.0  # at least one


def test_label_median_is_over_members_with_outcomes(spark):
    days = [d("2020-01-31"), d("2020-02-29"), d("2020-03-31")]
    prices = spark.createDataFrame([(s, days[0], 1.0) for s in "ABCD"] + [("A", days[2], 2.0), ("B", days[2], 3.0), ("C", days[2], 11.0), ("A", days[1], 1.0)], "symbol string, as_of date, adj_close double")
    panel = spark.createDataFrame([("A", days[0], 1.0), ("B", days[0], 2.0), ("D", days[0], 3.0), ("A", days[1], 1.0), ("A", days[2], 1.0)], "symbol string, as_of date, f double")
    out = {(r["symbol"], r["as_of"]): r["target"] for r in lr.training_panel(panel, prices, None, horizon=2).collect()}
    assert approx(out[("A", days[0])], 1.0 - 1.5) and approx(out[("B", days[0])], 2.0 - 1.5) and out[("D", days[0])] is None and out[("A", days[1])] is None


def test_folds_never_train_on_open_labels(spark):
    days = [dt.date(2020 + i // 12, i % 12 + 1, 1) for i in range(30)]
    data = spark.createDataFrame([(x,) for x in days], "as_of date")
    for last, ahead in lr.fold_dates(data, 12, 12, 2):
        assert days.index(last) + 12 <= days.index(ahead[0])
    assert lr.fold_dates(data, 12, 12)[0] == (days[12], [days[24]])


def test_back_adjust(spark):
    raw = spark.createDataFrame([("A", d(f"2024-01-0{i}"), 100.0, f) for i, f in ((1, 1.0), (2, 2.0), (3, 1.0), (4, 3.0))], "symbol string, date date, close double, split_factor double")
    assert [r["close_adjusted"] for r in px.back_adjust(raw).orderBy("date").collect()] == [100 / 6, 100 / 3, 100 / 3, 100.0]


def test_control_draw_does_not_depend_on_the_index(spark):
    start = spark.range(1).select(F.to_date(F.lit("2018-01-01")).alias("d"))
    symbols = spark.range(300).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("symbol"))
    ends = symbols.crossJoin(start).select("symbol", F.explode(F.array("d", F.date_add("d", 2000))).alias("date"))
    picks = spark.range(60).select(F.date_add(F.to_date(F.lit("2020-01-01")), (F.col("id") * 7).cast("int")).alias("rec_date"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("symbol"))
    picks = picks.withColumn("yf_symbol", F.col("symbol"))
    drawn = [rows(ev.sample_controls(picks, ends, arcs=n), "rec_date", "symbol") for n in (1, 8, 256)]
    assert drawn[0] == drawn[1] == drawn[2] and len(drawn[0]) == 600
    used = [s for _, s in drawn[0]]
    assert len(set(used)) > 240 and max(used.count(s) for s in set(used)) <= 9  # 2 expected each
    strict = spark.createDataFrame([("T1", "EQUITY"), ("T2", "ETF"), ("T3", None)], "symbol string, quote_type string")
    assert {s for _, s in rows(ev.sample_controls(picks, ends, universe=strict), "rec_date", "symbol")} == {"T1"}


def test_opened_arcs_do_not_pass_through_the_driver(spark, monkeypatch):
    """A date opens as many arcs as its picks ask for, which the size of the table of dates does not tell."""
    plans = []
    real = ev.staged

    def kept(df, name="table"):
        if name == "controls":
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return real(df, name)

    monkeypatch.setattr(ev, "staged", kept)
    b = bars(spark, [1.0] * 500, "AAA", "2020-01-01").unionByName(bars(spark, [1.0] * 500, "BBB", "2020-01-01"))
    assert rows(ev.sample_controls(recs(spark, [("2021-04-01", "AAA", "BUY")]), b), "symbol") == [("BBB",)]
    assert plans and all("SortMergeJoin [_ring" in p and "BroadcastHashJoin [_ring" not in p for p in plans), plans


def test_forward_returns_never_join_back_to_their_probes(spark, tmp_path):
    """Small files may hold many rows: a side as long as the input must not look small enough to be sent to every task."""
    path = str(tmp_path / "recs")
    recs(spark, [("2020-03-01", "A", "BUY"), ("2020-03-01", "A", "HOLD"), ("2020-02-24", "A", "BUY"), ("2020-05-23", "A", "SELL")]).write.parquet(path)
    b = bars(spark, range(1, 200), "A", start="2020-01-01")
    out = ev.forward_returns(spark.read.parquet(path), b, b.withColumn("symbol", F.lit("SPY")), horizons={"6d": 6, "90d": 90, "same": 90})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2, plan  # with the index by day, and of the result with its recommendations
    day = lambda text: (d(text) - d("2020-01-01")).days + 1  # the close of that day
    for x in out.collect():
        start = day(str(x.rec_date))
        assert (x.entry_date, x.entry_close) == (x.rec_date, float(start))
        assert approx(x.ret_6d, (start + 6) / start - 1) and approx(x.excess_6d, 0.0)
        late = None if start + 90 > 199 else (start + 90) / start - 1
        assert x.ret_90d == x.ret_same and (x.ret_90d is None if late is None else approx(x.ret_90d, late))
