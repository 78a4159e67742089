"""Stateful streams against their batch forms, for several orders and splits of the same rows; the interval index."""
import datetime as dt
import math
import random

import pytest
from helpers import d, rows
from pyspark.sql import functions as F

from tidemark.operators import indicators as ind, intervals, spells
from tidemark.streaming import jobs, online

BARS = "symbol string, hour int, high double, low double, close double"
SPELT = "symbol string, ts timestamp, high double, low double, close double"


def some_bars():
    r = random.Random(7)
    out = []
    for symbol, hours in (("A", [*range(0, 40), *range(100, 130)]), ("B", range(3, 60, 2)), ("C", [5])):
        close = 100.0
        for h in hours:
            close += r.uniform(-2, 2)
            out.append((symbol, h, close + r.random(), close - r.random(), close))
    return out


def streamed(spark, tmp_path, batches, lateness="6 hours", idle=dt.timedelta(hours=24)):
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("hour") * 3600).alias("ts")
    for batch in batches:
        spark.createDataFrame(batch, BARS).select("symbol", at, "high", "low", "close").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SPELT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with online.state_store(spark):
        made = jobs.run_to_table(online.online_indicators(stream, lateness, idle), "online")
    return {(r.symbol, int(r.ts.timestamp() - 1_704_067_200) // 3600): tuple(r)[2:] for r in made.collect()}


def stepped(bars, until, idle=24):
    """The batch result: all bars up to `until` in time order, a series anew after more than `idle` hours."""
    out, state = {}, {}
    for symbol, h, high, low, close in sorted(bars, key=lambda b: b[1]):
        if h <= until:
            s = state.get(symbol, online.Levels())
            s = online.Levels() if s.bars and h - s.at // 3_600_000_000 > idle else s
            state[symbol], out[symbol, h] = online.advance(s, h * 3_600_000_000, high, low, close, online.Windows())
    return out


def test_order_and_batches_do_not_matter(spark, tmp_path):
    bars = some_bars()
    want = stepped(bars, 129 - 6)
    assert streamed(spark, tmp_path / "one", [bars]) == want
    r = random.Random(1)
    arrived = sorted(bars, key=lambda b: b[1] + r.uniform(0, 5))  # up to five hours late
    cuts = [0, 11, 40, 70, len(bars)]
    got = streamed(spark, tmp_path / "many", [arrived[a:b] for a, b in zip(cuts, cuts[1:])])
    assert got == want and got["A", 100][0] == 1  # the silence of A ended its series


def test_bars_later_than_allowed_are_dropped(spark, tmp_path):
    bars = [("A", h, 2.0 + h, 1.0, 1.5 + h % 3) for h in range(40)]
    late = [("A", 3, 99.0, 0.0, 50.0)]
    rest = [b for b in bars if b[1] != 3]
    assert streamed(spark, tmp_path, [rest[:30], late + rest[30:]]) == stepped(rest, 39 - 6)


def test_steps_equal_the_batch_indicators(spark):
    bars = [b for b in some_bars() if b[0] == "A" and b[1] < 40]
    table = spark.createDataFrame(bars, BARS).select("symbol", F.date_add(F.lit(d("2024-01-01")), F.col("hour")).alias("date"), F.col("close").alias("open"), "high", "low", "close", F.lit(10).cast("long").alias("volume"))
    batch = {r.date: r for r in ind.indicators(table).join(ind.supertrend(table), ["symbol", "date"]).collect()}
    for (_, h), (_, _, rsi, atr, band, direction) in stepped(bars, 100).items():
        want = batch[d("2024-01-01") + dt.timedelta(days=h)]
        for got, other in ((rsi, want.rsi), (atr, want.atr), (band, want.supertrend)):
            assert got is None and other is None or math.isclose(got, other, rel_tol=1e-9)
        assert direction == want.direction


def test_facts_may_come_after_the_events(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    events = [(i, "A" if i % 3 else "B", day(i / 4)) for i in range(80)]
    facts = [("A", day(2), day(5), 1.0), ("A", day(5), day(9), 2.0), ("A", day(9), None, 3.0), ("B", day(4), day(11), 4.0)]
    spark.createDataFrame(events, "i int, symbol string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "events"))
    for fact in [*sorted(facts, key=lambda f: f[1]), ("C", day(40), None, 9.0)]:
        spark.createDataFrame([fact], "symbol string, since timestamp, until timestamp, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "facts"))
    e = spark.readStream.schema("i int, symbol string, ts timestamp").parquet(str(tmp_path / "events"))
    f = spark.readStream.schema("symbol string, since timestamp, until timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "facts"))
    joined = jobs.enrich_streams(e, f, "symbol", "ts", "since", "until", lateness="1 hour", facts_lateness="1 hour", longest="8 days", buckets=intervals.Buckets(2, 19_700, 100))
    got = {r.i: r.v for r in jobs.run_to_table(joined.select("i", "v"), "moving").collect()}
    for i, symbol, ts in events:
        hits = [v for s, a, b, v in facts if s == symbol and a < ts <= (b or day(99)) and ts <= a + dt.timedelta(days=8)]
        if hits or ts < day(19):  # what met nothing is told once the watermark has passed it
            assert got[i] == (hits[0] if hits else None)


@pytest.mark.parametrize("buckets", [intervals.YEARS, intervals.Buckets(1, 0, 3), intervals.Buckets(100, 20_000, 1)])
def test_cut_intervals_lose_no_match(spark, buckets):
    r = random.Random(3)
    some = [(r.choice("AB"), d("2020-01-01") + dt.timedelta(days=r.randrange(-20_000, 2000)), r.choice([None, 10, 400, 0, -5])) for _ in range(60)]
    some = [(s, a, None if n is None else a + dt.timedelta(days=n)) for s, a, n in some] + [("A", None, None), ("B", None, d("2021-01-01"))]
    probes = [(i, r.choice("ABC"), d("2020-01-01") + dt.timedelta(days=r.randrange(-25_000, 9000))) for i in range(200)] + [(999, "A", None)]
    cut = intervals.cut(spark.createDataFrame(some, "k string, a date, b date"), "a", "b", buckets)
    at = spark.createDataFrame(probes, "i int, symbol string, t date")
    hit = at.join(cut, (at.symbol == cut.k) & (buckets.of(at.t) == F.col(intervals.BUCKET)) & (F.col("a") <= at.t) & (F.col("b").isNull() | (at.t < F.col("b"))))
    want = sorted((i, a, b or d("2999-01-01")) for i, s, t in probes for k, a, b in some if t and a and k == s and a <= t and (b is None or t < b))
    assert sorted((x.i, x.a, x.b or d("2999-01-01")) for x in hit.collect()) == want


def test_membership_joins_on_symbol_and_bucket(spark):
    table = spark.createDataFrame([("A", d("2001-05-01")), ("A", d("2300-01-01")), ("A", d("1950-01-01")), ("B", d("2001-05-01")), ("A", None)], "symbol string, as_of date")
    s = spark.createDataFrame([("A", d("2000-01-01"), None), ("A", d("2001-01-01"), d("2002-01-01")), ("B", d("2001-05-01"), d("2001-05-01"))], "symbol string, start date, end date")
    kept = spells.members_only(table, s)
    assert rows(kept) == [("A", d("2001-05-01")), ("A", d("2300-01-01"))]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line)
    assert "_bucket" in join and "symbol" in join and "Cartesian" not in plan and "NestedLoop" not in plan
