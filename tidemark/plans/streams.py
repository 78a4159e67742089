"""Streams over the given tables, drained once and checked against their batch definition."""
from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators import indicators as ind, text as tx
from tidemark.plans.cte import define
from tidemark.plans.registry import query, rounded
from tidemark.plans.signals import bucket, recursion
from tidemark.plans.standins import Lake
from tidemark.sources import text_files as tf
from tidemark.staging import staged
from tidemark.streaming import jobs, online


def tick_stream(lake: Lake) -> DataFrame:
    s = jobs.read_stream(lake.spark, lake.folder, "events.parquet", lake.table("events").schema)
    return s.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1).cast("long").alias("volume"))


_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 30 MINUTE"


def _plain(bars: DataFrame) -> DataFrame:
    return rounded(bars.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume"))


@query("T1", f"SELECT symbol, {bucket(120)} AS ts, round(arg_min(price, ticks.ts), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, ticks.ts), 6) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM ticks GROUP BY 1, 2 HAVING {bucket(120)} + INTERVAL 120 MINUTE <= {_CLOSED}")
def stream_bars(lake: Lake) -> DataFrame:
    return _plain(jobs.run_to_table(jobs.tick_bars(tick_stream(lake), 120), "bars"))


@query("T2", f"SELECT symbol, b AS ts, round(arg_min(open, ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, ts), 6) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM (SELECT *, {bucket(240)} AS b FROM hour_bars WHERE ts + INTERVAL 60 MINUTE <= {_CLOSED}) GROUP BY 1, 2 HAVING b + INTERVAL 240 MINUTE <= {_CLOSED}")
def stream_coarser_bars(lake: Lake) -> DataFrame:
    """Hour bars and four-hour bars in one query."""
    return _plain(jobs.run_to_table(jobs.coarser_bars(jobs.tick_bars(tick_stream(lake), 60), 240), "coarse"))


@query("T3", f"""
WITH RECURSIVE closed AS MATERIALIZED (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM hour_bars WHERE ts + INTERVAL 60 MINUTE <= {_CLOSED}),
walk AS (SELECT symbol, ts, rn, close AS s FROM closed WHERE rn = 1 UNION ALL SELECT c.symbol, c.ts, c.rn, w.s * (1 - 1.0::DOUBLE / 14) + c.close / 14 FROM walk w JOIN closed c ON c.symbol = w.symbol AND c.rn = w.rn + 1)
SELECT symbol, ts, CASE WHEN rn >= 14 THEN round(s, 6) END AS smoothed FROM walk
""")
def stream_smoothing(lake: Lake) -> DataFrame:
    """Smoothing over closed hour bars: bars are a stream-written table, read again as a stream."""
    closed = jobs.run_to_table(jobs.tick_bars(tick_stream(lake), 60), "hours").select("symbol", F.col("w.start").alias("ts"), "close")
    table = staged(closed, "closed")
    again = lake.spark.readStream.schema(table.schema).parquet(table.staged_path)
    out = jobs.run_to_table(jobs.smoothing(again, 14), "smooth")
    return rounded(out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "smoothed"))


LATE, IDLE = 12, 3  # hours: how late a bar may come, and a silence that ends a series

define("online_tf", f"""SELECT symbol, CAST(sum(fresh) OVER (PARTITION BY symbol ORDER BY ts) AS VARCHAR) AS tf, ts, open, high, low, close, volume
 FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) > INTERVAL {IDLE} HOUR THEN 1 ELSE 0 END AS fresh FROM hour_bars WHERE ts <= (SELECT max(ts) FROM hour_bars) - INTERVAL {LATE} HOUR)""")


def _online(lake: Lake) -> DataFrame:
    """Hour bars that arrive out of order, up to eight hours late, in three batches, through the online indicators."""
    bars = ind.bars_from_ticks(lake.ticks, 60).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "high", "low", "close")
    bars = staged(bars, "hours")
    arrival = F.unix_seconds("ts") + F.pmod(F.xxhash64("symbol", "ts"), F.lit(8)) * 3600
    ends = bars.agg(F.min(arrival).alias("low"), F.max(arrival).alias("high")).first()
    span = max(1, ends["high"] - ends["low"] + 1) if ends["low"] is not None else 1
    slices = bars.withColumn("slice", F.floor((arrival - F.lit(ends["low"] or 0)) * 3 / F.lit(span)).cast("int"))
    path = jobs.written_in_order(slices, "hours", "slice", 3)
    stream = lake.spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(path)
    with online.state_store(lake.spark):
        out = jobs.run_to_table(online.online_indicators(stream, f"{LATE} hours", timedelta(hours=IDLE)), "online")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("T3 late", """
WITH RECURSIVE n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY ts) AS rn FROM online_tf),
walk AS (SELECT symbol, tf, ts, rn, close AS s FROM n WHERE rn = 1 UNION ALL SELECT c.symbol, c.tf, c.ts, c.rn, w.s * (1 - 1.0::DOUBLE / 14) + c.close / 14 FROM walk w JOIN n c ON c.symbol = w.symbol AND c.tf = w.tf AND c.rn = w.rn + 1)
SELECT symbol, ts, CASE WHEN rn >= 14 THEN round(s, 6) END AS smoothed FROM walk
""")
def stream_late_smoothing(lake: Lake) -> DataFrame:
    return rounded(_online(lake).select("symbol", "ts", "smoothed"))


@query("T3 RSI", f"WITH RECURSIVE {recursion('online_tf')} SELECT symbol, ts, round(rsi, 6) AS rsi, round(atr, 6) AS atr FROM ind")
def stream_rsi(lake: Lake) -> DataFrame:
    return rounded(_online(lake).select("symbol", "ts", "rsi", "atr"))


@query("T3 trend band", f"WITH RECURSIVE {recursion('online_tf')} SELECT symbol, ts, round(supertrend, 6) AS supertrend, CAST(direction AS BIGINT) AS direction FROM ind")
def stream_trend_band(lake: Lake) -> DataFrame:
    return rounded(_online(lake).select("symbol", "ts", "supertrend", F.col("direction").cast("long").alias("direction")))


@query("T4", "SELECT user_id, event_type, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def stream_upsert(lake: Lake) -> DataFrame:
    """The last event per user and type, kept by upserts batch by batch."""
    s = jobs.read_stream(lake.spark, lake.folder, "events.parquet", lake.table("events").schema)
    rows = s.select("user_id", "event_type", "ts", "value", F.struct("ts", "event_id").alias("seq"))
    return jobs.run_upserts(rows, "upsert", ["user_id", "event_type"], "seq").drop("seq")


define("price_steps", "SELECT event_type AS symbol, CAST(ts AS DATE) AS d, max(value) AS peak FROM events GROUP BY 1, 2")


def _peaks(lake: Lake) -> DataFrame:
    """Per symbol and finished day the day's highest value, valid from the next midnight to the next such row."""
    daily = lake.table("events").groupBy(F.col("event_type").alias("symbol"), F.date_add(F.to_date("ts"), 1).cast("timestamp_ntz").alias("since")).agg(F.max("value").alias("peak"))
    return daily.withColumn("until", F.lead("since").over(Window.partitionBy("symbol").orderBy("since")))  # one row per symbol and day


@query("T5 stream-stream", """
SELECT e.event_id, CASE WHEN e.ts <= p.since + INTERVAL 10 DAY THEN p.peak END AS peak FROM events e ASOF LEFT JOIN (SELECT symbol, CAST(d + 1 AS TIMESTAMP) AS since, peak FROM price_steps) p ON p.symbol = e.event_type AND p.since < e.ts
""")
def stream_moving_enrichment(lake: Lake) -> DataFrame:
    """The same with the facts as a stream of their own, most of them arriving after all events."""
    s = jobs.read_stream(lake.spark, lake.folder, "events.parquet", lake.table("events").schema).select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"))
    facts = _peaks(lake).select("symbol", F.col("since").cast("timestamp").alias("since"), F.col("until").cast("timestamp").alias("until"), "peak")
    tenth = F.floor(F.dayofmonth("since") / 11).cast("int")
    month = F.month("since") - 1
    late = facts.withColumn("slice", F.least(F.lit(3), tenth + 3 * month))
    path = jobs.written_in_order(late, "facts", "slice", 4)
    moving = lake.spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 1).parquet(path)
    joined = jobs.enrich_streams(s, moving, "symbol", "ts", "since", "until", lateness="1 hour", facts_lateness="1 hour", longest="10 days")
    return jobs.run_to_table(joined.select("event_id", "peak"), "moving")


@query("T5", """
SELECT e.event_id, p.peak FROM events e ASOF LEFT JOIN (SELECT symbol, CAST(d + 1 AS TIMESTAMP) AS since, peak FROM price_steps) p ON p.symbol = e.event_type AND p.since < e.ts
""")
def stream_enrichment(lake: Lake) -> DataFrame:
    """Each event with the highest value of the last finished day, a slowly changing fact."""
    s = jobs.read_stream(lake.spark, lake.folder, "events.parquet", lake.table("events").schema).select("event_id", F.col("event_type").alias("symbol"), "ts")
    return jobs.run_to_table(jobs.enrich(s, staged(_peaks(lake), "peaks"), "symbol", "ts", "since", "until"), "enriched").select("event_id", "peak")


@query("T6", """
WITH daily AS (SELECT symbol, date AS day, count(*) FILTER (contains(lower(headline), 'upgraded')) AS upgrades, count(*) FILTER (contains(lower(headline), 'downgraded')) AS downgrades FROM news GROUP BY 1, 2
 HAVING date + 1 <= (SELECT max(date) FROM news) + INTERVAL 12 HOUR - INTERVAL 2 DAY)
SELECT symbol, day, CAST(sum(upgrades) OVER w AS BIGINT) AS upgrades, CAST(sum(downgrades) OVER w AS BIGINT) AS downgrades FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY day RANGE BETWEEN INTERVAL 179 DAY PRECEDING AND CURRENT ROW)
""")
def stream_action_counts(lake: Lake) -> DataFrame:
    """Daily counts from a headline stream, then trailing 180-day sums over the daily table."""
    table = staged(lake.raw_news, "news")
    s = lake.spark.readStream.schema(table.schema).parquet(table.inputFiles()[0].rsplit("/", 1)[0])
    news = tf.clean_news(s).withColumn("at", F.to_timestamp("published_at"))
    words = {w: n for w, n in tx.ACTIONS.items() if n != "initiations"}
    daily = jobs.run_to_table(jobs.daily_counts(news, words), "actions")
    return jobs.trailing_counts(daily, list(words.values()))

