"""Resampled bars, indicators, snapshots and votes."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import indicators as ind, prices as px
from tidemark.plans.cte import define
from tidemark.plans.registry import query, r, rounded
from tidemark.plans.standins import Lake
from tidemark.staging import staged


def bucket(minutes: int, ts: str = "ts") -> str:
    return f"time_bucket(INTERVAL '{minutes} minutes', {ts}, TIMESTAMP '1970-01-01 00:00:00' + INTERVAL '{570 % minutes} minutes')"


def _ticks_sql(minutes: int) -> str:
    return f"SELECT symbol, {bucket(minutes)} AS ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM ticks GROUP BY 1, 2"


@query("A8 ticks", f"SELECT symbol, ts, {r('open high low close')}, volume FROM ({_ticks_sql(60)})")
def hourly_bars(lake: Lake) -> DataFrame:
    return rounded(ind.bars_from_ticks(lake.ticks, 60))


define("hour_bars", _ticks_sql(60))
define("bars_240", f"SELECT symbol, {bucket(240)} AS b, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM hour_bars GROUP BY 1, 2")


@query("A8 intraday", f"SELECT symbol, b AS ts, {r('open high low close')}, volume FROM bars_240")
def four_hour_bars(lake: Lake) -> DataFrame:
    return rounded(ind.resample_intraday(ind.bars_from_ticks(lake.ticks, 60), 240))


@query("A8 weekly", "SELECT symbol, CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE) AS date, round(arg_min(open, date), 8) AS open, round(max(high), 8) AS high, round(min(low), 8) AS low, round(arg_max(close, date), 8) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY 1, 2")
def weekly_bars(lake: Lake) -> DataFrame:
    return rounded(ind.resample_weekly(lake.bars), 8)


@query("S14", "SELECT symbol, timezone('America/New_York', timezone('UTC', ts)) AS ts, round(price, 6) AS close, volume FROM ticks")
def exchange_time(lake: Lake) -> DataFrame:
    t = lake.ticks
    raw = t.select("symbol", "ts", F.col("price").alias("open"), F.col("price").alias("high"), F.col("price").alias("low"), F.col("price").alias("close"), "volume")
    return rounded(px.normalise_intraday(raw).select("symbol", "ts", "close", "volume"))


# one recursion carries every smoothed value and the trend state, row by row
define("daily_tf", "SELECT symbol, 'daily' AS tf, CAST(date AS TIMESTAMP) AS ts, open, high, low, close, volume FROM bars")


def _stored(label: str) -> str:
    return f"SELECT symbol, '{label}' AS tf, {', '.join(['ts', 'open', 'high', 'low', 'close', 'volume'])} FROM ({_ticks_sql(int(label[:-1]))})"


def _coarse(minutes: int) -> str:
    return f"SELECT symbol, '{minutes}m' AS tf, {bucket(minutes)} AS b, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM hour_bars GROUP BY 1, 2, 3"


define("tick_days", "SELECT symbol, CAST(ts AS DATE) AS date, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM ticks GROUP BY 1, 2")
_STORED = ["5m", "15m", "30m", "60m"]
define("frames_tf", "\nUNION ALL ".join(
    [_stored(x) for x in _STORED] + [_coarse(m) for m in (120, 240, 480)]
    + ["SELECT symbol, 'daily', CAST(date AS TIMESTAMP), open, high, low, close, volume FROM tick_days",
       "SELECT symbol, 'weekly', CAST(date_trunc('week', date) + INTERVAL 6 DAY AS TIMESTAMP) AS w, arg_min(open, date), max(high), min(low), arg_max(close, date), CAST(sum(volume) AS BIGINT) FROM tick_days GROUP BY 1, 2, 3"]))


def recursion(source: str) -> str:
    """CTE list that ends in `ind`: every indicator of `source`, computed row by row."""
    def ema(c: str, x: str, n: int) -> str:
        return f"CASE WHEN p.{c} IS NULL THEN b.{x} ELSE p.{c} * (1 - 1.0::DOUBLE / {n}) + b.{x} / {n} END"

    band_up, band_low = "b.mid + 3 * a", "b.mid - 3 * a"
    return f"""
base AS MATERIALIZED (SELECT *, row_number() OVER w AS rn, (high + low) / 2 AS mid, close - lag(close) OVER w AS delta, lag(close) OVER w AS pc,
  greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr0, CASE WHEN high = low THEN 0 ELSE (2 * close - high - low) / (high - low) * volume END AS raw
  FROM {source} WINDOW w AS (PARTITION BY symbol, tf ORDER BY ts)),
b0 AS MATERIALIZED (SELECT *, CASE WHEN pc IS NOT NULL THEN tr0 END AS tr, greatest(delta, 0) AS gain, greatest(-delta, 0) AS loss FROM base),
walk AS (
 SELECT symbol, tf, rn, NULL::DOUBLE AS g, NULL::DOUBLE AS l, NULL::DOUBLE AS a14, NULL::DOUBLE AS a10, mid AS j, mid AS t, mid AS li, NULL::DOUBLE AS up, NULL::DOUBLE AS low_b, 0 AS dir, close AS c FROM b0 WHERE rn = 1
 UNION ALL
 SELECT symbol, tf, rn, g, l, a14, a10, j, t, li, nu AS up, nl AS low_b, CASE WHEN nu IS NULL THEN 0 WHEN pup IS NULL THEN CASE WHEN c >= mid THEN 1 ELSE -1 END WHEN pdir = 1 THEN CASE WHEN c < nl THEN -1 ELSE 1 END ELSE CASE WHEN c > nu THEN 1 ELSE -1 END END AS dir, c FROM (
  SELECT *, CASE WHEN rn < 11 THEN NULL WHEN pup IS NOT NULL AND mid + 3 * a10 >= pup AND pc <= pup THEN pup ELSE mid + 3 * a10 END AS nu, CASE WHEN rn < 11 THEN NULL WHEN plow IS NOT NULL AND mid - 3 * a10 <= plow AND pc >= plow THEN plow ELSE mid - 3 * a10 END AS nl FROM (
   SELECT b.symbol, b.tf, b.rn, b.mid, b.close AS c, p.c AS pc, p.up AS pup, p.low_b AS plow, p.dir AS pdir, {ema('g', 'gain', 14)} AS g, {ema('l', 'loss', 14)} AS l, {ema('a14', 'tr', 14)} AS a14, {ema('a10', 'tr', 10)} AS a10,
     {ema('j', 'mid', 13)} AS j, {ema('t', 'mid', 8)} AS t, {ema('li', 'mid', 5)} AS li FROM walk p JOIN b0 b ON b.symbol = p.symbol AND b.tf = p.tf AND b.rn = p.rn + 1))),
ind AS (SELECT b.symbol, b.tf, b.ts, b.rn, b.close, (b.close / b.pc - 1) * 100 AS change_pct, CASE WHEN b.rn >= 15 THEN CASE WHEN w.l = 0 THEN 100 ELSE 100 - 100 / (1 + w.g / w.l) END END AS rsi, b.tr AS true_range,
  CASE WHEN b.rn >= 15 THEN w.a14 END AS atr, CASE WHEN b.rn - 8 >= 13 THEN lag(w.j, 8) OVER o END AS jaw, CASE WHEN b.rn - 5 >= 8 THEN lag(w.t, 5) OVER o END AS teeth, CASE WHEN b.rn - 3 >= 5 THEN lag(w.li, 3) OVER o END AS lips, b.raw AS iix_raw,
  CASE WHEN b.rn >= 21 THEN 100 * sum(b.raw) OVER (o ROWS 20 PRECEDING) / nullif(sum(b.volume) OVER (o ROWS 20 PRECEDING), 0) END AS iix, CASE w.dir WHEN 1 THEN w.low_b WHEN -1 THEN w.up END AS supertrend, w.dir AS direction
  FROM b0 b JOIN walk w USING (symbol, tf, rn) WINDOW o AS (PARTITION BY b.symbol, b.tf ORDER BY b.ts))"""


_IND = ["change_pct", "rsi", "true_range", "atr", "jaw", "teeth", "lips", "iix_raw", "iix"]


@query("W15-W18 W20 W21", f"WITH RECURSIVE {recursion('daily_tf')} SELECT symbol, CAST(ts AS DATE) AS date, {r([c for c in _IND if c != 'true_range'])}, round(true_range, 8) AS true_range FROM ind")
def daily_indicators(lake: Lake) -> DataFrame:
    out = ind.indicators(lake.bars).select("symbol", "date", *_IND)
    return rounded(out.withColumn("true_range", F.round("true_range", 8)), keep=("true_range",))


@query("W19", f"WITH RECURSIVE {recursion('daily_tf')} SELECT symbol, CAST(ts AS DATE) AS date, round(supertrend, 6) AS supertrend, CAST(direction AS BIGINT) AS direction FROM ind")
def supertrend(lake: Lake) -> DataFrame:
    out = ind.supertrend(lake.bars)
    return rounded(out.withColumn("direction", F.col("direction").cast("long")))


def frames(lake: Lake) -> DataFrame:
    """Every timeframe of the tick stream."""
    t = lake.ticks
    stored = None
    for label in _STORED:
        part = ind.bars_from_ticks(t, int(label[:-1])).withColumn("interval", F.lit(label))
        stored = part if stored is None else stored.unionByName(part)
    daily = t.groupBy("symbol", F.to_date("ts").alias("date")).agg(*ind._ohlcv(has_bars=False))
    return ind.all_timeframes(staged(stored, "intraday"), staged(daily, "daily"))


_SNAP = ["close", "change_pct", "rsi", "atr", "supertrend", "iix"]
_SNAP_SQL = f"""WITH RECURSIVE {recursion('frames_tf')}, snap AS (SELECT *, CASE WHEN lips > teeth AND teeth > jaw THEN 'up' WHEN lips < teeth AND teeth < jaw THEN 'down' ELSE 'sleeping' END AS alligator
 FROM ind QUALIFY row_number() OVER (PARTITION BY symbol, tf ORDER BY ts DESC) = 1)"""


def snapshots(lake: Lake) -> DataFrame:
    return ind.snapshots(staged(frames(lake), "frames"))


@query("X8", _SNAP_SQL + f" SELECT symbol, tf, rn AS bars, {r(_SNAP)}, CAST(direction AS BIGINT) AS direction, alligator FROM snap WHERE rn >= 30")
def indicator_snapshots(lake: Lake) -> DataFrame:
    out = snapshots(lake)
    return rounded(out.withColumn("direction", F.col("direction").cast("long")))


@query("X9", _SNAP_SQL + """, v AS (SELECT symbol, tf, ((CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END) + direction + (CASE alligator WHEN 'up' THEN 1 WHEN 'down' THEN -1 ELSE 0 END) + (CASE WHEN iix > 10 THEN 1 WHEN iix < -10 THEN -1 ELSE 0 END)) / 4 AS vote FROM snap WHERE rn >= 30)
 SELECT symbol, tf, round(vote, 6) AS vote, CASE WHEN vote > 0.5 THEN 'Strong buy' WHEN vote > 0.1 THEN 'Buy' WHEN vote < -0.5 THEN 'Strong sell' WHEN vote < -0.1 THEN 'Sell' ELSE 'Neutral' END AS label FROM v""")
def technical_votes(lake: Lake) -> DataFrame:
    return rounded(ind.technical_votes(snapshots(lake)).select("symbol", "tf", "vote", "label"))
