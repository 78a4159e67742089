"""Daily-bar operators. Bars are unique per (symbol, date), so a per-symbol window is bounded by the
calendar (about 260 rows a year) however many trades were collapsed into them before the shuffle."""
from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.scalar import change
from tidemark.operators.asof import asof_join

TRADING_DAYS = 252
PRICE_FACTORS = ["ret_1m", "ret_3m", "ret_6m", "ret_12m_ex_1m", "sma200_gap", "vol_60d", "drawdown_252d"]
EVENT_FEATURES = ["ret_1m", "ret_3m", "ret_6m", "ret_12m_ex_1m", "ret_36m", "sma200_gap", "vol_60d", "drawdown_252d", "from_52w_low", "rel_ret_3m", "rel_ret_12m_ex_1m"]
MAX_GAP_DAYS = 5


def normalise_daily(raw: DataFrame) -> DataFrame:
    """Provider rows -> bars: any missing price drops the row, timestamps become dates, volume is never NULL."""
    return raw.dropna(subset=["open", "high", "low", "close", "adj_close"]).select(
        "symbol", F.to_date("date").alias("date"), "open", "high", "low", "close", "adj_close",
        F.coalesce(F.col("volume").cast("long"), F.lit(0).cast("long")).alias("volume"),
    )


def normalise_intraday(raw: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """UTC instants -> naive exchange-local time; only a missing close drops the row."""
    return raw.where(F.col("close").isNotNull() & ~F.isnan("close")).select(
        "symbol", F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone).cast("timestamp_ntz").alias("ts"),
        "open", "high", "low", "close", F.coalesce(F.col("volume").cast("long"), F.lit(0).cast("long")).alias("volume"),
    )


def _by_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("date")


def rolling(df: DataFrame, w: Window, specs: Mapping[str, tuple[str, str, int]]) -> DataFrame:
    """Adds fixed-length row frames: name -> (column, "sum" | "max" | "min", rows), NULL during warm-up.

    A frame of n rows is put together from frames of 1, 2, 4, ... rows, each built from two of half its
    length by a lag. Every row costs about log2(n) steps where a sliding frame would redo n, and unlike
    differences of running sums nothing cancels. All steps share one partitioning and sort order.
    """
    merge = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least}
    pairs = sorted({(c, k) for c, k, _ in specs.values()})
    top = max(n for _, _, n in specs.values()).bit_length() - 1
    level = lambda c, k, i: f"_{c}_{k}_{i}"
    out = df.select("*", F.row_number().over(w).alias("_rows"), *[F.col(c).alias(level(c, k, 0)) for c, k in pairs])
    for i in range(top):
        steps = [merge[k](F.col(level(c, k, i)), F.lag(level(c, k, i), 2**i).over(w)).alias(level(c, k, i + 1)) for c, k in pairs]
        out = out.select("*", *steps)
    columns = []
    for name, (c, k, n) in specs.items():
        size, value, offset = n.bit_length() - 1, None, 0
        if k == "sum":  # disjoint pieces
            for i in reversed(range(n.bit_length())):
                if n >> i & 1:
                    piece = F.lag(level(c, k, i), offset).over(w) if offset else F.col(level(c, k, i))
                    value, offset = piece if value is None else value + piece, offset + 2**i
        else:  # two overlapping pieces
            value, rest = F.col(level(c, k, size)), n - 2**size
            value = merge[k](value, F.lag(level(c, k, size), rest).over(w)) if rest else value
        columns.append(F.when(F.col("_rows") >= n, value).alias(name))
    return out.select(*df.columns, "_rows", *columns)


def price_factors(bars: DataFrame) -> DataFrame:
    """Per bar: close and the seven price factors. Lags count rows, not calendar days."""
    w = _by_symbol()
    adj, daily = F.col("adj_close"), F.col("_daily")
    f60 = w.rowsBetween(-59, 0)
    base = bars.select("symbol", "date", "close", "adj_close", change(adj, F.lag(adj).over(w)).alias("_daily"))
    base = rolling(base, w, {"_sum200": ("adj_close", "sum", 200), "_max252": ("adj_close", "max", TRADING_DAYS)})
    return base.select(
        "symbol", "date", "close",
        change(adj, F.lag(adj, 21).over(w)).alias("ret_1m"),
        change(adj, F.lag(adj, 63).over(w)).alias("ret_3m"),
        change(adj, F.lag(adj, 126).over(w)).alias("ret_6m"),
        change(F.lag(adj, 21).over(w), F.lag(adj, TRADING_DAYS).over(w)).alias("ret_12m_ex_1m"),
        (adj / (F.col("_sum200") / 200) - 1).alias("sma200_gap"),
        F.when(F.count(daily).over(f60) == 60, F.stddev_samp(daily).over(f60) * math.sqrt(TRADING_DAYS)).alias("vol_60d"),
        (adj / F.col("_max252") - 1).alias("drawdown_252d"),
    )


def month_ends(df: DataFrame, as_of: str = "bar") -> DataFrame:
    """The last available row of each month per symbol, with `as_of` = its date (`bar`) or the calendar
    month end (`calendar`, for panels whose symbols do not share trading days)."""
    following = F.lead("date").over(_by_symbol())
    last = df.withColumn("_next", following).where(F.col("_next").isNull() | (F.trunc("_next", "MM") != F.trunc("date", "MM")))
    stamp = F.col("date") if as_of == "bar" else F.last_day("date")
    rest = [c for c in df.columns if c not in ("symbol", "date")]
    return last.select("symbol", stamp.alias("as_of"), "date", *rest)


def bar_features(bars: DataFrame) -> DataFrame:
    """Event-study features on every bar that has at least 252 earlier bars (population volatility here)."""
    w = _by_symbol()
    adj, daily = F.col("adj_close"), F.col("_daily")
    base = bars.select("symbol", "date", "adj_close", change(adj, F.lag(adj).over(w)).alias("_daily"))
    base = rolling(base, w, {"_sum200": ("adj_close", "sum", 200), "_max252": ("adj_close", "max", TRADING_DAYS), "_min252": ("adj_close", "min", TRADING_DAYS)})
    return base.select(
        "symbol", "date", F.col("_rows").alias("_row"),
        change(adj, F.lag(adj, 21).over(w)).alias("ret_1m"),
        change(adj, F.lag(adj, 63).over(w)).alias("ret_3m"),
        change(adj, F.lag(adj, 126).over(w)).alias("ret_6m"),
        change(F.lag(adj, 21).over(w), F.lag(adj, TRADING_DAYS).over(w)).alias("ret_12m_ex_1m"),
        change(adj, F.lag(adj, 756).over(w)).alias("ret_36m"),
        (adj / (F.col("_sum200") / 200) - 1).alias("sma200_gap"),
        (F.stddev_pop(daily).over(w.rowsBetween(-59, 0)) * math.sqrt(TRADING_DAYS)).alias("vol_60d"),
        (adj / F.col("_max252") - 1).alias("drawdown_252d"),
        (adj / F.col("_min252") - 1).alias("from_52w_low"),
    )


def event_features(events: DataFrame, bars: DataFrame, index_bars: DataFrame, *, symbol: str = "symbol", date: str = "rec_date") -> DataFrame:
    """`events` plus the price features known on `date`: from the last bar at or before it, at most five
    days old and with 252 bars of history. The index is read at its own last bar, without an age limit."""
    own = [c for c in EVENT_FEATURES if not c.startswith("rel_")]
    features = bar_features(bars).withColumnRenamed("symbol", symbol)
    found = asof_join(events, features, [symbol], date, "date", ["_row", *own], tolerance_days=MAX_GAP_DAYS)
    index = bar_features(index_bars).select(F.lit(1).alias("_one"), "date", F.col("ret_3m").alias("_idx_3m"), F.col("ret_12m_ex_1m").alias("_idx_12m"))
    # one row per event date: the index leg is computed on dates, then joined as a small dimension
    dates = events.select(F.col(date).alias("_d"), F.lit(1).alias("_one")).distinct()
    index_at = asof_join(dates, index, ["_one"], "_d", "date", ["_idx_3m", "_idx_12m"], unique_left=True).drop("_one")
    enough = F.col("_row") > TRADING_DAYS
    out = found.join(index_at, F.col(date) == F.col("_d"), "left")
    return out.select(
        *events.columns,
        *[F.when(enough, F.col(c)).alias(c) for c in own],
        F.when(enough, F.col("ret_3m") - F.col("_idx_3m")).alias("rel_ret_3m"),
        F.when(enough, F.col("ret_12m_ex_1m") - F.col("_idx_12m")).alias("rel_ret_12m_ex_1m"),
    )


def later_split_factors(splits: DataFrame) -> DataFrame:
    """Split table -> step function: from each split date on, the product of the ratios *after* it, plus
    one opening row per symbol. Duplicated (symbol, date) rows count once."""
    once = splits.groupBy("symbol", "date").agg(F.max("ratio").alias("ratio"))
    w = Window.partitionBy("symbol").orderBy("date")
    steps = once.select(
        "symbol", "date",
        F.coalesce(F.product("ratio").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(1.0)).alias("factor"),
    )
    opening = once.groupBy("symbol").agg(F.product("ratio").alias("factor")).select("symbol", F.to_date(F.lit("0001-01-01")).alias("date"), "factor")
    return steps.unionByName(opening)


def with_raw_close(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Bars plus `raw_close`: the price as it was quoted on the day, before later splits."""
    out = asof_join(bars, later_split_factors(splits), ["symbol"], "date", "date", ["factor"], unique_left=True)
    return out.withColumn("raw_close", F.col("close") * F.coalesce("factor", F.lit(1.0))).drop("factor")


def raw_close_at(probes: DataFrame, bars: DataFrame, splits: DataFrame, *, date: str = "as_of", unique: bool = False) -> DataFrame:
    """`probes` plus the raw close of the last bar at or before `date`, at most five days old."""
    quoted = with_raw_close(bars, splits).select("symbol", "date", "raw_close")
    return asof_join(probes, quoted, ["symbol"], date, "date", ["raw_close"], tolerance_days=MAX_GAP_DAYS, unique_left=unique)


def back_adjust(raw: DataFrame) -> DataFrame:
    """Unadjusted close with per-bar split factors -> close adjusted for every later split."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    after = F.coalesce(F.product("split_factor").over(w), F.lit(1.0))
    return raw.withColumn("close_adjusted", F.col("close") / after)


def splits_of(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("split_factor") != 1).select("symbol", "date", F.col("split_factor").alias("ratio"))


def alternate_tickers(recs: DataFrame, priced: DataFrame) -> DataFrame:
    """For symbols without prices: the tickers to try, in order of first appearance, own symbol first."""
    gaps = recs.join(priced.select(F.col("symbol").alias("yf_symbol")).distinct(), "yf_symbol", "left_anti")
    first = gaps.select("yf_symbol", F.translate("ticker_at_rec", ".", "-").alias("alt"), "rec_date").groupBy("yf_symbol", "alt").agg(F.min("rec_date").alias("seen"))
    listed = first.where("alt <> yf_symbol").groupBy("yf_symbol").agg(F.array_sort(F.collect_list(F.struct("seen", "alt"))).alias("l"))
    own = gaps.select("yf_symbol").distinct()
    return own.join(listed, "yf_symbol", "left").select(
        "yf_symbol", F.concat(F.array("yf_symbol"), F.coalesce(F.transform("l", lambda x: x["alt"]), F.array().cast("array<string>"))).alias("candidates")
    )
