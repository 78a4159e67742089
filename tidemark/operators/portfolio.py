"""Forward returns on a date grid, top-N rebalancing with costs, and performance figures."""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalar import lookup

# fixed values: sector name -> sector fund; anything else is measured against the index fund
SECTOR_ETFS = {
    "Technology": "XLK", "Financial Services": "XLF", "Healthcare": "XLV", "Consumer Cyclical": "XLY",
    "Consumer Defensive": "XLP", "Communication Services": "XLC", "Energy": "XLE", "Industrials": "XLI",
    "Basic Materials": "XLB", "Real Estate": "XLRE", "Utilities": "XLU",
}
BENCHMARKS = ["SPY", "QQQ"]


def sector_benchmark(universe: DataFrame, etfs: dict[str, str] = SECTOR_ETFS, default: str = "SPY") -> DataFrame:
    return universe.select("symbol", F.coalesce(lookup(F.col("sector"), etfs), F.lit(default)).alias("benchmark"))


def date_grid(dates: DataFrame, horizon: int = 1) -> DataFrame:
    """Each distinct as_of with the date `horizon` steps later on the same grid. The window walks
    calendar dates only."""
    w = Window.partitionBy(F.lit(0)).orderBy("as_of")
    return dates.select("as_of").distinct().select("as_of", F.lead("as_of", horizon).over(w).alias("exit"))


def forward_returns(prices: DataFrame, dates: DataFrame, horizon: int = 1) -> DataFrame:
    """(as_of, symbol, fwd): price at the grid date `horizon` steps on over the price now. Exact dates at
    both ends; a symbol that has no bar on either date has NULL."""
    grid = date_grid(dates, horizon)
    now = prices.select("symbol", F.col("as_of"), F.col("adj_close").alias("_p0")).join(grid, "as_of")
    then = prices.select("symbol", F.col("as_of").alias("exit"), F.col("adj_close").alias("_p1"))
    return now.join(then, ["symbol", "exit"], "left").select("as_of", "symbol", (F.col("_p1") / F.col("_p0") - 1).alias("fwd"))


def top_n(scores: DataFrame, column: str, n: int) -> DataFrame:
    """The n best symbols per date; NULL scores never qualify, ties break by symbol."""
    w = Window.partitionBy("as_of").orderBy(F.col(column).desc(), F.col("symbol"))
    return scores.where(F.col(column).isNotNull()).select("as_of", "symbol", F.row_number().over(w).alias("pick")).where(F.col("pick") <= n)


def rebalance(scores: DataFrame, forward: DataFrame, column: str, n: int, cost_bps: float = 0.0, benchmark_for: DataFrame | None = None) -> DataFrame:
    """One row per rebalance date: return net of costs, turnover and the sector-matched return.

    Dates without any forward return or without picks are skipped, and the next date trades against the
    last book actually held. That book is found by a join on the running number of the kept dates, so
    nothing loops over time.
    """
    live = forward.where("fwd is not null").select("as_of").distinct()
    picks = top_n(scores, column, n).join(live, "as_of", "left_semi")
    sizes = picks.groupBy("as_of").agg(F.count(F.lit(1)).alias("_n"))
    steps = sizes.select("as_of", "_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("as_of")).alias("_i"))
    book = picks.select("as_of", "symbol").join(steps, "as_of").select("as_of", "_i", "symbol", (F.lit(1.0) / F.col("_n")).alias("_w"))
    # trade = weight now minus weight in the previous book: both books as signed rows, summed by symbol
    moves = book.select("_i", "symbol", F.col("_w").alias("_m")).unionByName(
        book.select((F.col("_i") + 1).alias("_i"), "symbol", (-F.col("_w")).alias("_m"))
    )
    traded = moves.groupBy("_i", "symbol").agg(F.sum("_m").alias("_m")).groupBy("_i").agg(F.sum(F.abs("_m")).alias("_traded"))
    held = book.join(forward, ["as_of", "symbol"], "left")
    gains = [F.avg("fwd").alias("_gross")]
    if benchmark_for is not None:
        bench = forward.select("as_of", F.col("symbol").alias("benchmark"), F.col("fwd").alias("_bench"))
        held = held.join(benchmark_for, "symbol", "left").join(bench, ["as_of", "benchmark"], "left")
        gains.append(F.avg("_bench").alias("sector_benchmark"))
    out = held.groupBy("as_of", "_i").agg(*gains).join(traded, "_i")
    cols = [(F.col("_gross") - F.col("_traded") * (cost_bps / 1e4)).alias("strategy"), (F.col("_traded") / 2).alias("turnover")]
    return out.select("as_of", *cols, *(["sector_benchmark"] if benchmark_for is not None else []))


def average_turnover(strategies: dict[str, DataFrame]) -> DataFrame:
    """(name, turnover): each strategy's mean over its own dates, the first purchase included."""
    parts = [table.agg(F.avg("turnover").alias("turnover")).select(F.lit(name).alias("name"), "turnover") for name, table in strategies.items()]
    return reduce(DataFrame.unionByName, parts)


def universe_returns(scores: DataFrame, forward: DataFrame) -> DataFrame:
    """Equal-weight return of the scored symbols per date."""
    return scores.select("as_of", "symbol").join(forward, ["as_of", "symbol"], "left").groupBy("as_of").agg(F.avg("fwd").alias("universe"))


def _log_growth(ret: Column) -> Column:
    return F.when(ret > -1, F.log1p(ret)).when(ret <= -1, F.lit(float("-inf")))


def equity_curve(returns: DataFrame, by: list[str], time: str = "as_of", value: str = "ret") -> DataFrame:
    """Compounded equity, its running peak and the drawdown from it. A strategy has one row per period,
    so the window is bounded by the calendar."""
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    curve = returns.where(F.col(value).isNotNull()).withColumn("equity", F.exp(F.sum(_log_growth(F.col(value))).over(w)))
    return curve.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def performance(returns: DataFrame, benchmark: str | None = None, by: str = "name", periods: int = 12) -> DataFrame:
    """Per series: CAGR, volatility, drawdown, Sharpe, Sortino, share of periods above `benchmark`."""
    curve = equity_curve(returns, [by])
    year = math.sqrt(periods)
    if benchmark is not None:
        ref = returns.where(F.col(by) == benchmark).select("as_of", F.col("ret").alias("_ref"))
        curve = curve.join(ref, "as_of", "left")
    downside = F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))) * year
    vol = F.stddev_samp("ret") * year
    mean = F.avg("ret") * periods
    stats = [
        F.count("ret").alias("periods"),
        (F.exp(F.sum(_log_growth(F.col("ret"))) * (F.lit(float(periods)) / F.count("ret"))) - 1).alias("cagr"),
        vol.alias("volatility"), F.min("drawdown").alias("max_drawdown"),
        F.when(vol != 0, mean / F.nullif(vol, F.lit(0.0))).alias("sharpe"),
        F.when(downside != 0, mean / F.nullif(downside, F.lit(0.0))).alias("sortino"),
    ]
    if benchmark is not None:
        stats.append(F.avg(F.coalesce(F.col("ret") > F.col("_ref"), F.lit(False)).cast("double")).alias("win_rate"))
    return curve.groupBy(by).agg(*stats)


def backtest_returns(strategies: dict[str, DataFrame], universe: DataFrame, forward: DataFrame, benchmarks: list[str] = BENCHMARKS) -> DataFrame:
    """Long (as_of, name, ret) over the dates at which *every* series has a value."""
    parts = []
    for name, table in strategies.items():
        parts.append(table.select("as_of", F.lit(name).alias("name"), F.col("strategy").alias("ret")))
        if "sector_benchmark" in table.columns:
            parts.append(table.select("as_of", F.lit(f"{name}_sector_matched").alias("name"), F.col("sector_benchmark").alias("ret")))
    parts.append(universe.select("as_of", F.lit("equal_weight_universe").alias("name"), F.col("universe").alias("ret")))
    parts.append(forward.where(F.col("symbol").isin(benchmarks)).select("as_of", F.col("symbol").alias("name"), F.col("fwd").alias("ret")))
    width = sum(1 + ("sector_benchmark" in t.columns) for t in strategies.values()) + 1 + len(benchmarks)
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    long = long.where("ret is not null")
    w = Window.partitionBy("as_of")
    return long.withColumn("_width", F.count(F.lit(1)).over(w)).where(F.col("_width") == width).drop("_width")
