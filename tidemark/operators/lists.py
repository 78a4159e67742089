"""Latest rows, movers, rankings, pages and per-symbol documents."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.scalar import output_date, output_number
from tidemark.operators.scoring import CATEGORIES, SCORE_COLUMNS

DELTA_ROWS, STALE_DAYS, PAGE_ROWS, PRICE_DAYS = 3, 10, 50, 252


def latest_per_symbol(df: DataFrame, time: str = "as_of") -> DataFrame:
    rest = [c for c in df.columns if c != "symbol"]
    return df.groupBy("symbol").agg(F.max_by(F.struct(*rest), time).alias("_r")).select("symbol", "_r.*")


def fresh(latest: DataFrame, days: int = STALE_DAYS, time: str = "as_of") -> DataFrame:
    """Rows at most `days` older than the newest of all (a scalar subquery)."""
    return latest.where(F.col(time) >= latest.agg(F.date_sub(F.max(time), days)).scalar())


def with_row_change(scores: DataFrame, column: str = "total", rows: int = DELTA_ROWS) -> DataFrame:
    """Latest row per symbol with the change against `rows` rows earlier and the symbol's row count."""
    w = Window.partitionBy("symbol").orderBy("as_of")
    marked = scores.withColumn(f"{column}_change", F.col(column) - F.lag(column, rows).over(w))
    rest = [c for c in marked.columns if c != "symbol"]
    return marked.groupBy("symbol").agg(F.max_by(F.struct(*rest), "as_of").alias("_r"), F.count(F.lit(1)).alias("history")).select("symbol", "_r.*", "history")


def with_date_change(scores: DataFrame, steps: int = DELTA_ROWS, column: str = "total") -> DataFrame:
    """Rows of the newest date with the change against the date `steps` distinct dates earlier (over all
    symbols, unlike `with_row_change`)."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("as_of").desc())
    dates = scores.select("as_of").distinct().withColumn("_i", F.row_number().over(w)).where(F.col("_i").isin(1, steps + 1))
    marked = scores.join(dates, "as_of")
    earlier = marked.where(F.col("_i") == steps + 1).select("symbol", F.col(column).alias("_old"))
    return marked.where("_i = 1").drop("_i").join(earlier, "symbol", "left").withColumn(f"{column}_change", F.col(column) - F.col("_old")).drop("_old")


def top_lists(latest: DataFrame, columns: Sequence[str], n: int = 15) -> DataFrame:
    """The n best per column as one long table (list, rank, symbol, value); change columns also give the
    n worst under `<column>_worst`."""
    pairs = [(c, c, 1) for c in columns] + [(f"{c}_worst", c, -1) for c in columns if c.endswith("_change")]
    items = ", ".join(f"'{name}', cast({c} * {sign} as double)" for name, c, sign in pairs)
    long = latest.select("symbol", F.expr(f"stack({len(pairs)}, {items}) as (list, _v)")).where("_v is not null")
    w = Window.partitionBy("list").orderBy(F.col("_v").desc(), "symbol")
    out = long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return out.select("list", "rank", "symbol", F.when(F.endswith("list", F.lit("_worst")), -F.col("_v")).otherwise(F.col("_v")).alias("value"))


def top_symbols(scores: DataFrame, universe: DataFrame, financials: DataFrame, n: int) -> DataFrame:
    """Best latest totals among equities with more than three score rows and an annual filing."""
    latest = with_row_change(scores).where(F.col("history") > DELTA_ROWS)
    able = latest.join(universe.where("quote_type = 'EQUITY'").select("symbol"), "symbol", "left_semi")
    able = able.join(financials.where("period_type = 'FY'").select("symbol"), "symbol", "left_semi").where("total is not null")
    return able.orderBy(F.col("total").desc(), "symbol").limit(n).select("symbol", "as_of", "total")


def ranking(latest: DataFrame, category: str, n: int = 10) -> DataFrame:
    """Top n of the fresh latest rows by a category, or by the total when the category is empty everywhere."""
    if category not in latest.columns:
        category = "total"
    rows = fresh(latest)
    known = rows.agg(F.count(category) > 0).scalar()
    keyed = rows.withColumn("_v", F.when(known, F.col(category)).otherwise(F.col("total"))).where("_v is not null")
    return keyed.orderBy(F.col("_v").desc(), "symbol").limit(n).select("symbol", *[F.round(c).cast("int").alias(c) for c in SCORE_COLUMNS])


def page(rows: DataFrame, *, query: str = "", sector: str | None = None, sort: str = "total", ascending: bool = False, number: int = 0, size: int = PAGE_ROWS) -> DataFrame:
    """Search by symbol or name, filter by sector, sort with missing values last when falling, cut a page."""
    out = rows if sector is None else rows.where(F.col("sector") == sector)
    if query:
        q = F.lit(query.lower())
        out = out.where(F.contains(F.lower("symbol"), q) | F.contains(F.lower(F.coalesce("name", F.lit(""))), q))
    order = F.col(sort).asc_nulls_first() if ascending else F.col(sort).desc_nulls_last()
    return out.orderBy(order, "symbol").offset(number * size).limit(size)


def price_history(bars: DataFrame, n: int = PRICE_DAYS) -> DataFrame:
    """The last n bars per symbol as two parallel arrays in time order."""
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    last = bars.select("symbol", "date", "close", F.row_number().over(w).alias("_i")).where(F.col("_i") <= n)
    packed = last.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("b"))
    return packed.select("symbol", F.transform("b", lambda x: output_date(x["date"])).alias("dates"), F.transform("b", lambda x: output_number(x["close"])).alias("closes"))


def score_history(scores: DataFrame) -> DataFrame:
    packed = scores.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("as_of", *SCORE_COLUMNS))).alias("b"))
    series = [F.transform(F.col(f"b.{c}"), output_number).alias(c) for c in SCORE_COLUMNS]
    return packed.select("symbol", F.struct(F.transform("b", lambda x: output_date(x["as_of"])).alias("as_of"), *series).alias("score_history"))


def latest_notes(research: DataFrame) -> DataFrame:
    """Newest note per symbol; the raw reply stands in for the thesis when no field was parsed."""
    fields = ["thesis", "bull_case", "bear_case", "risks", "contradictions"]
    n = latest_per_symbol(research, "generated_at")
    empty = F.coalesce(*[F.when(F.col(f) != "", F.col(f)) for f in fields]).isNull()
    return n.withColumn("thesis", F.when(empty, F.col("raw")).otherwise(F.col("thesis"))).drop("raw")


def factor_map(metrics: DataFrame) -> DataFrame:
    names = [c for c in metrics.columns if c not in ("symbol", "as_of")]
    last = latest_per_symbol(metrics)
    return last.select("symbol", F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[output_number(F.col(c)) for c in names])).alias("factors"))


def symbol_documents(universe: DataFrame, bars: DataFrame, scores: DataFrame, metrics: DataFrame, snaps: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """One nested document per scored symbol: identity, price history, score history, factors, indicators by
    timeframe, note. Every part is one row per symbol before the joins."""
    fields = ["close", "change_pct", "rsi", "atr", "supertrend", "iix"]
    snap = F.struct(*[output_number(F.col(c)).alias(c) for c in fields], F.col("direction").alias("supertrend_direction"), "alligator")
    by_tf = snaps.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct(F.col("tf"), snap))).alias("indicators"))
    out = universe.select("symbol", "name", "sector", "industry").join(score_history(scores), "symbol")
    out = out.join(price_history(bars).select("symbol", F.struct(F.col("dates").alias("date"), F.col("closes").alias("close")).alias("prices")), "symbol", "left")
    out = out.join(factor_map(metrics), "symbol", "left").join(by_tf, "symbol", "left")
    if notes is not None:
        packed = notes.select("symbol", F.struct("generated_at", "as_of", "model", "thesis", "bull_case", "bear_case", "risks", "contradictions").alias("research"))
        out = out.join(packed, "symbol", "left")
    return out


def index_rows(scores: DataFrame, universe: DataFrame) -> DataFrame:
    """One row per equity with more than three score rows: latest scores, the three-row change, and the model's score
    where `scores` carries one."""
    latest = with_row_change(scores).where(F.col("history") > DELTA_ROWS)
    names = universe.where("quote_type = 'EQUITY'").select("symbol", "name", "sector")
    return latest.join(names, "symbol").select("symbol", "name", "sector", *[output_number(F.col(c)).alias(c) for c in SCORE_COLUMNS], *[output_number(F.col(c)).alias(c) for c in ("total_change", "ml_score") if c in latest.columns])


def shortlist(rows: DataFrame, daily: DataFrame, notes: DataFrame | None = None, n: int = 10) -> DataFrame:
    """The n best totals among rows with all six scores, with the daily snapshot and the thesis."""
    best = rows.dropna(subset=SCORE_COLUMNS).orderBy(F.col("total").desc(), "symbol").limit(n)
    out = best.join(daily.withColumnRenamed("close", "last_close"), "symbol", "left")
    return out.join(notes.select("symbol", "thesis"), "symbol", "left") if notes is not None else out


# fixed values: display names of the factors
FACTOR_LABELS = {
    "net_margin": "net margin", "gross_margin": "gross margin", "operating_margin": "operating margin", "fcf_margin": "free-cash-flow margin",
    "roe": "return on equity", "roa": "return on assets", "debt_to_equity": "debt/equity", "liabilities_to_assets": "liabilities/assets",
    "revenue_growth": "revenue growth", "net_income_growth": "net income growth", "eps_growth": "EPS growth",
    "pe": "P/E", "ps": "P/S", "pb": "P/B", "fcf_yield": "free-cash-flow yield",
    "ret_3m": "3m return", "ret_6m": "6m return", "ret_12m_ex_1m": "12m return excl. last month", "sma200_gap": "distance above the 200-day average",
    "vol_60d": "60-day volatility", "drawdown_252d": "drawdown from the 1-year high",
}


def data_dictionary(metrics: DataFrame) -> DataFrame:
    """Per category: its factors with direction, and how many rows of `metrics` have each."""
    counts = metrics.agg(*[F.count(f).alias(f) for fs in CATEGORIES.values() for f in fs if f in metrics.columns])
    names = counts.columns
    long = counts.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{c}', {c}" for c in names) + ") as (factor, present)"))
    from tidemark.functions.scalar import lookup

    category = lookup(F.col("factor"), {f: c for c, fs in CATEGORIES.items() for f in fs})
    better = lookup(F.col("factor"), {f: "higher" if up else "lower" for fs in CATEGORIES.values() for f, up in fs.items()})
    return long.select("factor", category.alias("category"), lookup(F.col("factor"), FACTOR_LABELS).alias("label"), better.alias("better"), "present")


def one_hot(df: DataFrame, column: str, keys: Sequence[str], min_rows: int = 30) -> DataFrame:
    """Long one-hot: (keys, category) for categories with at least `min_rows` rows."""
    kept = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    return df.select(*keys, column).join(kept, column, "left").select(*keys, F.when(F.col("_n").isNotNull(), F.col(column)).alias(column))

