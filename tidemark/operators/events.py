"""Recommendation event study: merged sources, forward returns, controls, exits, and report tables."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalar import cap_bucket, lookup
from tidemark.operators.asof import asof_join
from tidemark.operators.ranks import quantiles, running_totals, unpivot
from tidemark.operators.spells import eligible_strict
from tidemark.staging import staged

# fixed values: former ticker -> current ticker; dated corrections; snapshot day of the sheet; horizons
ALIASES = {"FB": "META", "SQ": "XYZ", "WETF": "WT", "FEYE": "MNDT", "NCR": "VYX", "SPB": "JEF", "SINA": "WB", "GOOGL": "GOOG"}
DATED_FIXES = {("2020-01-16", "A"): "NICE"}
SHEET_SNAPSHOT = "2020-04-08"
HORIZONS = {"30d": 30, "90d": 90, "180d": 180, "365d": 365}
MAX_GAP_DAYS = 5
CONTROLS_PER_PICK, CONTROL_HISTORY_DAYS, SEED = 10, 400, 7
KEYS = ["rec_date", "symbol", "action"]


def current_ticker(symbol: Column, aliases: Mapping[str, str] = ALIASES) -> Column:
    return F.coalesce(lookup(symbol, aliases), symbol)


def price_ticker(symbol: Column) -> Column:
    return F.replace(symbol, F.lit("."), F.lit("-"))


def dated_fix(date: Column, symbol: Column, fixes: Mapping[tuple[str, str], str] = DATED_FIXES) -> Column:
    """Corrections keyed by (date, symbol); they apply before aliases."""
    key = F.concat_ws("|", F.date_format(date, "yyyy-MM-dd"), symbol)
    return F.coalesce(lookup(key, {f"{d}|{s}": v for (d, s), v in fixes.items()}), symbol)


def merge_sources(sheet: DataFrame, listed: DataFrame, aliases: Mapping[str, str] = ALIASES, fixes: Mapping[tuple[str, str], str] = DATED_FIXES) -> DataFrame:
    """Both recommendation sources on (date, current symbol, action), with provenance and the running
    number of BUYs per symbol. The sheet is reduced to one row per key; the list is kept as it is."""
    cols = ["company", "delisted", "closed_date", "market_cap", "team", "risk_rating", "rec_price", "return", "spx_return", "excess_return", "price_unavailable"]
    left = sheet.select("rec_date", current_ticker(F.col("ticker"), aliases).alias("symbol"), F.lit("BUY").alias("action"), F.struct(F.col("ticker").alias("ticker_at_rec"), *cols).alias("x"))
    left = left.groupBy(*KEYS).agg(F.min("x").alias("x"))
    right = listed.select(
        F.col("date").alias("rec_date"), current_ticker(dated_fix(F.col("date"), F.col("symbol"), fixes), aliases).alias("symbol"), F.col("recommendation").alias("action"),
        F.struct(F.col("name")).alias("n"),
    )
    both = left.join(right, KEYS, "full_outer")
    x = lambda c: F.col(f"x.{c}")
    out = both.select(
        *KEYS, F.coalesce(x("company"), F.col("n.name")).alias("company"), F.coalesce(x("ticker_at_rec"), F.col("symbol")).alias("ticker_at_rec"),
        price_ticker(F.col("symbol")).alias("yf_symbol"),
        F.when(F.col("n").isNull(), "xlsx").when(F.col("x").isNull(), "newrecs").otherwise("both").alias("source"),
        x("delisted").alias("delisted"), x("closed_date").alias("closed_date"), x("market_cap").alias("market_cap"), x("team").alias("team"),
        x("risk_rating").alias("risk_rating"), x("rec_price").alias("rec_price"), x("price_unavailable").alias("price_unavailable"),
        F.when(x("return").isNotNull(), F.coalesce(x("closed_date"), F.to_date(F.lit(SHEET_SNAPSHOT)))).alias("mf_return_end"),
        x("return").alias("mf_return"), x("spx_return").alias("mf_spx_return"), x("excess_return").alias("mf_excess_return"),
    )
    return number_buys(out)


def number_buys(recs: DataFrame) -> DataFrame:
    """nth BUY per symbol and repeat flag; other actions carry NULL and false. Rows are unique per day and
    action, so a symbol's window is bounded by the calendar."""
    buy = F.col("action") == "BUY"
    w = Window.partitionBy("symbol").orderBy("rec_date", "action").rowsBetween(Window.unboundedPreceding, 0)
    out = recs.withColumn("buy_number", F.when(buy, F.sum(buy.cast("long")).over(w)))
    return out.withColumn("is_repeat", F.coalesce(F.col("buy_number") > 1, F.lit(False)))


def forward_returns(recs: DataFrame, bars: DataFrame, index_bars: DataFrame, *, symbol: str = "yf_symbol", date: str = "rec_date", horizons: Mapping[str, int] = HORIZONS) -> DataFrame:
    """Entry bar and forward returns per recommendation, against the index over the same days.

    Entry is the first bar on or after the date, each exit the first bar on or after date + horizon; a gap
    above five days means none, and without an entry there is no return. All targets are matched in one
    as-of pass over the distinct (symbol, day) probes, and the index is read at the bars' own dates.
    """
    keys = recs.select(F.col(symbol).alias("symbol"), F.col(date).alias("_d"))
    offsets = {"entry": 0, **horizons}
    # the probes of all horizons form one set; each day of a symbol is searched once and tells, bit by bit, for which
    # horizons, so that no join leads back to the probes
    legs = F.array(*[F.struct(F.lit(n).alias("h"), F.lit(d).alias("days"), F.lit(1 << i).alias("bit")) for i, (n, d) in enumerate(offsets.items())])
    spread = keys.select("symbol", "_d", F.explode(legs).alias("p")).select("symbol", F.date_add("_d", F.col("p.days")).alias("t"), "p.bit")
    probes = spread.where("t is not null").groupBy("symbol", "t").agg(F.bit_or("bit").alias("_legs"))
    index = index_bars.select(F.lit(1).alias("_one"), "date", F.col("adj_close").alias("idx"))
    days = bars.select(F.lit(1).alias("_one"), F.col("date").alias("_bar")).distinct()
    index_at = asof_join(days, index, ["_one"], "_bar", "date", ["idx"], direction="forward", unique_left=True).drop("_one")
    priced = bars.select("symbol", "date", "close", "adj_close")
    hit = asof_join(probes, priced, ["symbol"], "t", "date", ["close", "adj_close"], direction="forward", tolerance_days=MAX_GAP_DAYS, matched_time="_bar", unique_left=True)
    hit = hit.where("_bar is not null").join(index_at, "_bar", "left")
    hit = hit.select("*", F.explode(F.filter(legs, lambda p: p["bit"].bitwiseAND(F.col("_legs")) != 0)).alias("p"))
    hit = hit.select("symbol", F.date_sub("t", F.col("p.days")).alias("_d"), "p.h", "_bar", "close", "adj_close", "idx")
    at = lambda n, c: F.max(F.when(F.col("h") == n, F.col(c)))
    wide = hit.groupBy("symbol", "_d").agg(
        at("entry", "_bar").alias("entry_date"), at("entry", "close").alias("entry_close"), at("entry", "adj_close").alias("entry_adj"), at("entry", "idx").alias("_i0"),
        *[at(n, "adj_close").alias(f"_p_{n}") for n in horizons], *[at(n, "idx").alias(f"_i_{n}") for n in horizons],
    ).where("entry_date is not null")
    out = wide.select(
        F.col("symbol").alias("_s"), "_d", "entry_date", "entry_close", "entry_adj",
        *[(F.col(f"_p_{n}") / F.col("entry_adj") - 1).alias(f"ret_{n}") for n in horizons],
        *[F.when(F.col(f"_p_{n}").isNotNull(), F.col(f"_i_{n}") / F.col("_i0") - 1).alias(f"spy_{n}") for n in horizons],
    )
    joined = recs.join(out, (F.col(symbol) == F.col("_s")) & (F.col(date) == F.col("_d")), "left").drop("_s", "_d")
    return joined.select("*", *[(F.col(f"ret_{n}") - F.col(f"spy_{n}")).alias(f"excess_{n}") for n in horizons])


def beat_label(df: DataFrame, horizon: str = "365d") -> DataFrame:
    """Three-valued: NULL while the outcome is unknown."""
    return df.withColumn(f"beat_spy_{horizon}", F.col(f"excess_{horizon}") > 0)


RINGS = 64


def ring_number(*parts: Column | str) -> Column:
    """A 32-bit number of a text: the first eight hex digits of its md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def sample_controls(picks: DataFrame, bars: DataFrame, per_pick: int = CONTROLS_PER_PICK, seed: int = SEED, index: str = "SPY", universe: DataFrame | None = None, arcs: int | None = None) -> DataFrame:
    """Date-matched controls: per pick date, up to `per_pick` times the picks, drawn without replacement from
    symbols with 400 days of history that still trade and are not picked that day (known equities only where a
    `universe` is given).

    A date is dealt one of RINGS orders of the symbols and a starting point on that ring, both by a hash of the
    date; it takes the first free symbols that are alive on it. Rings are cut into arcs, which serve as an index
    alone: a date opens as many as its number of living symbols suggests, and twice as many while they hold too
    few free ones. So a date never meets every symbol, and the draw does not depend on the number of arcs.
    """
    spans = bars.where(F.col("symbol") != index).groupBy("symbol").agg(F.date_add(F.min("date"), CONTROL_HISTORY_DAYS).alias("first"), F.max("date").alias("last")).where("first <= last")
    if universe is not None:
        spans = eligible_strict(spans, universe)
    spans = staged(spans, "spans")
    taken = staged(picks.select("rec_date", "symbol").union(picks.select("rec_date", F.col("yf_symbol"))).distinct(), "taken")
    dates = picks.groupBy("rec_date").agg((F.count(F.lit(1)) * per_pick).alias("_n"))
    dates = dates.join(taken.groupBy("rec_date").agg(F.count(F.lit(1)).alias("_taken")), "rec_date")
    steps = spans.select(F.col("first").alias("rec_date"), F.lit(1).alias("_step")).unionByName(spans.select(F.date_add("last", 1).alias("rec_date"), F.lit(-1).alias("_step"))).groupBy("rec_date").agg(F.sum("_step").alias("_step"))
    line = steps.join(dates, "rec_date", "full")
    upto = Window.orderBy("rec_date").rowsBetween(Window.unboundedPreceding, 0)  # calendar days
    dates = line.withColumn("_alive", F.coalesce(F.sum("_step").over(upto), F.lit(0))).where("_n is not null and _alive > 0")
    day = F.date_format("rec_date", "yyyy-MM-dd")
    if arcs is None:
        arcs = 1 << max(0, (spans.count() // 16).bit_length())
    width = (1 << 32) // arcs
    dates = dates.select("rec_date", "_n", (ring_number(F.lit(f"ring{seed}"), day) % RINGS).alias("_ring"), ring_number(F.lit(f"start{seed}"), day).alias("_start"),
                         F.ceil(F.lit(1.5 * arcs) * (F.col("_n") + F.col("_taken")) / F.col("_alive")).cast("long").alias("_open"))
    waiting, drawn = staged(dates, "dates"), []
    rings = spans.withColumn("_ring", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(RINGS - 1).cast("long"))))
    rings = rings.withColumn("place", ring_number(F.lit(f"place{seed}"), F.col("_ring").cast("string"), "symbol")).withColumn("_arc", F.floor(F.col("place") / width))
    while not waiting.isEmpty():
        opened = waiting.withColumn("_open", F.least("_open", F.lit(arcs + 1).cast("long")))
        asked = opened.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_open"), F.lit(arcs).cast("long")) - 1))).withColumn("_arc", (F.floor(F.col("_start") / width) + F.col("_i")) % arcs)
        # the planner does not know how many arcs a date opens: sent to every task, they would pass through the driver
        near = asked.join(rings.hint("merge"), ["_ring", "_arc"]).where("first <= rec_date and rec_date <= last").withColumn("_turn", F.pmod(F.col("place") - F.col("_start"), F.lit(1 << 32)))
        whole = F.col("_open") > arcs  # the first arc counts from the start on; it is complete once all are open
        near = near.where(whole | (F.col("_turn") < F.col("_open") * width - F.col("_start") % width))
        free = near.join(taken, ["rec_date", "symbol"], "left_anti")
        w = Window.partitionBy("rec_date").orderBy("_turn", "symbol")  # little more than _n rows
        got = staged(free.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= F.col("_n")).select("rec_date", "symbol", "_k", "_n", "_open"), "controls")
        enough = got.where(f"_k = _n or _open > {arcs}").select("rec_date").distinct()
        drawn.append(got.join(enough, "rec_date", "left_semi").select("rec_date", "symbol"))
        waiting = staged(opened.where(f"_open <= {arcs}").join(enough, "rec_date", "left_anti").withColumn("_open", F.col("_open") * 2 + 1), "dates")
    none = spans.select(F.lit(None).cast("date").alias("rec_date"), "symbol").limit(0)
    out = reduce(DataFrame.unionByName, drawn, none)
    return out.select("rec_date", "symbol", F.col("symbol").alias("yf_symbol"))


def entry_profile(buys: DataFrame, bars: DataFrame, index_bars: DataFrame) -> DataFrame:
    """Profile of the year before entry: momentum, index momentum, distance to the year's high and low.
    Needs 150 bars inside the half-open year and a first bar at least a year old."""
    day = F.datediff("date", F.to_date(F.lit("1970-01-01")))
    w = Window.partitionBy("symbol").orderBy("_day")
    year = w.rangeBetween(-364, 0)
    marked = bars.select("symbol", "date", "adj_close", day.alias("_day"))
    prof = marked.select(
        "symbol", "date", F.col("adj_close").alias("_last"), F.first("adj_close").over(year).alias("_first"), F.max("adj_close").over(year).alias("_high"), F.min("adj_close").over(year).alias("_low"),
        F.count(F.lit(1)).over(year).alias("_bars"), F.min("date").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_start"),
    )
    at = prof.withColumnRenamed("symbol", "yf_symbol").withColumnRenamed("date", "entry_date")
    spots = buys.select("entry_date").where("entry_date is not null").distinct().select(F.lit(1).alias("_one"), "entry_date", F.date_sub("entry_date", 365).alias("_back"))
    index = index_bars.select(F.lit(1).alias("_one"), "date", F.col("adj_close").alias("_x"))
    now = asof_join(spots, index, ["_one"], "entry_date", "date", ["_x"], unique_left=True).withColumnRenamed("_x", "_x1")
    both = asof_join(now, index, ["_one"], "_back", "date", ["_x"], unique_left=True).select("entry_date", (F.col("_x1") / F.col("_x") - 1).alias("_spy"))
    out = buys.join(at, ["yf_symbol", "entry_date"], "left").join(both, "entry_date", "left")
    ok = (F.col("_bars") >= 150) & (F.col("_start") <= F.date_sub("entry_date", 365))
    mom = F.col("_last") / F.col("_first") - 1
    return out.select(
        *buys.columns, F.when(ok, mom).alias("mom_12m"), F.when(ok, F.col("_spy")).alias("spy_12m"),
        F.when(ok, F.col("_last") / F.col("_high") - 1).alias("from_52w_high"), F.when(ok, F.col("_last") / F.col("_low") - 1).alias("from_52w_low"),
        F.when(ok, mom - F.col("_spy")).alias("rel_mom_12m"),
    )


def exit_review(recs: DataFrame, bars: DataFrame, index_bars: DataFrame) -> DataFrame:
    """Each SELL or REDUCE against the first BUY of the symbol, provided it came before: holding return,
    index return, and the year after the exit where bars reach that far."""
    first_buy = recs.where("action = 'BUY'").groupBy("symbol").agg(F.min_by(F.struct("rec_date", "entry_date", "entry_adj"), "rec_date").alias("b"))
    span = bars.groupBy(F.col("symbol").alias("yf_symbol")).agg(F.max("date").alias("_end"))
    sells = recs.where("action in ('SELL', 'REDUCE')").select("symbol", "yf_symbol", "action", F.col("rec_date").alias("sell"))
    pairs = sells.join(first_buy, "symbol").where("b.rec_date < sell and b.entry_adj is not null").join(span, "yf_symbol").where("_end >= sell")
    pairs = pairs.withColumn("_after", F.when(F.col("_end") >= F.date_add("sell", 365), F.date_add("sell", 365)))
    own = bars.select(F.col("symbol").alias("yf_symbol"), "date", F.col("adj_close").alias("_v"))
    pairs = asof_join(pairs, own, ["yf_symbol"], "sell", "date", ["_v"]).withColumnRenamed("_v", "_sell_px")
    pairs = asof_join(pairs, own, ["yf_symbol"], "_after", "date", ["_v"]).withColumnRenamed("_v", "_after_px")
    index = index_bars.select(F.lit(1).alias("_one"), "date", F.col("adj_close").alias("_v"))
    pairs = pairs.withColumn("_one", F.lit(1)).withColumn("_bought", F.col("b.entry_date"))
    for col, name in (("sell", "_i_sell"), ("_bought", "_i_buy"), ("_after", "_i_after")):
        pairs = asof_join(pairs, index, ["_one"], col, "date", ["_v"]).withColumnRenamed("_v", name)
    out = pairs.select(
        "symbol", "action", F.col("b.rec_date").alias("buy"), "sell", F.datediff("sell", F.col("b.rec_date")).alias("held_days"),
        (F.col("_sell_px") / F.col("b.entry_adj") - 1).alias("hold_ret"), (F.col("_i_sell") / F.col("_i_buy") - 1).alias("hold_spy"),
        (F.col("_after_px") / F.col("_sell_px") - 1).alias("after_365d"), (F.col("_i_after") / F.col("_i_sell") - 1).alias("after_spy"),
    )
    return out.select("*", (F.col("hold_ret") - F.col("hold_spy")).alias("hold_excess"), (F.col("after_365d") - F.col("after_spy")).alias("after_excess"))


# --- report tables -------------------------------------------------------------------------------
def with_report_columns(recs: DataFrame, universe: DataFrame) -> DataFrame:
    sectors = universe.select("symbol", "sector")
    return recs.join(sectors, "symbol", "left").withColumn("cap_bucket", cap_bucket(F.col("market_cap"))).withColumn("year", F.year("rec_date"))


def outcome_by(labelled: DataFrame, group: str, ret: str = "ret_365d", excess: str = "excess_365d") -> DataFrame:
    """n, median return, median excess and share beating the index per group; NULL groups are dropped."""
    rows = labelled.where(F.col(group).isNotNull())
    base = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col(excess) > 0, F.lit(False)).cast("double")).alias("beat_spy"))
    m1 = quantiles(rows, [group], ret, {"med_365d": 0.5})
    m2 = quantiles(rows, [group], excess, {"med_excess": 0.5})
    return base.join(m1, group, "left").join(m2, group, "left")


def describe(df: DataFrame, columns: Sequence[str], against: Mapping[str, str] | None = None) -> DataFrame:
    """Long summary: one row per column with count, mean, std, min, quartiles, max (interpolated). `against` maps a
    column to the one that holds its lead over the index; `beat_spy` is then the share of positive leads."""
    against = against or {}
    long = unpivot(df, [], list(columns), "column").where("value is not null")
    base = long.groupBy("column").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    out = base.join(quantiles(long, ["column"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}), "column")
    if against:
        leads = unpivot(df.select(*[F.col(lead).alias(c) for c, lead in against.items()]), [], list(against), "column").where("value is not null")
        out = out.join(leads.groupBy("column").agg(F.avg((F.col("value") > 0).cast("double")).alias("beat_spy")), "column", "left")
    return out


def coverage_by_year(recs: DataFrame) -> DataFrame:
    buy = F.col("action") == "BUY"
    n = lambda cond, name: F.count_if(cond).alias(name)
    return recs.groupBy(F.year("rec_date").alias("year")).agg(
        n(buy, "buys"), n(F.col("action").isin("SELL", "REDUCE"), "exits"), n(F.col("action") == "HOLD", "holds"),
        n(buy & F.col("mf_return").isNotNull(), "buys_with_return"), n(buy & F.col("entry_date").isNotNull(), "buys_with_price"), n(buy & F.col("ret_365d").isNotNull(), "buys_with_label"),
    )


def cadence(buys: DataFrame, per_month: int = 2) -> DataFrame:
    monthly = buys.groupBy(F.trunc("rec_date", "MM").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.weekday("rec_date").isin(3, 4)).alias("late"))
    return monthly.agg(
        F.avg((F.col("n") == per_month).cast("double")).alias("share_months"), (F.sum("late") / F.sum("n")).alias("share_thu_fri"),
        (F.sum("n") / F.count_distinct(F.year("m"))).alias("per_year"), F.min("m").alias("first_month"), F.max("m").alias("last_month"),
    )


def top_counts(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(column)).limit(n)


def concentration(df: DataFrame, value: str, k: int = 10) -> DataFrame:
    """Share of the k largest in the sum of positives."""
    top = df.where(F.col(value).isNotNull()).select(value).orderBy(F.col(value).desc()).limit(k).agg(F.sum(value))
    return df.agg(F.count(value).alias("n"), F.sum(F.greatest(F.col(value), F.lit(0.0))).alias("_all")).select("n", (top.scalar() / F.col("_all")).alias("top_share"))


def trimmed_mean(df: DataFrame, rank_by: str, value: str, share: float = 0.01, date: str = "rec_date", tie: str = "symbol") -> DataFrame:
    """Mean of `value` with and without the max(1, floor(share n)) rows of the largest `rank_by`; ties at the
    cut go by date, then `tie`. The cut is found from counts per distinct value, then per date inside the
    tied value, so even a tie that holds a third of all rows is never sorted as one group."""
    rows = df.where(F.col(rank_by).isNotNull()).withColumn("_day", F.datediff(date, F.to_date(F.lit("1970-01-01"))).cast("double"))
    k = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n_total") * F.lit(share)).cast("long"))
    above = F.col("n_total") - F.col("n_before") - F.col("n")  # rows with a larger value
    marked = running_totals(rows, [], rank_by, {"n": F.count(F.lit(1))}).select(rank_by, "n", (k - above).alias("_room"))
    whole = rows.join(marked.where("_room >= n").select(rank_by), rank_by)
    tied = rows.join(marked.where("_room > 0 and _room < n").select(rank_by, "_room"), rank_by)
    by_day = running_totals(tied, [rank_by, "_room"], "_day", {"n": F.count(F.lit(1))}).where("n_before < _room").select(rank_by, "_day", (F.col("_room") - F.col("n_before")).alias("_left"))
    w = Window.partitionBy(rank_by, "_day").orderBy(tie)  # one day's rows of one value
    cut = tied.join(by_day, [rank_by, "_day"]).withColumn("_k", F.row_number().over(w)).where("_k <= _left")
    part = lambda d, sign: d.agg(F.sum(value).alias("s"), F.count(value).alias("c")).withColumn("sign", F.lit(sign))
    parts = part(rows, 1).unionByName(part(whole, -1)).unionByName(part(cut, -1))
    all_s, all_c = (F.sum(F.when(F.col("sign") == 1, F.col(c))) for c in ("s", "c"))
    rest_s, rest_c = (F.sum(F.col("sign") * F.col(c)) for c in ("s", "c"))
    return parts.agg((all_s / all_c).alias("mean_all"), (rest_s / rest_c).alias("mean_trimmed"), (all_c - rest_c).alias("dropped"))


def correlations(df: DataFrame, rows: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Pearson, pairwise complete, long form (row, column, r); one pass computes every pair."""
    pairs = [(a, b) for a in rows for b in columns]
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    items = ", ".join(f"'{a}', '{b}', c{i}" for i, (a, b) in enumerate(pairs))
    return one.select(F.expr(f"stack({len(pairs)}, {items}) as (row, column, r)"))


def presence(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).isNotNull().cast("double")).alias(f"has_{c}") for c in columns])
