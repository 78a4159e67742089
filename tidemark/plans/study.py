"""Recommendations: cleaning, merging, forward returns, controls, exits, report tables."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.scalar import clipped, log_cap, sic_bucket
from tidemark.operators import events as ev, facts as fx, lists as ls, prices as px, ranks as rk, scoring as sc, text as tx
from tidemark.plans.cte import CTES, define, percent
from tidemark.plans.market import price_scores, financial_table
from tidemark.plans.registry import query, r, rounded
from tidemark.plans.standins import Lake, symbol_of
from tidemark.sources import text_files as tf
from tidemark.staging import staged

# --- sources -----------------------------------------------------------------------------------
define("list_rows", """
SELECT day AS date, 'S' || k AS symbol, min('Company ' || k) AS name, action AS recommendation FROM calls WHERE o_orderstatus IN ('O', 'P') GROUP BY 1, 2, 4
""")
define("sheet_rows", """
SELECT day AS rec_date, 'Company ' || k AS company, 'S' || k || CASE WHEN k % 11 = 0 THEN '.DL1' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN ' old' ELSE '' END AS ticker_raw, 'S' || k AS ticker,
  k % 11 = 0 AND true AS delisted0, CASE WHEN o_orderkey % 4 = 0 THEN CAST(day + 200 AS DATE) END AS closed_date, CASE WHEN o_orderkey % 9 <> 0 THEN floor(o_totalprice) * 1e6 END AS market_cap,
  CASE WHEN o_orderkey % 2 = 0 THEN 'David' ELSE 'Tom' END AS team, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 25 AS DOUBLE) END AS risk_rating,
  CASE WHEN o_orderkey % 8 <> 0 THEN CAST(o_orderkey % 300 + 1 AS DOUBLE) END AS rec_price,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 1000 AS DOUBLE) / 500 - 0.5::DOUBLE END AS ret, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 100 AS DOUBLE) / 1000 END AS spx_return,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 1000 AS DOUBLE) / 500 - 0.5::DOUBLE - CAST(o_orderkey % 100 AS DOUBLE) / 1000 END AS excess_return, o_orderkey % 8 = 0 AS price_unavailable
FROM calls WHERE o_orderstatus IN ('F', 'P') AND action = 'BUY'
""")


@query("S9", "SELECT date, symbol, name, recommendation FROM list_rows")
def recommendation_list(lake: Lake) -> DataFrame:
    return tf.clean_list(lake.raw_list)


@query("S10", """SELECT rec_date, company, ticker_raw, ticker, (ticker_raw LIKE '%.DL1') AS delisted, closed_date, market_cap, team, risk_rating, rec_price, round(ret, 6) AS return,
 round(spx_return, 6) AS spx_return, round(excess_return, 6) AS excess_return, price_unavailable FROM sheet_rows""")
def picks_sheet(lake: Lake) -> DataFrame:
    return rounded(tf.clean_sheet(lake.raw_sheet))


@query("S8", "SELECT symbol, start_d AS start, end_d AS \"end\" FROM spells")
def membership_file(lake: Lake) -> DataFrame:
    """Spells written out as text columns and parsed back; blank end dates stay open."""
    raw = lake.spells.select(F.col("symbol").alias("ticker"), F.date_format("start", "yyyy-MM-dd").alias("start_date"), F.coalesce(F.date_format("end", "yyyy-MM-dd"), F.lit("")).alias("end_date"))
    return tf.membership_rows(raw)


@query("S11", """
SELECT symbol, concept, round(value, 4) AS value, unit, period_start, period_end, form, filed_at, accession_no FROM facts WHERE concept <> 'Goodwill'
""")
def facts_from_json(lake: Lake) -> DataFrame:
    """Facts folded into one company document each, then read back out of the JSON."""
    f = lake.facts
    entry = F.struct(F.col("value").alias("val"), F.date_format("period_start", "yyyy-MM-dd").alias("start"), F.date_format("period_end", "yyyy-MM-dd").alias("end"), "form", F.date_format("filed_at", "yyyy-MM-dd").alias("filed"), F.col("accession_no").alias("accn"))
    units = f.groupBy("symbol", "concept", "unit").agg(F.collect_list(entry).alias("e"))
    concepts = units.groupBy("symbol", "concept").agg(F.map_from_entries(F.collect_list(F.struct("unit", "e"))).alias("units"))
    docs = concepts.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct("units")))).alias("us-gaap"))
    json = docs.select("symbol", F.to_json(F.struct(F.struct("us-gaap").alias("facts"))).alias("json"))
    return rounded(tf.extract_facts(json, list(fx.CONCEPT_COLUMNS)), 4)


define("filing_list", "SELECT DISTINCT symbol, form, accession_no AS accn, filed_at AS filed, 'd-' || accession_no || '.htm' AS doc FROM facts")


@query("S12", "SELECT symbol, form, arg_max(accn, (filed, accn)) AS accn, max(filed) AS filed, arg_max(doc, (filed, accn)) AS doc FROM filing_list WHERE form IN ('10-K', '10-Q') GROUP BY 1, 2")
def latest_filings(lake: Lake) -> DataFrame:
    lists = lake.facts.select("symbol", "form", F.col("accession_no").alias("accn"), "filed_at").distinct()
    newest = F.reverse(F.array_sort(F.collect_list(F.struct("filed_at", "accn", "form"))))
    sub = lists.groupBy("symbol").agg(newest.alias("l")).select(
        "symbol", F.col("l.form").alias("form"), F.col("l.accn").alias("accn"), F.transform("l.filed_at", lambda d: F.date_format(d, "yyyy-MM-dd")).alias("filed"),
        F.transform("l.accn", lambda a: F.concat(F.lit("d-"), a, F.lit(".htm"))).alias("doc"),
    )
    return tf.latest_filings(sub)


# --- merged table --------------------------------------------------------------------------------
define("sheet_unique", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_date, ticker ORDER BY ticker, company, ticker_raw LIKE '%.DL1', closed_date NULLS FIRST, market_cap NULLS FIRST, team, risk_rating NULLS FIRST, rec_price NULLS FIRST, ret NULLS FIRST) AS rn FROM sheet_rows) WHERE rn = 1")
define("merged", """
SELECT *, CASE WHEN action = 'BUY' THEN CAST(sum(CASE WHEN action = 'BUY' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY rec_date, action ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS buy_number FROM (
SELECT coalesce(s.rec_date, l.date) AS rec_date, coalesce(s.ticker, l.symbol) AS symbol, coalesce(s.action, l.recommendation) AS action, coalesce(s.company, l.name) AS company,
  CASE WHEN l.symbol IS NULL THEN 'xlsx' WHEN s.ticker IS NULL THEN 'newrecs' ELSE 'both' END AS source, closed_date, market_cap, team, risk_rating, s.ret AS mf_return, excess_return AS mf_excess_return,
  CASE WHEN s.ret IS NOT NULL THEN coalesce(closed_date, DATE '2020-04-08') END AS mf_return_end
FROM (SELECT *, 'BUY' AS action FROM sheet_unique) s FULL JOIN list_rows l ON s.rec_date = l.date AND s.ticker = l.symbol AND s.action = l.recommendation)
""")


def merged(lake: Lake) -> DataFrame:
    return ev.merge_sources(tf.clean_sheet(lake.raw_sheet), tf.clean_list(lake.raw_list))


@query("J7 W12 P14", "SELECT rec_date, symbol, action, company, source, closed_date, market_cap, team, round(mf_return, 6) AS mf_return, mf_return_end, buy_number, coalesce(buy_number > 1, false) AS is_repeat FROM merged")
def merged_recommendations(lake: Lake) -> DataFrame:
    cols = ["rec_date", "symbol", "action", "company", "source", "closed_date", "market_cap", "team", "mf_return", "mf_return_end", "buy_number", "is_repeat"]
    return rounded(merged(lake).select(*cols))


@query("P14", """
SELECT day AS rec_date, k, CASE WHEN k = 3 AND day = DATE '1996-01-16' THEN 'NICE' WHEN k % 4 = 0 THEN 'N' || k ELSE 'S-' || k END AS yf_symbol FROM (SELECT DISTINCT day, k FROM calls)
""")
def ticker_fixes(lake: Lake) -> DataFrame:
    """Aliases built from the supplier table, one dated correction, dots to dashes."""
    pairs = lake.calls.select(F.col("day").alias("rec_date"), "k").distinct()
    sym = F.concat(F.lit("S."), F.col("k").cast("string"))
    fixed = ev.dated_fix(F.col("rec_date"), sym, {("1996-01-16", "S.3"): "NICE"})
    aliases = lake.table("supplier").where("s_suppkey % 4 = 0").select(F.concat(F.lit("S."), F.col("s_suppkey").cast("string")).alias("s"), F.concat(F.lit("N"), F.col("s_suppkey").cast("string")).alias("alias"))
    return pairs.withColumn("s", fixed).join(aliases, "s", "left").select("rec_date", "k", ev.price_ticker(F.coalesce("alias", "s")).alias("yf_symbol"))


_H = {"30d": 30, "90d": 90, "180d": 180, "365d": 365}
define("entries", """
SELECT m.*, b.date AS entry_date, b.close AS entry_close, b.adj_close AS entry_adj, i.adj_close AS entry_idx FROM merged m
ASOF LEFT JOIN bars b ON b.symbol = m.symbol AND b.date >= m.rec_date LEFT JOIN idx i ON i.date = b.date
""")
define("entry_rows", """
SELECT * EXCLUDE (entry_date, entry_close, entry_adj, entry_idx), CASE WHEN entry_date - rec_date <= 5 THEN entry_date END AS entry_date, CASE WHEN entry_date - rec_date <= 5 THEN entry_close END AS entry_close,
 CASE WHEN entry_date - rec_date <= 5 THEN entry_adj END AS entry_adj, CASE WHEN entry_date - rec_date <= 5 THEN entry_idx END AS entry_idx FROM entries
""")
_prev = "entry_rows"
for _n, _d in _H.items():
    define(f"exit_{_n}", f"""
SELECT e.*, CASE WHEN b.date - (e.rec_date + {_d}) <= 5 THEN b.adj_close / e.entry_adj - 1 END AS ret_{_n}, CASE WHEN b.date - (e.rec_date + {_d}) <= 5 AND e.entry_adj IS NOT NULL THEN i.adj_close / e.entry_idx - 1 END AS spy_{_n}
FROM {_prev} e ASOF LEFT JOIN bars b ON b.symbol = e.symbol AND b.date >= CAST(e.rec_date + {_d} AS DATE) LEFT JOIN idx i ON i.date = b.date""")
    _prev = f"exit_{_n}"
define("recs", f"SELECT *, symbol AS yf_symbol, year(rec_date) AS yr, {', '.join(f'ret_{n} - spy_{n} AS excess_{n}' for n in _H)} FROM {_prev}")


def recommendations(lake: Lake) -> DataFrame:
    return ev.forward_returns(staged(merged(lake), "merged"), lake.bar_table, lake.index_bars)


def rec_table(lake: Lake) -> DataFrame:
    return staged(recommendations(lake), "recs")


_FWD = [f"{p}_{n}" for p in ("ret", "spy", "excess") for n in _H]


@query("Q5 J10", f"SELECT rec_date, symbol, action, entry_date, round(entry_close, 10) AS entry_close, round(entry_adj, 10) AS entry_adj, {r(_FWD)} FROM recs", name="recommendations")
def recommendations_query(lake: Lake) -> DataFrame:
    out = recommendations(lake).select("rec_date", "symbol", "action", "entry_date", "entry_close", "entry_adj", *_FWD)
    return rounded(out.withColumn("entry_close", F.round("entry_close", 10)).withColumn("entry_adj", F.round("entry_adj", 10)), keep=("entry_close", "entry_adj"))


@query("P15", "SELECT rec_date, symbol, action, excess_365d > 0 AS beat_spy_365d FROM recs")
def outcome_labels(lake: Lake) -> DataFrame:
    return ev.beat_label(recommendations(lake)).select("rec_date", "symbol", "action", "beat_spy_365d")


# --- report --------------------------------------------------------------------------------------
define("buys", """
SELECT r.*, u.sector, CASE WHEN market_cap <= 0 THEN NULL WHEN market_cap <= 2e9 THEN '<2B' WHEN market_cap <= 1e10 THEN '2-10B' WHEN market_cap <= 5e10 THEN '10-50B' WHEN market_cap <= 2e11 THEN '50-200B' WHEN market_cap IS NOT NULL THEN '>200B' END AS cap_bucket
FROM recs r LEFT JOIN universe u USING (symbol) WHERE action = 'BUY'
""")


def buys(lake: Lake) -> DataFrame:
    return staged(ev.with_report_columns(recommendations(lake), lake.universe).where("action = 'BUY'"), "buys")


def _outcome_sql(group: str, alias: str, labelled: bool) -> str:
    return (f"SELECT {group} AS {alias}, count(*) AS n, round(median(ret_365d), 6) AS med_365d, round(median(excess_365d), 6) AS med_excess, round(avg(CAST(coalesce(excess_365d > 0, false) AS INT)), 6) AS beat_spy "
            f"FROM buys WHERE {'ret_365d IS NOT NULL AND ' if labelled else ''}{group} IS NOT NULL GROUP BY 1")


@query("A15 P13 cap bucket", _outcome_sql("cap_bucket", "cap_bucket", False))
def outcome_by_cap(lake: Lake) -> DataFrame:
    return rounded(ev.outcome_by(buys(lake), "cap_bucket"))


@query("A15 sector", _outcome_sql("sector", "sector", False))
def outcome_by_sector(lake: Lake) -> DataFrame:
    return rounded(ev.outcome_by(buys(lake), "sector"))


@query("A15 year", _outcome_sql("yr", "year", True))
def outcome_by_year(lake: Lake) -> DataFrame:
    return rounded(ev.outcome_by(buys(lake).where("ret_365d is not null"), "year").withColumn("year", F.col("year").cast("long")))


@query("A15 team", _outcome_sql("team", "team", True))
def outcome_by_team(lake: Lake) -> DataFrame:
    return rounded(ev.outcome_by(buys(lake).where("ret_365d is not null"), "team"))


@query("A16", "\nUNION ALL ".join(
    f"SELECT 'ret_{n}' AS \"column\", count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS p25, round(median(x), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, round(max(x), 6) AS max, round(avg(CAST(e > 0 AS INT)), 6) AS beat_spy FROM (SELECT ret_{n} AS x, excess_{n} AS e FROM buys WHERE ret_365d IS NOT NULL)"
    for n in _H))
def return_summary(lake: Lake) -> DataFrame:
    return rounded(ev.describe(buys(lake).where("ret_365d is not null"), [f"ret_{n}" for n in _H], {f"ret_{n}": f"excess_{n}" for n in _H}))


@query("A17", """
SELECT CAST(yr AS BIGINT) AS year, count(*) FILTER (action = 'BUY') AS buys, count(*) FILTER (action IN ('SELL', 'REDUCE')) AS exits, count(*) FILTER (action = 'HOLD') AS holds,
 count(*) FILTER (action = 'BUY' AND mf_return IS NOT NULL) AS buys_with_return, count(*) FILTER (action = 'BUY' AND entry_date IS NOT NULL) AS buys_with_price, count(*) FILTER (action = 'BUY' AND ret_365d IS NOT NULL) AS buys_with_label
FROM recs GROUP BY 1
""")
def coverage_by_year(lake: Lake) -> DataFrame:
    return ev.coverage_by_year(rec_table(lake)).withColumn("year", F.col("year").cast("long"))


@query("A18", """
SELECT round(avg(CAST(n = 2 AS INT)), 6) AS share_months, round(sum(late) / sum(n), 6) AS share_thu_fri, round(sum(n) / count(DISTINCT year(m)), 6) AS per_year, min(m) AS first_month, max(m) AS last_month
FROM (SELECT CAST(date_trunc('month', rec_date) AS DATE) AS m, count(*) AS n, count(*) FILTER (isodow(rec_date) IN (4, 5)) AS late FROM merged WHERE action = 'BUY' GROUP BY 1)
""")
def cadence(lake: Lake) -> DataFrame:
    return rounded(ev.cadence(merged(lake).where("action = 'BUY'")))


@query("A19", "SELECT symbol, count(*) AS n FROM merged WHERE action = 'BUY' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def top_repeated(lake: Lake) -> DataFrame:
    return ev.top_counts(merged(lake).where("action = 'BUY'"), "symbol", 12)


@query("A19 source", "SELECT source, count(*) AS n FROM merged GROUP BY 1")
def source_overlap(lake: Lake) -> DataFrame:
    return ev.top_counts(merged(lake), "source", 10)


@query("A20", "SELECT count(mf_return) AS n, round((SELECT sum(mf_return) FROM (SELECT mf_return FROM merged WHERE action = 'BUY' AND mf_return IS NOT NULL ORDER BY 1 DESC LIMIT 10)) / sum(greatest(mf_return, 0)) FILTER (mf_return IS NOT NULL), 6) AS top_share FROM merged WHERE action = 'BUY'")
def concentration(lake: Lake) -> DataFrame:
    return rounded(ev.concentration(staged(merged(lake).where("action = 'BUY'"), "buys"), "mf_return"))


@query("A21", """
SELECT round(avg(excess_365d), 6) AS mean_all, round(avg(excess_365d) FILTER (rn > k), 6) AS mean_trimmed, count(excess_365d) FILTER (rn <= k) AS dropped FROM
 (SELECT *, row_number() OVER (ORDER BY ret_365d DESC, rec_date, symbol) AS rn, greatest(1, floor(count(*) OVER () * 0.01)) AS k FROM buys WHERE ret_365d IS NOT NULL)
""")
def trimmed_mean(lake: Lake) -> DataFrame:
    return rounded(ev.trimmed_mean(buys(lake), "ret_365d", "excess_365d"))


@query("K9", "SELECT 'best' AS kind, rec_date, symbol, round(mf_return, 6) AS mf_return FROM (SELECT * FROM buys WHERE mf_return IS NOT NULL ORDER BY mf_return DESC, rec_date, symbol LIMIT 10) UNION ALL SELECT 'worst', rec_date, symbol, round(mf_return, 6) FROM (SELECT * FROM buys WHERE mf_return IS NOT NULL ORDER BY mf_return, rec_date, symbol LIMIT 10)")
def best_and_worst(lake: Lake) -> DataFrame:
    b = staged(merged(lake).where("action = 'BUY' and mf_return is not null"), "buys").select("rec_date", "symbol", "mf_return")
    top = lambda kind, order: b.orderBy(order, "rec_date", "symbol").limit(10).select(F.lit(kind).alias("kind"), "*")
    return rounded(top("best", F.col("mf_return").desc()).unionByName(top("worst", F.col("mf_return").asc())))


# --- profile, exits, controls ----------------------------------------------------------------------
define("profile", """
SELECT rec_date, symbol, mom_12m, spy_12m, from_52w_high, from_52w_low, mom_12m - spy_12m AS rel_mom_12m, ret_365d, excess_365d FROM (
 SELECT e.rec_date, e.symbol, e.ret_365d, e.excess_365d, CASE WHEN ok THEN last / first - 1 END AS mom_12m, CASE WHEN ok THEN i1.adj_close / i0.adj_close - 1 END AS spy_12m, CASE WHEN ok THEN last / high - 1 END AS from_52w_high, CASE WHEN ok THEN last / low - 1 END AS from_52w_low
 FROM (SELECT b.rec_date, b.symbol, b.entry_date, b.ret_365d, b.excess_365d, CAST(coalesce(b.entry_date, DATE '1900-01-01') - 365 AS DATE) AS back, coalesce(b.entry_date, DATE '1900-01-01') AS at, y.*, y.n >= 150 AND y.start <= b.entry_date - 365 AS ok
   FROM buys b LEFT JOIN (SELECT symbol AS s, date AS d, arg_max(p, pd) AS last, arg_min(p, pd) AS first, max(p) AS high, min(p) AS low, count(*) AS n, any_value(start) AS start
     FROM (SELECT a.symbol, a.date, p.adj_close AS p, p.date AS pd, a.start FROM (SELECT *, min(date) OVER (PARTITION BY symbol) AS start FROM bars) a JOIN bars p ON p.symbol = a.symbol AND p.date <= a.date AND p.date > a.date - 365) GROUP BY 1, 2) y
   ON y.s = b.symbol AND y.d = b.entry_date) e
 ASOF LEFT JOIN idx i1 ON i1.date <= e.at ASOF LEFT JOIN idx i0 ON i0.date <= e.back)
""")
_PROF = ["mom_12m", "spy_12m", "from_52w_high", "from_52w_low", "rel_mom_12m"]


def profile(lake: Lake) -> DataFrame:
    return ev.entry_profile(buys(lake), lake.bar_table, lake.index_bars)


@query("W14 J12", f"SELECT rec_date, symbol, {r(_PROF)} FROM profile")
def entry_profile(lake: Lake) -> DataFrame:
    return rounded(profile(lake).select("rec_date", "symbol", *_PROF))


_ROWS, _COLS = ["mom_12m", "rel_mom_12m", "from_52w_high"], ["ret_365d", "excess_365d"]


@query("A22", "\nUNION ALL ".join(f"SELECT '{a}' AS \"row\", '{b}' AS \"column\", round(corr({a}, {b}), 6) AS r FROM profile" for a in _ROWS for b in _COLS))
def profile_correlations(lake: Lake) -> DataFrame:
    return rounded(ev.correlations(profile(lake).where("mom_12m is not null"), _ROWS, _COLS))


define("exits", """
SELECT s.symbol, s.action, b.rec_date AS buy, s.rec_date AS sell, s.rec_date - b.rec_date AS held_days, p.adj_close / b.entry_adj - 1 AS hold_ret, i1.adj_close / i0.adj_close - 1 AS hold_spy,
 CASE WHEN e.last >= s.rec_date + 365 THEN q.adj_close / p.adj_close - 1 END AS after_365d, CASE WHEN e.last >= s.rec_date + 365 THEN i2.adj_close / i1.adj_close - 1 END AS after_spy
FROM (SELECT *, CAST(rec_date + 365 AS DATE) AS after FROM recs WHERE action IN ('SELL', 'REDUCE')) s
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rec_date) AS rn FROM recs WHERE action = 'BUY') WHERE rn = 1) b ON b.symbol = s.symbol AND b.rec_date < s.rec_date AND b.entry_adj IS NOT NULL
JOIN (SELECT symbol, max(date) AS last FROM bars GROUP BY 1) e ON e.symbol = s.symbol AND e.last >= s.rec_date
ASOF LEFT JOIN bars p ON p.symbol = s.symbol AND p.date <= s.rec_date ASOF LEFT JOIN bars q ON q.symbol = s.symbol AND q.date <= s.after
ASOF LEFT JOIN idx i1 ON i1.date <= s.rec_date ASOF LEFT JOIN idx i0 ON i0.date <= b.entry_date ASOF LEFT JOIN idx i2 ON i2.date <= s.after
""")
_EX = ["hold_ret", "hold_spy", "after_365d", "after_spy"]


@query("J18 J12", f"SELECT symbol, action, buy, sell, CAST(held_days AS BIGINT) AS held_days, {r(_EX)}, round(hold_ret - hold_spy, 6) AS hold_excess, round(after_365d - after_spy, 6) AS after_excess FROM exits")
def exit_review(lake: Lake) -> DataFrame:
    out = ev.exit_review(rec_table(lake), lake.bar_table, lake.index_bars)
    return rounded(out.withColumn("held_days", F.col("held_days").cast("long")))


def picks(lake: Lake) -> DataFrame:
    return recommendations(lake).where("action = 'BUY'").select("rec_date", "symbol", "yf_symbol", "team", "is_repeat", "buy_number", "source", "mf_return")


_NUMBER = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
define("drawn", f"""
SELECT rec_date, symbol FROM (
 SELECT d.rec_date, s.symbol, d.n, row_number() OVER (PARTITION BY d.rec_date ORDER BY ({_NUMBER.format("'place7|' || ring || '|' || s.symbol")} - start + 4294967296) % 4294967296, s.symbol) AS k
 FROM (SELECT rec_date, count(*) * 10 AS n, {_NUMBER.format("'ring7|' || strftime(rec_date, '%Y-%m-%d')")} % 64 AS ring, {_NUMBER.format("'start7|' || strftime(rec_date, '%Y-%m-%d')")} AS start FROM merged WHERE action = 'BUY' GROUP BY 1) d
 JOIN (SELECT symbol, min(date) AS first, max(date) AS last FROM bars JOIN universe USING (symbol) WHERE quote_type = 'EQUITY' GROUP BY 1) s ON s.first + 400 <= d.rec_date AND s.last >= d.rec_date
 WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.action = 'BUY' AND m.rec_date = d.rec_date AND m.symbol = s.symbol)) WHERE k <= n
""")


@query("J17 draw", "SELECT rec_date, symbol, symbol AS yf_symbol FROM drawn")
def controls(lake: Lake) -> DataFrame:
    p = staged(merged(lake).where("action = 'BUY'").select("rec_date", "symbol", "yf_symbol"), "picks")
    return ev.sample_controls(p, lake.bar_table, universe=lake.universe)


@query("J17", "SELECT rec_date, count(drawn.symbol) AS controls FROM (SELECT DISTINCT rec_date FROM merged WHERE action = 'BUY') LEFT JOIN drawn USING (rec_date) GROUP BY 1")
def control_counts(lake: Lake) -> DataFrame:
    """How many controls each pick date gets."""
    p = staged(merged(lake).where("action = 'BUY'").select("rec_date", "symbol", "yf_symbol"), "picks")
    drawn = ev.sample_controls(p, lake.bar_table, universe=lake.universe).groupBy("rec_date").agg(F.count(F.lit(1)).alias("controls"))
    return p.select("rec_date").distinct().join(drawn, "rec_date", "left").select("rec_date", F.coalesce("controls", F.lit(0)).alias("controls"))


define("bar_features", """
SELECT symbol, date, rn, adj_close / lag(adj_close, 21) OVER w - 1 AS ret_1m, adj_close / lag(adj_close, 63) OVER w - 1 AS ret_3m, adj_close / lag(adj_close, 126) OVER w - 1 AS ret_6m, lag(adj_close, 21) OVER w / lag(adj_close, 252) OVER w - 1 AS ret_12m_ex_1m,
 adj_close / lag(adj_close, 756) OVER w - 1 AS ret_36m, adj_close / avg(adj_close) OVER (w ROWS 199 PRECEDING) - 1 AS sma200_gap, stddev_pop(r) OVER (w ROWS 59 PRECEDING) * sqrt(252) AS vol_60d,
 adj_close / max(adj_close) OVER (w ROWS 251 PRECEDING) - 1 AS drawdown_252d, adj_close / min(adj_close) OVER (w ROWS 251 PRECEDING) - 1 AS from_52w_low
FROM (SELECT symbol, date, adj_close, adj_close / lag(adj_close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM (SELECT symbol, date, adj_close FROM bars UNION ALL SELECT symbol, date, adj_close FROM idx))
WINDOW w AS (PARTITION BY symbol ORDER BY date)
""")
_OWN = [c for c in px.EVENT_FEATURES if not c.startswith("rel_")]
define("event_rows", f"""
SELECT m.rec_date, m.symbol, m.action, {", ".join(f"CASE WHEN f.rn > 252 AND m.rec_date - f.date <= 5 THEN f.{c} END AS {c}" for c in _OWN)},
 CASE WHEN f.rn > 252 AND m.rec_date - f.date <= 5 THEN f.ret_3m - i.ret_3m END AS rel_ret_3m, CASE WHEN f.rn > 252 AND m.rec_date - f.date <= 5 THEN f.ret_12m_ex_1m - i.ret_12m_ex_1m END AS rel_ret_12m_ex_1m
FROM merged m ASOF LEFT JOIN bar_features f ON f.symbol = m.symbol AND f.date <= m.rec_date ASOF LEFT JOIN (SELECT * FROM bar_features WHERE symbol = 'SPY') i ON i.date <= m.rec_date
""")


@query("W9 J11", f"SELECT rec_date, symbol, action, {r(px.EVENT_FEATURES)} FROM event_rows")
def event_price_features(lake: Lake) -> DataFrame:
    events = staged(merged(lake).select("rec_date", "symbol", "action"), "events")
    return rounded(px.event_features(events, lake.bar_table, lake.index_bars))


# pairs (symbol, date): naive twin
define("pairs", "SELECT DISTINCT symbol, rec_date FROM merged WHERE action = 'BUY'")
define("pair_price", """
SELECT p.symbol, p.rec_date AS as_of, CASE WHEN p.rec_date - b.date <= 5 THEN b.close * coalesce((SELECT product(ratio) FROM split_table s WHERE s.symbol = p.symbol AND s.date > b.date), 1) END AS price FROM pairs p ASOF LEFT JOIN bars b ON b.symbol = p.symbol AND b.date <= p.rec_date
""")
define("pair_known", "SELECT p.symbol, p.as_of, f.* EXCLUDE (symbol) FROM pair_price p JOIN financials f ON f.symbol = p.symbol AND f.filed < p.as_of WHERE price IS NOT NULL")


def _pair_cte(name: str, source: str) -> None:
    define("pair_" + name, CTES[source].replace("known_rows", "pair_known").replace("known_periods", "pair_periods").replace("fy_rows", "pair_fy").replace("panel_probes", "pair_price"))


_pair_cte("periods", "known_periods")
_pair_cte("ttm", "ttm_rows")
_pair_cte("fy", "fy_rows")
_pair_cte("prior", "fy_prior_rows")
_pair_cte("balance", "balance_rows")
from tidemark.plans.market import _RATIO_SQL  # noqa: E402


@query("Q10 A7 J11 J13", f"""
SELECT symbol, as_of AS rec_date, {r(fx.FUNDAMENTAL_FACTORS)}, round(log10(market_cap), 6) AS log_market_cap, CAST(filing_age_days AS BIGINT) AS filing_age_days FROM (
SELECT p.symbol, p.as_of, {_RATIO_SQL.replace("ttm_rows", "pair_ttm")}, price * b_shares AS market_cap, p.as_of - known_filed AS filing_age_days FROM pair_price p
LEFT JOIN pair_ttm t USING (symbol, as_of) LEFT JOIN pair_fy f USING (symbol, as_of) LEFT JOIN pair_prior USING (symbol, as_of) LEFT JOIN pair_balance USING (symbol, as_of))
""")
def pit_fundamentals_for_pairs(lake: Lake) -> DataFrame:
    p = staged(merged(lake).where("action = 'BUY'").select("symbol", "rec_date").distinct(), "pairs")
    out = fx.fundamentals_for_pairs(p, financial_table(lake), lake.bar_table, lake.splits)
    out = out.withColumn("filing_age_days", F.col("filing_age_days").cast("long")).withColumn("log_market_cap", F.log10("market_cap")).drop("market_cap")
    return rounded(out)


# --- training table --------------------------------------------------------------------------------
_APP = {"quality": "app_quality", "momentum": "app_momentum", "risk": "app_risk", "total": "app_total"}
define("ranked_scores", f"SELECT *, {percent('total', True)} AS total_pct FROM price_scores")
define("app_rows", """
SELECT p.symbol, p.rec_date, CASE WHEN p.rec_date - s.as_of <= 62 THEN s.momentum END AS app_momentum, CASE WHEN p.rec_date - s.as_of <= 62 THEN s.risk END AS app_risk, CASE WHEN p.rec_date - s.as_of <= 62 THEN s.total END AS app_total,
 CASE WHEN p.rec_date - s.as_of <= 62 THEN s.total_pct END AS app_total_pct FROM pairs p ASOF LEFT JOIN ranked_scores s ON s.symbol = p.symbol AND s.as_of < p.rec_date
""")


def app_scores(lake: Lake, probes: DataFrame, unique: bool = True) -> DataFrame:
    return sc.attach_scores(probes, price_scores(lake), unique=unique)


@query("J8 M6", f"SELECT symbol, rec_date, {r('app_momentum app_risk app_total app_total_pct')} FROM app_rows")
def app_scores_at_pick(lake: Lake) -> DataFrame:
    out = app_scores(lake, merged(lake).where("action = 'BUY'").select("symbol", "rec_date").distinct())
    return rounded(out.select("symbol", "rec_date", "app_momentum", "app_risk", "app_total", "app_total_pct"))


@query("M6 A28", """
SELECT repeat, n, round(med_pct, 6) AS med_pct, round(med_momentum, 6) AS med_momentum, round(share_top_quartile, 6) AS share_top_quartile, round(share_top_decile, 6) AS share_top_decile FROM
(SELECT coalesce(m.buy_number > 1, false) AS repeat, count(*) AS n, median(app_total_pct) AS med_pct, median(app_momentum) AS med_momentum, avg(CAST(app_total_pct >= 0.75 AS INT)) AS share_top_quartile, avg(CAST(app_total_pct >= 0.9 AS INT)) AS share_top_decile
FROM merged m JOIN app_rows a USING (symbol, rec_date) WHERE m.action = 'BUY' AND app_total_pct IS NOT NULL GROUP BY 1)
""")
def rank_position(lake: Lake) -> DataFrame:
    """Where the ranking put first and repeated picks."""
    m = staged(merged(lake).where("action = 'BUY'").select("symbol", "rec_date", "is_repeat"), "picks")
    a = staged(app_scores(lake, m).withColumnRenamed("is_repeat", "repeat"), "ranked")
    out = sc.position_by(a, "repeat", medians=("app_total_pct", "app_momentum"))
    return rounded(out.withColumnRenamed("med_app_total_pct", "med_pct").withColumnRenamed("med_app_momentum", "med_momentum"))


@query("A28 halves", """
SELECT CASE WHEN app_total_pct >= 0.5 THEN 'top' ELSE 'bottom' END AS half, count(*) AS n, round(median(excess_365d), 6) AS median FROM buys JOIN app_rows USING (symbol, rec_date) WHERE app_total_pct IS NOT NULL AND excess_365d IS NOT NULL GROUP BY 1
""")
def outcome_by_half(lake: Lake) -> DataFrame:
    labelled = buys(lake).select("symbol", "rec_date", "excess_365d").where("excess_365d is not null")
    return rounded(sc.outcome_by_half(staged(app_scores(lake, labelled), "ranked")))


@query("A13", """
SELECT measure, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM (SELECT measure, rank() OVER (PARTITION BY measure ORDER BY value) + (count(*) OVER (PARTITION BY measure, value) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY measure ORDER BY excess_365d) + (count(*) OVER (PARTITION BY measure, excess_365d) - 1) / 2.0 AS ry
FROM (SELECT measure, value, excess_365d FROM (SELECT 'app_momentum' AS measure, app_momentum AS value, excess_365d FROM buys JOIN app_rows USING (symbol, rec_date) UNION ALL SELECT 'app_risk', app_risk, excess_365d FROM buys JOIN app_rows USING (symbol, rec_date) UNION ALL SELECT 'app_total', app_total, excess_365d FROM buys JOIN app_rows USING (symbol, rec_date)) WHERE value IS NOT NULL AND excess_365d IS NOT NULL)) GROUP BY 1
""")
def score_outcome_correlation(lake: Lake) -> DataFrame:
    labelled = buys(lake).select("symbol", "rec_date", "excess_365d").where("excess_365d is not null")
    a = app_scores(lake, labelled)
    long = staged(rk.unpivot(a, ["symbol", "rec_date", "excess_365d"], ["app_momentum", "app_risk", "app_total"]).where("value is not null"), "long")
    return rounded(rk.spearman(long, ["measure"], ["symbol", "rec_date"], "value", "excess_365d"))


# the twins of picks alone, read for picks and controls
_TRAIN = ["entries", "entry_rows", *[f"exit_{n}" for n in _H], "recs", "event_rows", "pairs", *[f"pair_{n}" for n in ("price", "known", "periods", "ttm", "fy", "prior", "balance")], "app_rows"]


def _for_training(sql: str) -> str:
    swapped = re.sub(rf"\b({'|'.join(_TRAIN)})\b", r"train_\1", sql)
    return re.sub(r"\bmerged\b", "train_base", swapped).replace("m.action", "m.is_pick").replace(" WHERE action = 'BUY'", "")


define("train_base", "SELECT rec_date, symbol, 1 AS is_pick FROM merged WHERE action = 'BUY' UNION ALL SELECT rec_date, symbol, 0 AS is_pick FROM drawn")
for _n in _TRAIN:
    define(f"train_{_n}", _for_training(CTES[_n]))
define("train_ratios", _for_training(f"""
SELECT p.symbol, p.as_of AS rec_date, {_RATIO_SQL.replace("ttm_rows", "pair_ttm")}, price * b_shares AS market_cap, p.as_of - known_filed AS filing_age_days FROM pair_price p
LEFT JOIN pair_ttm t USING (symbol, as_of) LEFT JOIN pair_fy f USING (symbol, as_of) LEFT JOIN pair_prior USING (symbol, as_of) LEFT JOIN pair_balance USING (symbol, as_of)
"""))
define("train_rows", "SELECT * FROM train_event_rows JOIN train_recs USING (rec_date, symbol, is_pick) LEFT JOIN train_ratios USING (symbol, rec_date) LEFT JOIN train_app_rows USING (symbol, rec_date)")
_TRAINED = [*px.EVENT_FEATURES, *fx.FUNDAMENTAL_FACTORS, "app_momentum", "app_risk", "app_total", "app_total_pct", *_FWD]


def training_table(lake: Lake) -> DataFrame:
    """Picks and controls with features, fundamentals, app scores, industry, forward returns and label."""
    bars, idx = lake.bar_table, lake.index_bars
    p = staged(merged(lake).where("action = 'BUY'").select("rec_date", "symbol", "yf_symbol", "team", "is_repeat", "buy_number", "source", "mf_return"), "picks")
    c = ev.sample_controls(p, bars, universe=lake.universe)
    both = staged(p.withColumn("is_pick", F.lit(1)).unionByName(c.withColumn("is_pick", F.lit(0)), allowMissingColumns=True).withColumn("year", F.year("rec_date")), "both")
    out = px.event_features(both, bars, idx, symbol="yf_symbol")
    out = fx.fundamentals_for_pairs(staged(out, "features"), financial_table(lake), bars, lake.splits)
    out = app_scores(lake, staged(out, "fundamentals"), unique=False)
    sic = sic_table(lake)
    out = tx.first_source(out, "yf_symbol", sic.where("own"), sic.where("not own"), "sic")
    out = out.withColumn("sic2", sic_bucket(F.col("sic"), 2)).withColumn("sic3", sic_bucket(F.col("sic"), 3)).drop("sic")
    return ev.beat_label(ev.forward_returns(staged(out, "with_scores"), bars, idx))


@query("M7 U4")
def training_rows(lake: Lake) -> DataFrame:
    return training_table(lake)


@query("M7 U4 values", f"""
SELECT rec_date, symbol, CAST(is_pick AS BIGINT) AS is_pick, {r(_TRAINED)}, round(log10(market_cap), 6) AS log_market_cap, CAST(filing_age_days AS BIGINT) AS filing_age_days, excess_365d > 0 AS beat_spy_365d FROM train_rows
""")
def training_values(lake: Lake) -> DataFrame:
    """Features, ratios, ranking, outcomes and label of every pick and control."""
    t = training_table(lake)
    kept = t.select("rec_date", "symbol", F.col("is_pick").cast("long").alias("is_pick"), *_TRAINED, F.log10("market_cap").alias("log_market_cap"), F.col("filing_age_days").cast("long").alias("filing_age_days"), "beat_spy_365d")
    return rounded(kept)


@query("A27", "SELECT CAST(is_pick AS BIGINT) AS is_pick, count(*) AS n, " + ", ".join(f"round(avg(CAST({c} IS NOT NULL AS INT)), 6) AS has_{c}" for c in ("ret_12m_ex_1m", "pe", "excess_365d")) + " FROM train_rows GROUP BY 1")
def presence_rates(lake: Lake) -> DataFrame:
    """Share of rows with a value, of picks and of controls."""
    t = training_table(lake)
    return rounded(ev.presence(t.withColumn("is_pick", F.col("is_pick").cast("long")), "is_pick", ["ret_12m_ex_1m", "pe", "excess_365d"]))


def sic_table(lake: Lake) -> DataFrame:
    """Industry codes as two sources carry them: text, not always a number."""
    k = F.col("s_suppkey")
    code = F.when(k % 6 == 5, "n/a").otherwise((k * 37 % 9000 + 100).cast("string"))
    base = lake.table("supplier").select(symbol_of(k).alias("symbol"), code.try_cast("double").alias("sic"), k.alias("k"))
    return base.where("k % 3 = 0").select("symbol", "sic", F.lit(True).alias("own")).unionByName(base.where("k % 3 <> 1").select("symbol", (F.col("sic") + 1).alias("sic"), F.lit(False).alias("own")))


@query("J16 P11", """
SELECT symbol, sic, CAST(floor(sic / 100) AS BIGINT) AS sic2, CAST(floor(sic / 10) AS BIGINT) AS sic3 FROM (SELECT 'S' || s_suppkey AS symbol,
 CASE WHEN s_suppkey % 6 = 5 THEN NULL WHEN s_suppkey % 3 = 0 THEN s_suppkey * 37 % 9000 + 100.0::DOUBLE WHEN s_suppkey % 3 = 2 THEN s_suppkey * 37 % 9000 + 101.0::DOUBLE END AS sic FROM supplier)
""")
def industry_codes(lake: Lake) -> DataFrame:
    sic = sic_table(lake)
    out = tx.first_source(lake.universe.select("symbol"), "symbol", sic.where("own"), sic.where("not own"), "sic")
    return out.withColumn("sic2", sic_bucket(F.col("sic"), 2).cast("long")).withColumn("sic3", sic_bucket(F.col("sic"), 3).cast("long"))


@query("P10", """
SELECT rec_date, symbol, round(CASE WHEN market_cap > 0 THEN log10(market_cap) END, 6) AS market_cap, round(CASE WHEN mf_return IS NOT NULL THEN least(greatest(mf_return * 300, -200), 200) END, 6) AS pe FROM merged
""")
def model_inputs(lake: Lake) -> DataFrame:
    m = merged(lake)
    return rounded(m.select("rec_date", "symbol", log_cap(F.col("market_cap")).alias("market_cap"), clipped(F.col("mf_return") * 300, -200.0, 200.0).alias("pe")))


@query("P16", """
SELECT rec_date, symbol, action, CASE WHEN count(*) OVER (PARTITION BY industry) >= 250 THEN industry END AS industry FROM merged JOIN universe USING (symbol)
""")
def frequent_industries(lake: Lake) -> DataFrame:
    m = staged(merged(lake).select("rec_date", "symbol", "action").join(lake.universe.select("symbol", "industry"), "symbol"), "rows")
    return ls.one_hot(m, "industry", ["rec_date", "symbol", "action"], 250)


@query("P17", "SELECT rec_date, symbol, action FROM merged WHERE market_cap IS NOT NULL AND mf_return IS NOT NULL AND risk_rating IS NOT NULL")
def complete_cases(lake: Lake) -> DataFrame:
    return merged(lake).dropna(subset=["market_cap", "mf_return", "risk_rating"]).select("rec_date", "symbol", "action")


@query("A31", """
SELECT yf_symbol, array_to_string(list_concat([yf_symbol], list(alt ORDER BY seen, alt) FILTER (alt <> yf_symbol)), ',') AS candidates FROM (
 SELECT symbol AS yf_symbol, CASE WHEN buy_number % 3 = 0 THEN symbol || '-A' WHEN buy_number % 3 = 1 THEN symbol ELSE symbol || '-B' END AS alt, min(rec_date) AS seen FROM merged WHERE action = 'BUY' AND symbol NOT IN (SELECT symbol FROM bars GROUP BY 1 HAVING sum(volume) > 15000) GROUP BY 1, 2) GROUP BY 1
""")
def alternate_tickers(lake: Lake) -> DataFrame:
    n = F.col("buy_number") % 3
    alt = F.when(n == 0, F.concat("symbol", F.lit(".A"))).when(n == 1, F.col("symbol")).otherwise(F.concat("symbol", F.lit(".B")))
    recs = merged(lake).where("action = 'BUY'").withColumn("ticker_at_rec", alt)
    priced = lake.bars.groupBy("symbol").agg(F.sum("volume").alias("v")).where("v > 15000")
    return px.alternate_tickers(staged(recs, "recs"), priced).select("yf_symbol", F.array_join("candidates", ",").alias("candidates"))


@query("J19", """
WITH reg AS (SELECT c_custkey AS cik, CASE WHEN c_custkey % 50 = 0 THEN 'S' || (c_custkey // 15) END AS ticker, 'supplier ' || (c_custkey // 15) AS name FROM customer WHERE c_custkey % 4 <> 3),
fd AS (SELECT o_custkey AS cik, CAST(o_orderdate AS DATE) AS filed_at, count(*) AS n FROM orders GROUP BY 1, 2),
asked AS (SELECT symbol, max(rec_date) AS known_by FROM merged WHERE action = 'BUY' GROUP BY 1),
live AS (SELECT ticker AS symbol, min(cik) AS cik FROM reg WHERE ticker IS NOT NULL GROUP BY 1),
hits AS (SELECT a.symbol, r.cik, coalesce(sum(f.n) FILTER (f.filed_at <= a.known_by), 0) AS facts FROM asked a JOIN reg r ON r.name = 'supplier ' || substr(a.symbol, 2) LEFT JOIN fd f ON f.cik = r.cik GROUP BY 1, 2)
SELECT symbol, CASE WHEN symbol = 'S7' THEN 70007 ELSE coalesce(l.cik, h.cik) END AS cik, CASE WHEN symbol = 'S7' THEN 'override' WHEN l.cik IS NOT NULL THEN 'ticker' WHEN h.n = 1 THEN 'name' ELSE 'name-best-of-' || h.n END AS match
FROM asked LEFT JOIN live l USING (symbol) LEFT JOIN (SELECT symbol, arg_min(cik, (-facts, cik)) AS cik, count(*) AS n FROM hits GROUP BY 1) h USING (symbol) WHERE symbol = 'S7' OR l.cik IS NOT NULL OR h.cik IS NOT NULL
""")
def company_ids(lake: Lake) -> DataFrame:
    """Customers as registered companies sharing names, their orders as filed facts."""
    k = F.col("c_custkey")
    supplier = F.floor(k / 15).cast("long").cast("string")
    names = F.array(F.concat(F.lit("Supplier "), supplier, F.lit(", Inc.")), F.concat(F.lit("Old & Former "), k.cast("string"), F.lit(" Corp")))
    registry = lake.table("customer").where("c_custkey % 4 <> 3").select(k.alias("cik"), F.when(k % 50 == 0, F.concat(F.lit("S"), supplier)).alias("ticker"), names.alias("names"))
    filed = lake.table("orders").groupBy(F.col("o_custkey").alias("cik"), F.to_date("o_orderdate").alias("filed_at")).agg(F.count(F.lit(1)).alias("n"))
    asked = merged(lake).where("action = 'BUY'").groupBy("symbol").agg(F.max("rec_date").alias("known_by"))
    asked = asked.select("symbol", F.concat(F.lit("SUPPLIER "), F.substring("symbol", 2, 20), F.lit(" Holdings (old) Ltd")).alias("company"), "known_by")
    return tx.resolve_companies(asked, registry, filed, {"S7": 70007})

