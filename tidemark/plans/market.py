"""Bars, factors, scores, portfolios."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import facts as fx, portfolio as pf, prices as px, scoring as sc, spells as sp
from tidemark.plans.cte import PRICE, define, score_sql
from tidemark.plans.registry import query, r, rounded
from tidemark.plans.standins import REGION_FUNDS, Lake
from tidemark.staging import staged


def price_panel(lake: Lake) -> DataFrame:
    return px.month_ends(px.price_factors(lake.bar_table), "calendar").select("symbol", "as_of", "close", *PRICE)


def price_scores(lake: Lake) -> DataFrame:
    return sc.score(staged(price_panel(lake), "metrics"))


def month_prices(lake: Lake) -> DataFrame:
    """Month-end prices of symbols, index and funds."""
    cols = ["symbol", "date", "adj_close"]
    every = lake.bar_table.select(*cols).unionByName(lake.index_bars.select(*cols)).unionByName(lake.fund_bars.select(*cols))
    return every.groupBy("symbol", F.last_day("date").alias("as_of")).agg(F.max_by("adj_close", "date").alias("adj_close"))


define("price_scores", score_sql("month_rows", sc.CATEGORIES, PRICE))


@query("S13 W1 W6 W7 first slice", f"""
SELECT symbol, as_of, round(ret_1m, 6) AS ret_1m, round(vol_60d, 6) AS vol_60d, round(rank_pct, 6) AS rank_pct FROM (
SELECT symbol, as_of, ret_1m, vol_60d, CASE WHEN ret_1m IS NOT NULL THEN (rank() OVER (PARTITION BY as_of, (ret_1m IS NULL) ORDER BY ret_1m) + (count(*) OVER (PARTITION BY as_of, ret_1m) - 1) / 2.0::DOUBLE) / count(ret_1m) OVER (PARTITION BY as_of) END AS rank_pct FROM month_rows)
""")
def momentum_ranks(lake: Lake) -> DataFrame:
    """Bars -> month-end momentum and volatility -> percentile rank within the month."""
    from tidemark.operators.ranks import percentiles

    factors = px.price_factors(lake.bars).select("symbol", "date", "ret_1m", "vol_60d")
    panel = staged(px.month_ends(factors, "calendar").drop("date"), "metrics")
    ranks = percentiles(panel, ["symbol"], ["as_of"], {"ret_1m": True}, "").withColumnRenamed("ret_1m", "rank_pct")
    return rounded(panel.join(ranks, ["symbol", "as_of"], "left"))


@query("S13 daily bars", f"SELECT symbol, date, {r('open high low close adj_close', 10)}, volume FROM bars")
def daily_bars(lake: Lake) -> DataFrame:
    return rounded(px.normalise_daily(lake.bars), 10)


@query("W1-W5", f"SELECT symbol, date, close, {r(PRICE)} FROM daily_factors")
def price_factors(lake: Lake) -> DataFrame:
    return rounded(px.price_factors(lake.bars), keep=("close",))


@query("W6", "SELECT symbol, as_of, date, round(close, 8) AS close FROM month_rows")
def month_end_rows(lake: Lake) -> DataFrame:
    return rounded(px.month_ends(lake.bars.select("symbol", "date", "close"), "calendar"), 8)


@query("W7 W8 price categories", f"SELECT symbol, as_of, {r(sc.SCORE_COLUMNS)} FROM price_scores")
def price_only_scores(lake: Lake) -> DataFrame:
    return rounded(price_scores(lake))


@query("J13 raw close", """
SELECT symbol, date, round(close * coalesce((SELECT product(ratio) FROM split_table s WHERE s.symbol = b.symbol AND s.date > b.date), 1), 8) AS raw_close FROM bars b
""")
def raw_close(lake: Lake) -> DataFrame:
    return rounded(px.with_raw_close(lake.bars, lake.splits).select("symbol", "date", "raw_close"), 8)


@query("W22 back-adjust", """
SELECT symbol, date, split_factor, round(close / coalesce(product(split_factor) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1), 8) AS close_adjusted
FROM (SELECT symbol, date, close, CASE WHEN date_trunc('month', date) > date_trunc('month', lag(date) OVER (PARTITION BY symbol ORDER BY date)) AND month(date) = 6 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS split_factor FROM bars)
""")
def split_back_adjust(lake: Lake) -> DataFrame:
    """A split on the first June bar of every symbol and year, undone on the earlier prices."""
    prev = F.lag("date").over(px._by_symbol())
    june = (F.month("date") == 6) & (F.trunc("date", "MM") > F.trunc(prev, "MM"))
    raw = lake.bars.select("symbol", "date", "close", F.when(june, 1.5).otherwise(1.0).alias("split_factor"))
    return rounded(px.back_adjust(raw).select("symbol", "date", "split_factor", "close_adjusted"), 8)


# --- membership ------------------------------------------------------------------------------------
define("member_rows", """
SELECT m.* FROM month_rows m WHERE EXISTS (SELECT 1 FROM spells s WHERE s.symbol = m.symbol AND s.start_d <= m.as_of AND (s.end_d IS NULL OR m.as_of < s.end_d))
""")


@query("J1", "SELECT symbol, as_of, round(close, 8) AS close FROM member_rows")
def members_only(lake: Lake) -> DataFrame:
    return rounded(sp.members_only(price_panel(lake), lake.spells).select("symbol", "as_of", "close"), 8)


@query("J2", """
SELECT as_of, CAST(count(s.symbol) AS BIGINT) AS members FROM (SELECT DISTINCT as_of FROM month_rows) d
LEFT JOIN spells s ON s.start_d <= as_of AND (s.end_d IS NULL OR as_of < s.end_d) GROUP BY as_of
""")
def member_counts(lake: Lake) -> DataFrame:
    return sp.member_counts(lake.bars.select(F.last_day("date").alias("as_of")).distinct(), lake.spells)


define("coverage_rows", """
SELECT as_of, scored, members, scored / members AS coverage FROM
  (SELECT as_of, count(DISTINCT symbol) AS scored FROM price_scores WHERE CAST(momentum IS NOT NULL AS INT) + CAST(risk IS NOT NULL AS INT) >= 2 GROUP BY as_of)
  JOIN (SELECT d.as_of, count(s.symbol) AS members FROM (SELECT DISTINCT as_of FROM month_rows) d JOIN spells s ON s.start_d <= d.as_of AND (s.end_d IS NULL OR d.as_of < s.end_d) GROUP BY 1) USING (as_of)
""")


def gated_scores(lake: Lake) -> DataFrame:
    return sc.enough_categories(price_scores(lake), 2)


@query("A11 Q9 P8", "SELECT as_of, scored, members, round(coverage, 6) AS coverage FROM coverage_rows")
def score_coverage(lake: Lake) -> DataFrame:
    return rounded(sp.coverage(gated_scores(lake), lake.spells))


@query("A11 summary", """
SELECT round(avg(coverage), 6) AS mean_coverage, round(min(coverage), 6) AS min_coverage, first(as_of ORDER BY coverage, as_of) AS min_as_of, round(arg_max(coverage, as_of), 6) AS latest_coverage FROM coverage_rows
""")
def score_coverage_summary(lake: Lake) -> DataFrame:
    return rounded(sp.coverage_summary(sp.coverage(gated_scores(lake), lake.spells)))


_KNOWN = "(SELECT symbol FROM bars GROUP BY symbol HAVING max(date) >= DATE '2001-06-01' AND sum(volume) > 14500)"


def known_symbols(lake: Lake) -> DataFrame:
    """Symbols the lake still collects: recent bars and enough volume."""
    return lake.bars.groupBy("symbol").agg(F.max("date").alias("last"), F.sum("volume").alias("v")).where("last >= date'2001-06-01' and v > 14500").select("symbol")


@query("U1 Q9", f"SELECT DISTINCT symbol FROM spells WHERE end_d >= DATE '1998-01-01' AND symbol NOT IN {_KNOWN}")
def removed_members(lake: Lake) -> DataFrame:
    return sp.removed_members(lake.spells, known_symbols(lake), 1998)


@query("U2", f"SELECT symbol FROM {_KNOWN} UNION SELECT symbol FROM spells WHERE end_d >= DATE '1998-01-01'")
def tracked_symbols(lake: Lake) -> DataFrame:
    return sp.tracked_symbols(lake.spells, known_symbols(lake), 1998)


@query("P2", "SELECT symbol, as_of FROM month_rows WHERE symbol NOT IN (SELECT symbol FROM universe WHERE quote_type IS NOT NULL AND quote_type <> 'EQUITY')")
def eligible_lenient(lake: Lake) -> DataFrame:
    return sp.eligible_lenient(price_panel(lake), lake.universe).select("symbol", "as_of")


@query("P3 U3", "SELECT symbol, as_of FROM month_rows WHERE symbol IN (SELECT symbol FROM universe WHERE quote_type = 'EQUITY')")
def eligible_strict(lake: Lake) -> DataFrame:
    return sp.eligible_strict(price_panel(lake), lake.universe).select("symbol", "as_of")


# --- fundamentals ----------------------------------------------------------------------------------
@query("S7 P4 P5", """
SELECT symbol, accession_no, concept, period_type, round(value, 4) AS value FROM (SELECT *, CASE WHEN form LIKE '10-K%' THEN 'FY' ELSE 'Q' END AS period_type FROM facts)
WHERE concept <> 'Goodwill' AND unit <> 'EUR' AND (period_start IS NULL OR CASE WHEN period_type = 'Q' THEN period_end - period_start BETWEEN 80 AND 100 ELSE period_end - period_start BETWEEN 350 AND 380 END)
""")
def statement_facts(lake: Lake) -> DataFrame:
    lake_part, extra = lake.facts.where("source_rank = 0"), lake.facts.where("source_rank = 1")
    out = fx.statement_facts(fx.union_facts(lake_part, extra))
    return rounded(out.select("symbol", "accession_no", "concept", "period_type", "value"), 4)


define("derived", """
SELECT symbol, concept, value - prior_value AS value, unit, CAST(prior_end + 1 AS DATE) AS period_start, period_end, CASE WHEN form LIKE '%/A' THEN '10-Q/A' ELSE '10-Q' END AS form, filed_at, accession_no, 2 AS source_rank
FROM (SELECT c.*, p.value AS prior_value, p.period_end AS prior_end,
    row_number() OVER (PARTITION BY c.symbol, c.concept, c.unit, c.period_start, c.period_end, c.accession_no, p.period_end ORDER BY p.filed_at, p.accession_no) AS rn
  FROM facts c JOIN facts p ON p.symbol = c.symbol AND p.concept = c.concept AND p.unit = c.unit AND p.period_start = c.period_start
  WHERE c.period_end - c.period_start BETWEEN 170 AND 380 AND c.period_end - p.period_end BETWEEN 80 AND 100) WHERE rn = 1
""")


@query("J3", "SELECT symbol, concept, round(value, 4) AS value, unit, period_start, period_end, form, filed_at, accession_no FROM derived")
def derived_quarters(lake: Lake) -> DataFrame:
    return rounded(fx.derive_quarters(lake.facts).drop("source_rank"), 4)


_RANKS = ", ".join(f"('{c}', '{col}', {i})" for i, (c, col) in enumerate(fx.CONCEPT_COLUMNS.items()))
define("financials", f"""
SELECT symbol, period, period_type, accn, form, filed, {", ".join(f"max(value) FILTER (col = '{c}') AS {c}" for c in fx.STATEMENT_COLUMNS)},
  max(value) FILTER (col = 'operating_cf') - abs(max(value) FILTER (col = 'capex')) AS free_cash_flow
FROM (SELECT symbol, period_end AS period, period_type, accession_no AS accn, form, filed_at AS filed, col, value,
    row_number() OVER (PARTITION BY symbol, period_end, period_type, accession_no, form, filed_at, col ORDER BY rk, source_rank) AS rn
  FROM (SELECT *, CASE WHEN form LIKE '10-K%' THEN 'FY' ELSE 'Q' END AS period_type FROM (SELECT symbol, concept, value, unit, period_start, period_end, form, filed_at, accession_no, source_rank FROM facts
      UNION ALL SELECT symbol, concept, value, unit, period_start, period_end, form, filed_at, accession_no, source_rank FROM derived))
  JOIN (SELECT * FROM (VALUES {_RANKS}) v(concept, col, rk)) USING (concept)
  WHERE unit IN ('USD', 'USD/shares', 'shares') AND (period_start IS NULL OR CASE WHEN period_type = 'Q' THEN period_end - period_start BETWEEN 80 AND 100 ELSE period_end - period_start BETWEEN 350 AND 380 END))
WHERE rn = 1 GROUP BY 1, 2, 3, 4, 5, 6
""")


@query("A1 P4 P5 J3 S7", f"SELECT symbol, period, period_type, accn, form, filed, {r(fx.STATEMENT_COLUMNS + ['free_cash_flow'], 4)} FROM financials")
def financials(lake: Lake) -> DataFrame:
    return rounded(fx.build_financials(staged(lake.facts, "facts")), 4)


# naive form: for every probe date, everything filed before it
define("panel_probes", """
SELECT symbol, as_of, close * coalesce((SELECT product(ratio) FROM split_table s WHERE s.symbol = m.symbol AND s.date > m.date), 1) AS price FROM month_rows m
""")
define("known_rows", "SELECT p.symbol, p.as_of, f.* EXCLUDE (symbol) FROM panel_probes p JOIN financials f ON f.symbol = p.symbol AND f.filed < p.as_of")
_ALLC = fx.STATEMENT_COLUMNS + ["free_cash_flow"]
define("known_periods", f"""
SELECT symbol, as_of, period_type, period, max(filed) AS filed, {", ".join(f"last({c} ORDER BY filed, accn) FILTER ({c} IS NOT NULL) AS {c}" for c in _ALLC)} FROM known_rows GROUP BY 1, 2, 3, 4
""")
define("ttm_rows", """
SELECT symbol, as_of, """ + ", ".join(f"CASE WHEN count(*) = 4 AND max(period) - min(period) BETWEEN 250 AND 290 AND count({c}) = 4 THEN sum({c}) END AS ttm_{c}" for c in fx.TTM_COLUMNS) + """
FROM (SELECT *, row_number() OVER (PARTITION BY symbol, as_of ORDER BY period DESC) AS rn FROM known_periods WHERE period_type = 'Q') WHERE rn <= 4 GROUP BY 1, 2
""")
define("fy_rows", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, as_of ORDER BY period DESC) AS rn FROM known_periods WHERE period_type = 'FY') WHERE rn = 1")
define("fy_prior_rows", """
SELECT symbol, as_of, arg_max(struct_pack(revenue := p.revenue, net_income := p.net_income, eps := p.eps), p.period) AS v
FROM known_periods p JOIN (SELECT symbol, as_of, period AS cur FROM fy_rows) c USING (symbol, as_of) WHERE p.period_type = 'FY' AND cur - p.period BETWEEN 350 AND 380 GROUP BY 1, 2
""")
define("balance_rows", "SELECT symbol, as_of, max(filed) AS known_filed, " + ", ".join(f"last({c} ORDER BY period, filed, accn) FILTER ({c} IS NOT NULL) AS b_{c}" for c in fx.BALANCE_COLUMNS) + " FROM known_rows GROUP BY 1, 2")
_RATIO_SQL = """
ttm_gross_profit / nullif(ttm_revenue, 0) AS gross_margin, ttm_operating_income / nullif(ttm_revenue, 0) AS operating_margin, ttm_free_cash_flow / nullif(ttm_revenue, 0) AS fcf_margin,
ttm_free_cash_flow / nullif(price * b_shares, 0) AS fcf_yield, f.net_income / nullif(f.revenue, 0) AS net_margin, CASE WHEN f.equity > 0 THEN f.net_income / f.equity END AS roe, f.net_income / nullif(f.assets, 0) AS roa,
(f.revenue - v.revenue) / nullif(abs(v.revenue), 0) AS revenue_growth, (f.net_income - v.net_income) / nullif(abs(v.net_income), 0) AS net_income_growth, (f.eps - v.eps) / nullif(abs(v.eps), 0) AS eps_growth,
CASE WHEN f.eps > 0 THEN price / f.eps END AS pe, price * b_shares / nullif(f.revenue, 0) AS ps, CASE WHEN f.symbol IS NOT NULL AND b_equity > 0 THEN price * b_shares / b_equity END AS pb,
CASE WHEN b_equity > 0 THEN b_debt / b_equity END AS debt_to_equity, b_liabilities / nullif(b_assets, 0) AS liabilities_to_assets
"""
_RATIO_JOINS = "LEFT JOIN ttm_rows t USING (symbol, as_of) LEFT JOIN fy_rows f USING (symbol, as_of) LEFT JOIN fy_prior_rows USING (symbol, as_of) LEFT JOIN balance_rows USING (symbol, as_of)"
define("panel", f"""
SELECT p.symbol, p.as_of, {", ".join("m." + c for c in PRICE)}, {_RATIO_SQL} FROM panel_probes p JOIN month_rows m USING (symbol, as_of) {_RATIO_JOINS}
""")
define("scores", score_sql("panel", sc.CATEGORIES, PRICE + fx.FUNDAMENTAL_FACTORS))


def factor_panel(lake: Lake) -> DataFrame:
    return fx.factor_panel(lake.bars, financial_table(lake), lake.splits, as_of="calendar")


def financial_table(lake: Lake) -> DataFrame:
    return staged(fx.build_financials(staged(lake.facts, "facts")), "financials")


@query("Q1 A2-A6 J9 P6 P7", f"SELECT symbol, as_of, {r(PRICE + fx.FUNDAMENTAL_FACTORS)} FROM panel", name="factor_panel")
def factor_panel_query(lake: Lake) -> DataFrame:
    return rounded(factor_panel(lake))


@query("Q2 W7 W8", f"SELECT symbol, as_of, {r(sc.SCORE_COLUMNS)} FROM scores")
def scores(lake: Lake) -> DataFrame:
    return rounded(sc.score(staged(factor_panel(lake), "metrics")))


# --- portfolios ------------------------------------------------------------------------------------
define("grid", "SELECT as_of, lead(as_of) OVER (ORDER BY as_of) AS exit1, lead(as_of, 12) OVER (ORDER BY as_of) AS exit12 FROM (SELECT DISTINCT as_of FROM month_rows)")
define("forward", """
SELECT g.as_of, a.symbol, b.adj_close / a.adj_close - 1 AS fwd, c.adj_close / a.adj_close - 1 AS fwd12 FROM grid g JOIN month_prices a ON a.as_of = g.as_of
LEFT JOIN month_prices b ON b.symbol = a.symbol AND b.as_of = g.exit1 LEFT JOIN month_prices c ON c.symbol = a.symbol AND c.as_of = g.exit12
""")


def forward(lake: Lake, horizon: int = 1) -> DataFrame:
    prices = staged(month_prices(lake), "month_prices")
    return pf.forward_returns(prices, prices, horizon)


@query("W10 J14", "SELECT as_of, symbol, round(fwd, 6) AS fwd FROM forward")
def forward_grid(lake: Lake) -> DataFrame:
    return rounded(forward(lake))


@query("W10 12 steps", "SELECT as_of, symbol, round(fwd12, 6) AS fwd FROM forward")
def forward_grid_year(lake: Lake) -> DataFrame:
    return rounded(forward(lake, 12))


@query("P12", "SELECT symbol, CASE sector WHEN 'AFRICA' THEN 'XAF' WHEN 'AMERICA' THEN 'XAM' WHEN 'ASIA' THEN 'XAS' WHEN 'EUROPE' THEN 'XEU' WHEN 'MIDDLE EAST' THEN 'XME' ELSE 'SPY' END AS benchmark FROM universe")
def sector_benchmark(lake: Lake) -> DataFrame:
    return pf.sector_benchmark(lake.universe, REGION_FUNDS)


def member_scores(lake: Lake) -> DataFrame:
    """Scores that pass the category gate, of eligible symbols that were members on the day."""
    return sp.members_only(sp.eligible_lenient(gated_scores(lake), lake.universe), lake.spells)


define("member_scores", """
SELECT s.* FROM price_scores s WHERE momentum IS NOT NULL AND risk IS NOT NULL AND symbol NOT IN (SELECT symbol FROM universe WHERE quote_type <> 'EQUITY' AND quote_type IS NOT NULL)
AND EXISTS (SELECT 1 FROM spells p WHERE p.symbol = s.symbol AND p.start_d <= s.as_of AND (p.end_d IS NULL OR s.as_of < p.end_d))
""")
define("picks", """
SELECT * FROM (SELECT as_of, symbol, row_number() OVER (PARTITION BY as_of ORDER BY total DESC, symbol) AS pick FROM member_scores WHERE total IS NOT NULL)
WHERE pick <= 10 AND as_of IN (SELECT as_of FROM forward WHERE fwd IS NOT NULL)
""")
define("books", "SELECT as_of, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY as_of) AS w, dense_rank() OVER (ORDER BY as_of) AS i FROM picks")
define("momentum_books", """
SELECT as_of, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY as_of) AS w, dense_rank() OVER (ORDER BY as_of) AS i FROM (
 SELECT as_of, symbol, row_number() OVER (PARTITION BY as_of ORDER BY momentum DESC, symbol) AS pick FROM member_scores WHERE momentum IS NOT NULL)
WHERE pick <= 10 AND as_of IN (SELECT as_of FROM forward WHERE fwd IS NOT NULL)
""")
define("strategy_rows", """
SELECT as_of, gross - traded * 10 / 1e4 AS strategy, traded / 2 AS turnover, sector_benchmark FROM
 (SELECT b.as_of, b.i, avg(f.fwd) AS gross, avg(e.fwd) AS sector_benchmark FROM books b LEFT JOIN forward f USING (as_of, symbol)
  LEFT JOIN universe u ON u.symbol = b.symbol LEFT JOIN forward e ON e.as_of = b.as_of AND e.symbol = CASE u.sector WHEN 'AFRICA' THEN 'XAF' WHEN 'AMERICA' THEN 'XAM' WHEN 'ASIA' THEN 'XAS' WHEN 'EUROPE' THEN 'XEU' WHEN 'MIDDLE EAST' THEN 'XME' ELSE 'SPY' END
  GROUP BY 1, 2)
 JOIN (SELECT i, sum(abs(w - pw)) AS traded FROM (SELECT coalesce(a.i, b.i + 1) AS i, coalesce(a.w, 0) AS w, coalesce(b.w, 0) AS pw FROM books a FULL JOIN books b ON b.symbol = a.symbol AND b.i = a.i - 1) GROUP BY 1) USING (i)
""")


def strategy(lake: Lake) -> DataFrame:
    return pf.rebalance(member_scores(lake), staged(forward(lake), "forward"), "total", 10, 10.0, pf.sector_benchmark(lake.universe, REGION_FUNDS))


@query("K1", "SELECT as_of, symbol, pick FROM picks")
def monthly_picks(lake: Lake) -> DataFrame:
    live = forward(lake).where("fwd is not null").select("as_of").distinct()
    return pf.top_n(member_scores(lake), "total", 10).join(live, "as_of", "left_semi").select("as_of", "symbol", F.col("pick").cast("long").alias("pick"))


@query("W23 J15 A30", f"SELECT as_of, {r('strategy turnover sector_benchmark')} FROM strategy_rows")
def rebalance(lake: Lake) -> DataFrame:
    return rounded(strategy(lake))


@query("A30", """
SELECT 'top10_total' AS name, round(avg(turnover), 6) AS turnover FROM strategy_rows
UNION ALL SELECT 'top10_momentum', round(avg(traded) / 2, 6) FROM (
 SELECT i, sum(abs(w - pw)) AS traded FROM (SELECT coalesce(a.i, b.i + 1) AS i, coalesce(a.w, 0) AS w, coalesce(b.w, 0) AS pw FROM momentum_books a FULL JOIN momentum_books b ON b.symbol = a.symbol AND b.i = a.i - 1)
 WHERE i <= (SELECT max(i) FROM momentum_books) GROUP BY i)
""")
def strategy_turnover(lake: Lake) -> DataFrame:
    fwd, scored = staged(forward(lake), "forward"), staged(member_scores(lake), "scores")
    held = {f"top10_{c}": staged(pf.rebalance(scored, fwd, c, 10, 10.0), "held") for c in ("total", "momentum")}
    return rounded(pf.average_turnover(held))


@query("A10", "SELECT as_of, round(avg(fwd), 6) AS universe FROM member_scores LEFT JOIN forward USING (as_of, symbol) GROUP BY as_of")
def universe_return(lake: Lake) -> DataFrame:
    return rounded(pf.universe_returns(member_scores(lake), forward(lake)))


define("backtest_long", """
SELECT as_of, name, ret FROM (SELECT *, count(*) OVER (PARTITION BY as_of) AS width FROM (
 SELECT as_of, 'top10_total' AS name, strategy AS ret FROM strategy_rows WHERE strategy IS NOT NULL
 UNION ALL SELECT as_of, 'top10_total_sector_matched', sector_benchmark FROM strategy_rows WHERE sector_benchmark IS NOT NULL
 UNION ALL SELECT as_of, 'equal_weight_universe', avg(fwd) FROM member_scores JOIN forward USING (as_of, symbol) GROUP BY 1 HAVING avg(fwd) IS NOT NULL
 UNION ALL SELECT as_of, symbol, fwd FROM forward WHERE symbol IN ('SPY', 'QQQ') AND fwd IS NOT NULL)) WHERE width = 5
""")


def backtest(lake: Lake) -> DataFrame:
    fwd, scored = staged(forward(lake), "forward"), staged(member_scores(lake), "scores")
    held = pf.rebalance(scored, fwd, "total", 10, 10.0, pf.sector_benchmark(lake.universe, REGION_FUNDS))
    return staged(pf.backtest_returns({"top10_total": staged(held, "held")}, pf.universe_returns(scored, fwd), fwd), "returns")


@query("Q3 U6 returns", "SELECT as_of, name, round(ret, 6) AS ret FROM backtest_long")
def backtest_returns(lake: Lake) -> DataFrame:
    return rounded(backtest(lake))


@query("W11", """
SELECT as_of, name, round(ln(equity), 6) AS log_equity, round(equity / max(equity) OVER (PARTITION BY name ORDER BY as_of) - 1, 6) AS drawdown
FROM (SELECT *, product(1 + ret) OVER (PARTITION BY name ORDER BY as_of) AS equity FROM backtest_long)
""")
def equity_curves(lake: Lake) -> DataFrame:
    return rounded(pf.equity_curve(backtest(lake), ["name"]).select("as_of", "name", F.log("equity").alias("log_equity"), "drawdown"))


@query("A9 W11 Q3 summary", """
SELECT name, count(*) AS periods, round(product(1 + ret) ** (12.0 / count(*)) - 1, 6) AS cagr, round(stddev_samp(ret) * sqrt(12), 6) AS volatility, round(min(dd), 6) AS max_drawdown,
 round(avg(ret) * 12 / (stddev_samp(ret) * sqrt(12)), 6) AS sharpe, round(avg(ret) * 12 / (stddev_samp(ret) FILTER (ret < 0) * sqrt(12)), 6) AS sortino, round(avg(CAST(ret > spy AS INT)), 6) AS win_rate
FROM (SELECT *, equity / max(equity) OVER (PARTITION BY name ORDER BY as_of) - 1 AS dd, max(ret) FILTER (name = 'SPY') OVER (PARTITION BY as_of) AS spy
  FROM (SELECT *, product(1 + ret) OVER (PARTITION BY name ORDER BY as_of) AS equity FROM backtest_long)) GROUP BY name
""")
def backtest_summary(lake: Lake) -> DataFrame:
    return rounded(pf.performance(backtest(lake), "SPY"))
