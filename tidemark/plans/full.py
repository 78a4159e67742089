"""Rankings, back-tests, lists and training panels on the whole factor panel: five category scores behind the gate of four,
with a model-score column that lacks every second month."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import events as ev, facts as fx, learning as lr, lists as ls, metrics as mt, portfolio as pf, ranks as rk, scoring as sc, spells as sp, walkforward as wf
from tidemark.plans.cte import PRICE, define, percent
from tidemark.plans import learning  # noqa: F401 - the twins read its outcomes
from tidemark.plans.market import factor_panel, forward, month_prices
from tidemark.plans.registry import query, r, rounded
from tidemark.plans.site import ml_scores
from tidemark.plans.standins import Lake
from tidemark.plans.study import merged
from tidemark.staging import staged

FACTORS = PRICE + fx.FUNDAMENTAL_FACTORS
RANKED = ["total", "quality", "momentum", "ml_score"]
_MEMBER = "EXISTS (SELECT 1 FROM spells p WHERE p.symbol = s.symbol AND p.start_d <= s.as_of AND (p.end_d IS NULL OR s.as_of < p.end_d))"

define("full_scores", f"SELECT s.*, ml_score FROM scores s LEFT JOIN ml_rows USING (symbol, as_of) WHERE {' + '.join(f'CAST({c} IS NOT NULL AS INT)' for c in sc.CATEGORIES)} >= {sc.MIN_CATEGORY_SCORES}")


def full_panel(lake: Lake) -> DataFrame:
    return staged(factor_panel(lake).select("symbol", "as_of", *FACTORS), "metrics")


def full_scores(lake: Lake) -> DataFrame:
    return staged(sc.with_model_scores(sc.enough_categories(sc.score(full_panel(lake))), ml_scores(lake)), "scores")


@query("J4 P8 full", f"SELECT symbol, as_of, {r(sc.SCORE_COLUMNS + ['ml_score'])} FROM full_scores")
def full_gated_scores(lake: Lake) -> DataFrame:
    return rounded(full_scores(lake).select("symbol", "as_of", *sc.SCORE_COLUMNS, "ml_score"))


@query("A11 Q9 P8 full", """
SELECT as_of, scored, members, round(scored / members, 6) AS coverage FROM (SELECT as_of, count(DISTINCT symbol) AS scored FROM full_scores GROUP BY as_of)
JOIN (SELECT d.as_of, count(p.symbol) AS members FROM (SELECT DISTINCT as_of FROM month_rows) d JOIN spells p ON p.start_d <= d.as_of AND (p.end_d IS NULL OR d.as_of < p.end_d) GROUP BY 1) USING (as_of)
""")
def full_coverage(lake: Lake) -> DataFrame:
    return rounded(sp.coverage(full_scores(lake), lake.spells))


# --- back-test of several score columns -------------------------------------------------------------
define("full_member_scores", f"SELECT s.* FROM full_scores s WHERE symbol NOT IN (SELECT symbol FROM universe WHERE quote_type <> 'EQUITY' AND quote_type IS NOT NULL) AND {_MEMBER}")
define("full_books", "SELECT name, as_of, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY name, as_of) AS w, dense_rank() OVER (PARTITION BY name ORDER BY as_of) AS i FROM (\n" + "\nUNION ALL ".join(
    f"SELECT * FROM (SELECT 'top10_{c}' AS name, as_of, symbol FROM full_member_scores WHERE {c} IS NOT NULL AND as_of IN (SELECT as_of FROM forward WHERE fwd IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY {c} DESC, symbol) <= 10)" for c in RANKED) + ")")
define("full_strategies", """
SELECT name, as_of, gross - traded * 10 / 1e4 AS ret, traded / 2 AS turnover FROM (SELECT b.name, b.as_of, b.i, avg(f.fwd) AS gross FROM full_books b LEFT JOIN forward f USING (as_of, symbol) GROUP BY 1, 2, 3)
JOIN (SELECT name, i, sum(abs(w - pw)) AS traded FROM (SELECT coalesce(a.name, b.name) AS name, coalesce(a.i, b.i + 1) AS i, coalesce(a.w, 0) AS w, coalesce(b.w, 0) AS pw FROM full_books a FULL JOIN full_books b ON b.name = a.name AND b.symbol = a.symbol AND b.i = a.i - 1) GROUP BY 1, 2) USING (name, i)
""")
define("full_backtest", f"""
SELECT as_of, name, ret FROM (SELECT *, count(*) OVER (PARTITION BY as_of) AS width FROM (SELECT as_of, name, ret FROM full_strategies WHERE ret IS NOT NULL
 UNION ALL SELECT as_of, 'equal_weight_universe', avg(fwd) FROM full_member_scores JOIN forward USING (as_of, symbol) GROUP BY 1 HAVING avg(fwd) IS NOT NULL
 UNION ALL SELECT as_of, symbol, fwd FROM forward WHERE symbol IN ('SPY', 'QQQ') AND fwd IS NOT NULL)) WHERE width = {len(RANKED) + 3}
""")


def full_member_scores(lake: Lake) -> DataFrame:
    return staged(sp.members_only(sp.eligible_lenient(full_scores(lake), lake.universe), lake.spells), "members")


def full_strategies(lake: Lake, scored: DataFrame, fwd: DataFrame) -> dict[str, DataFrame]:
    """A strategy per score column; the model's has dates of its own."""
    return {f"top10_{c}": staged(pf.rebalance(scored, fwd, c, 10, 10.0), "held") for c in RANKED}


def full_backtest(lake: Lake) -> DataFrame:
    scored, fwd = full_member_scores(lake), staged(forward(lake), "forward")
    return staged(pf.backtest_returns(full_strategies(lake, scored, fwd), pf.universe_returns(scored, fwd), fwd), "returns")


@query("Q3 U6 full", "SELECT as_of, name, round(ret, 6) AS ret FROM full_backtest")
def full_backtest_returns(lake: Lake) -> DataFrame:
    """Only dates at which all strategies, those that trade less often too, have a return."""
    return rounded(full_backtest(lake))


@query("A30 full", "SELECT name, round(avg(turnover), 6) AS turnover FROM full_strategies GROUP BY 1")
def full_turnover(lake: Lake) -> DataFrame:
    scored, fwd = full_member_scores(lake), staged(forward(lake), "forward")
    return rounded(pf.average_turnover(full_strategies(lake, scored, fwd)))


@query("A9 W11 Q3 full", """
SELECT name, count(*) AS periods, round(sum(ln(1 + ret)) * 12.0 / count(*), 6) AS log_growth, round(stddev_samp(ret) * sqrt(12), 6) AS volatility, round(min(dd), 6) AS max_drawdown,
 round(avg(ret) * 12 / (stddev_samp(ret) * sqrt(12)), 6) AS sharpe, round(avg(ret) * 12 / (stddev_samp(ret) FILTER (ret < 0) * sqrt(12)), 6) AS sortino, round(avg(CAST(ret > spy AS INT)), 6) AS win_rate
FROM (SELECT *, equity / max(equity) OVER (PARTITION BY name ORDER BY as_of) - 1 AS dd, max(ret) FILTER (name = 'SPY') OVER (PARTITION BY as_of) AS spy
  FROM (SELECT *, product(1 + ret) OVER (PARTITION BY name ORDER BY as_of) AS equity FROM full_backtest)) GROUP BY name
""")
def full_backtest_summary(lake: Lake) -> DataFrame:
    """Growth as a logarithm: few picks of small numbers grow beyond what six decimals hold."""
    return rounded(pf.performance(full_backtest(lake), "SPY").withColumn("cagr", F.log1p("cagr")).withColumnRenamed("cagr", "log_growth"))


# --- lists and index --------------------------------------------------------------------------------
_LISTED = [*sc.SCORE_COLUMNS, "ml_score", "total_change"]
define("full_date_changes", """
SELECT a.*, a.total - b.total AS total_change FROM full_scores a JOIN (SELECT as_of, row_number() OVER (ORDER BY as_of DESC) AS i FROM (SELECT DISTINCT as_of FROM full_scores)) d ON d.as_of = a.as_of AND d.i = 1
LEFT JOIN (SELECT s.* FROM full_scores s JOIN (SELECT as_of, row_number() OVER (ORDER BY as_of DESC) AS i FROM (SELECT DISTINCT as_of FROM full_scores)) d ON d.as_of = s.as_of AND d.i = 4) b ON b.symbol = a.symbol
""")


@query("K3 Q8 full", "\nUNION ALL ".join(
    f"SELECT * FROM (SELECT '{name}' AS list, row_number() OVER (ORDER BY {c} {way}, symbol) AS rank, symbol, round({c}, 6) AS value FROM full_date_changes WHERE {c} IS NOT NULL QUALIFY rank <= 15)"
    for name, c, way in [(c, c, "DESC") for c in _LISTED] + [("total_change_worst", "total_change", "ASC")]))
def full_dashboard_lists(lake: Lake) -> DataFrame:
    out = ls.top_lists(ls.with_date_change(full_scores(lake)), _LISTED)
    return rounded(out.withColumn("rank", F.col("rank").cast("long")))


_INDEX = [*sc.SCORE_COLUMNS, "total_change", "ml_score"]


@query("X11 P18 Q7 full", f"""
SELECT symbol, name, sector, {r(_INDEX, 4)} FROM (SELECT *, total - lag(total, 3) OVER (PARTITION BY symbol ORDER BY as_of) AS total_change, count(*) OVER (PARTITION BY symbol) AS history FROM full_scores
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY as_of DESC) = 1) JOIN equities USING (symbol) WHERE history > 3
""")
def full_index_rows(lake: Lake) -> DataFrame:
    return ls.index_rows(full_scores(lake), lake.universe).select("symbol", "name", "sector", *_INDEX)


# --- training panel ---------------------------------------------------------------------------------
define("full_members", f"SELECT s.* FROM panel s WHERE {_MEMBER}")


def training_panel(lake: Lake) -> DataFrame:
    return lr.training_panel(full_panel(lake), staged(month_prices(lake), "month_prices"), lake.spells)


@query("M1 J6 full", f"SELECT symbol, as_of, {r(FACTORS + ['target'])} FROM (SELECT symbol, as_of, {', '.join(f'{percent(c, True)} AS {c}' for c in FACTORS)} FROM full_members) LEFT JOIN (SELECT symbol, as_of, target FROM outcomes) USING (symbol, as_of)")
def full_training_panel(lake: Lake) -> DataFrame:
    return rounded(training_panel(lake))


@query("M2 Q4 full")
def full_model_scores(lake: Lake) -> DataFrame:
    """Walk-forward predictions from all factors, every fold and tree."""
    return wf.by_date(staged(training_panel(lake), "panel")).predictions


@query("A29 full")
def full_feature_importance(lake: Lake) -> DataFrame:
    return wf.importances(wf.by_date(staged(training_panel(lake), "panel")).fits, FACTORS)


@query("Q4 A12 full")
def full_model_ic(lake: Lake) -> DataFrame:
    p = staged(training_panel(lake), "panel")
    return mt.ic_summary(mt.rank_ic(staged(wf.by_date(p).predictions, "predictions"), p.select("symbol", "as_of", "target")))


# --- picks against controls -------------------------------------------------------------------------
_APP = {**{f"app_{c}": c for c in sc.SCORE_COLUMNS}, "app_total_pct": "total_pct", "app_ml_pct": "ml_pct"}
_MEDIANS = ["app_total_pct", "app_ml_pct", *[f"app_{c}" for c in sc.CATEGORIES]]
define("full_ranked", f"SELECT *, {percent('total', True)} AS total_pct, {percent('ml_score', True)} AS ml_pct FROM full_scores")
define("full_probes", "SELECT symbol, rec_date, 1 AS is_pick FROM pairs UNION ALL SELECT symbol, rec_date, 0 AS is_pick FROM drawn")
define("full_app_rows", f"""
SELECT p.symbol, p.rec_date, p.is_pick, {', '.join(f'CASE WHEN p.rec_date - s.as_of <= 62 THEN s.{c} END AS {a}' for a, c in _APP.items())} FROM full_probes p ASOF LEFT JOIN full_ranked s ON s.symbol = p.symbol AND s.as_of < p.rec_date
""")


def full_app_scores(lake: Lake) -> DataFrame:
    """Our own ranking as it stood at each pick and at each control."""
    p = staged(merged(lake).where("action = 'BUY'").select("rec_date", "symbol", "yf_symbol"), "picks")
    c = ev.sample_controls(p, lake.bar_table, universe=lake.universe)
    probe = lambda d, pick: d.select("symbol", "rec_date").distinct().withColumn("is_pick", F.lit(pick).cast("long"))
    both = staged(probe(p, 1).unionByName(probe(c, 0)), "probes")
    scored = full_scores(lake)
    return staged(sc.attach_scores(both, scored.drop("ml_score"), scored.select("symbol", "as_of", "ml_score")), "ranked")


@query("J8 M6 full", f"SELECT symbol, rec_date, is_pick, {r(list(_APP))} FROM full_app_rows")
def full_scores_at_pick(lake: Lake) -> DataFrame:
    return rounded(full_app_scores(lake).select("symbol", "rec_date", "is_pick", *_APP))


@query("M6 A28 full", f"""
SELECT is_pick, count(*) AS n, round(avg(CAST(app_total_pct >= 0.75 AS INT)), 6) AS share_top_quartile, round(avg(CAST(app_total_pct >= 0.9 AS INT)), 6) AS share_top_decile, {', '.join(f'round(median({c}), 6) AS med_{c}' for c in _MEDIANS)}
FROM full_app_rows WHERE app_total_pct IS NOT NULL GROUP BY 1
""")
def full_rank_position(lake: Lake) -> DataFrame:
    """Where the ranking put picks, against controls of the same dates."""
    return rounded(sc.position_by(full_app_scores(lake), "is_pick", medians=tuple(_MEDIANS)))


_LONG = "\nUNION ALL ".join(f"SELECT '{a}' AS measure, {a} AS value, excess_365d FROM buys JOIN (SELECT * FROM full_app_rows WHERE is_pick = 1) USING (symbol, rec_date)" for a in _APP)


@query("A13 full", f"""
SELECT measure, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM (SELECT measure, rank() OVER (PARTITION BY measure ORDER BY value) + (count(*) OVER (PARTITION BY measure, value) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY measure ORDER BY excess_365d) + (count(*) OVER (PARTITION BY measure, excess_365d) - 1) / 2.0 AS ry
FROM (SELECT * FROM ({_LONG}) WHERE value IS NOT NULL AND excess_365d IS NOT NULL)) GROUP BY 1
""")
def full_outcome_correlation(lake: Lake) -> DataFrame:
    from tidemark.plans.study import buys

    labelled = buys(lake).select("symbol", "rec_date", "excess_365d").where("excess_365d is not null")
    scored = full_scores(lake)
    a = sc.attach_scores(staged(labelled, "labelled"), scored.drop("ml_score"), scored.select("symbol", "as_of", "ml_score"))
    long = staged(rk.unpivot(a, ["symbol", "rec_date", "excess_365d"], list(_APP)).where("value is not null"), "long")
    return rounded(rk.spearman(long, ["measure"], ["symbol", "rec_date"], "value", "excess_365d"))


# --- training table ---------------------------------------------------------------------------------
@query("A27 full", f"SELECT is_pick, count(*) AS n, {', '.join(f'round(avg(CAST({c} IS NOT NULL AS INT)), 6) AS has_{c}' for c in _APP)} FROM full_app_rows GROUP BY 1")
def full_presence_rates(lake: Lake) -> DataFrame:
    """Share of picks and of controls that our ranking knew, by column."""
    return rounded(ev.presence(full_app_scores(lake), "is_pick", list(_APP)))
