"""Cross-sectional scores: percentile ranks within a date, averaged by category."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.scalar import count_present, mean_present
from tidemark.operators.asof import asof_join
from tidemark.operators.ranks import by_measure, percentile_rows, percentiles, quantiles
from tidemark.staging import staged

# fixed values: factor -> True when a higher value is better
CATEGORIES: dict[str, dict[str, bool]] = {
    "quality": {
        "net_margin": True, "gross_margin": True, "operating_margin": True, "fcf_margin": True,
        "roe": True, "roa": True, "debt_to_equity": False, "liabilities_to_assets": False,
    },
    "growth": {"revenue_growth": True, "net_income_growth": True, "eps_growth": True},
    "value": {"pe": False, "ps": False, "pb": False, "fcf_yield": True},
    "momentum": {"ret_3m": True, "ret_6m": True, "ret_12m_ex_1m": True, "sma200_gap": True},
    "risk": {"vol_60d": False, "drawdown_252d": True},
}
SCORE_COLUMNS = [*CATEGORIES, "total"]
MIN_CATEGORY_SCORES = 4


def score(metrics: DataFrame) -> DataFrame:
    """(symbol, as_of) -> five category scores (0-100) and their mean. Factors that `metrics` lacks, and
    NULL factors, are left out of the averages; a row without any factor keeps NULL scores."""
    measures = {f: up for fs in CATEGORIES.values() for f, up in fs.items() if f in metrics.columns}
    ranked = percentile_rows(metrics, ["symbol"], ["as_of"], measures)
    # a marker row per (symbol, as_of) keeps rows without ranks, inside the same aggregation
    marks = metrics.select("symbol", "as_of", F.lit(None).cast("int").alias("m"), F.lit(None).cast("double").alias("pct"))
    # one column per factor, then averages in a fixed order: equal inputs give bit-equal scores, so ties stay ties
    wide = by_measure(ranked.unionByName(marks), ["symbol", "as_of"], list(measures))
    means = [mean_present([F.col(f) for f in fs if f in measures]) * 100 if set(fs) & set(measures) else F.lit(None).cast("double") for fs in CATEGORIES.values()]
    out = wide.select("symbol", "as_of", *[m.alias(c) for m, c in zip(means, CATEGORIES)])
    return out.withColumn("total", mean_present([F.col(c) for c in CATEGORIES]))


def enough_categories(scores: DataFrame, at_least: int = MIN_CATEGORY_SCORES) -> DataFrame:
    return scores.where(count_present([F.col(c) for c in CATEGORIES]) >= at_least)


def with_model_scores(scores: DataFrame, ml_scores: DataFrame) -> DataFrame:
    return scores.join(ml_scores, ["symbol", "as_of"], "left")


APP_COLUMNS = [*[f"app_{c}" for c in SCORE_COLUMNS], "app_total_pct", "app_ml_pct"]


def attach_scores(probes: DataFrame, scores: DataFrame, ml_scores: DataFrame | None = None, *, date: str = "rec_date", tolerance_days: int = 62, unique: bool = False) -> DataFrame:
    """`probes` plus our own ranking as of the last score date strictly before `date`, at most 62 days old:
    category scores, total, and the percentiles of total and model score within that date's universe."""
    table = with_model_scores(scores, ml_scores) if ml_scores is not None else scores.withColumn("ml_score", F.lit(None).cast("double"))
    table = staged(table.select("symbol", "as_of", *SCORE_COLUMNS, "ml_score"), "scores")
    pct = percentiles(table, ["symbol"], ["as_of"], {"total": True, "ml_score": True}, "_pct")
    full = table.join(pct, ["symbol", "as_of"], "left").select(
        "symbol", "as_of", *[F.col(c).alias(f"app_{c}") for c in SCORE_COLUMNS], F.col("total_pct").alias("app_total_pct"), F.col("ml_score_pct").alias("app_ml_pct"))
    return asof_join(probes, full, ["symbol"], date, "as_of", APP_COLUMNS, strict=True, tolerance_days=tolerance_days, unique_left=unique)


def position_by(df: DataFrame, by: str, pct: str = "app_total_pct", medians: tuple[str, ...] = ("app_total_pct",)) -> DataFrame:
    """Where the ranking put the rows of each class: medians and shares in its top quartile and decile."""
    known = df.where(F.col(pct).isNotNull())
    out = known.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(pct) >= 0.75).cast("double")).alias("share_top_quartile"), F.avg((F.col(pct) >= 0.9).cast("double")).alias("share_top_decile"))
    for m in medians:
        out = out.join(quantiles(known, [by], m, {f"med_{m}": 0.5}), by, "left")
    return out


def outcome_by_half(df: DataFrame, pct: str = "app_total_pct", outcome: str = "excess_365d") -> DataFrame:
    """Median outcome of the upper and the lower half of the ranking."""
    known = df.where(F.col(pct).isNotNull() & F.col(outcome).isNotNull()).withColumn("half", F.when(F.col(pct) >= 0.5, "top").otherwise("bottom"))
    return known.groupBy("half").agg(F.count(F.lit(1)).alias("n")).join(quantiles(known, ["half"], outcome, {"median": 0.5}), "half")
