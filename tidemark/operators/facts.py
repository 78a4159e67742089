"""Long company facts -> point-in-time statements -> ratios known strictly before a date."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalar import growth, lookup, positive_ratio, ratio
from tidemark.operators.asof import asof_join
from tidemark.operators.prices import raw_close_at

# fixed values: reported concept -> statement column; the order is the precedence within a filing
CONCEPT_COLUMNS = {
    "Revenues": "revenue",
    "RevenueFromContractWithCustomerExcludingAssessedTax": "revenue",
    "GrossProfit": "gross_profit",
    "OperatingIncomeLoss": "operating_income",
    "NetIncomeLoss": "net_income",
    "EarningsPerShareDiluted": "eps",
    "Assets": "assets",
    "Liabilities": "liabilities",
    "CashAndCashEquivalentsAtCarryingValue": "cash",
    "StockholdersEquity": "equity",
    "NetCashProvidedByUsedInOperatingActivities": "operating_cf",
    "PaymentsForCapitalExpenditures": "capex",
    "PaymentsToAcquirePropertyPlantAndEquipment": "capex",
    "PaymentsToAcquireProductiveAssets": "capex",
    "CommonStockSharesOutstanding": "shares",
    "LongTermDebt": "debt",
    "LongTermDebtNoncurrent": "debt",
}
# fixed values: form -> period type, allowed units, day ranges
PERIOD_TYPE = {"10-K": "FY", "10-K/A": "FY", "10-Q": "Q", "10-Q/A": "Q"}
UNITS = ["USD", "USD/shares", "shares"]
QUARTER_DAYS, YEAR_DAYS = (80, 100), (350, 380)
CUMULATIVE_DAYS, STEP_DAYS = (170, 380), (80, 100)
TTM_SPAN_DAYS = (250, 290)

STATEMENT_COLUMNS = list(dict.fromkeys(CONCEPT_COLUMNS.values()))
BALANCE_COLUMNS = ["assets", "liabilities", "cash", "debt", "equity", "shares"]
TTM_COLUMNS = ["revenue", "gross_profit", "operating_income", "free_cash_flow"]
ANNUAL_COLUMNS = ["revenue", "net_income", "equity", "assets", "eps"]
FUNDAMENTAL_FACTORS = [
    "gross_margin", "operating_margin", "fcf_margin", "fcf_yield", "net_margin", "roe", "roa", "revenue_growth",
    "net_income_growth", "eps_growth", "pe", "ps", "pb", "debt_to_equity", "liabilities_to_assets",
]
FACT_COLUMNS = ["symbol", "concept", "value", "unit", "period_start", "period_end", "form", "filed_at", "accession_no"]


def union_facts(lake: DataFrame, extra: DataFrame) -> DataFrame:
    """Both fact sources; `source_rank` keeps the precedence that row order would have given."""
    return lake.select(*FACT_COLUMNS, F.lit(0).alias("source_rank")).unionByName(extra.select(*FACT_COLUMNS, F.lit(1).alias("source_rank")))


def derive_quarters(facts: DataFrame, no_lookahead: bool = False) -> DataFrame:
    """Discrete quarters from cumulative facts: 6M - 3M, 9M - 6M, FY - 9M of one fiscal year.

    The result takes the filing of the cumulative value. `no_lookahead` also demands that the earlier
    value was filed by then. A window's key (symbol, concept, unit, start) holds one fiscal year's reports.
    """
    rank = [c for c in ("source_rank",) if c in facts.columns]
    # one shuffle: sorted by a number first, so that comparing texts is left to the rows of one year
    key = ["_year", "symbol", "concept", "unit", "period_start"]
    flows = facts.where("period_start is not null and period_end is not null and symbol is not null and concept is not null and unit is not null")
    flows = flows.withColumn("_year", F.xxhash64(*key[1:])).withColumn("_day", F.datediff("period_end", F.to_date(F.lit("1970-01-01"))))
    # the earliest filing of a period speaks for it
    order = Window.partitionBy(*key).orderBy("_day", "filed_at", "accession_no", *rank, "value")
    flows = flows.withColumn("_first", F.coalesce(F.lag("_day").over(order) != F.col("_day"), F.lit(True)))
    before = Window.partitionBy(*key).orderBy("_day").rangeBetween(-STEP_DAYS[1], -STEP_DAYS[0])
    prior = F.struct(F.col("period_end").alias("prior_end"), F.col("filed_at").alias("prior_filed"), F.col("value").alias("prior_value"))
    pairs = flows.withColumn("_prior", F.collect_list(F.when(F.col("_first"), prior)).over(before))
    pairs = pairs.where(F.datediff("period_end", "period_start").between(*CUMULATIVE_DAYS)).withColumn("_p", F.explode("_prior")).select("*", "_p.*")
    if no_lookahead:
        pairs = pairs.where("prior_filed <= filed_at")
    # where both sources carry the fact, the first source speaks
    own = Window.partitionBy(*key, "_day", "accession_no", "prior_end").orderBy(*rank, "filed_at", "form", "value")
    first = pairs.withColumn("_own", F.row_number().over(own)).where("_own = 1")
    return first.select(
        "symbol", "concept", (F.col("value") - F.col("prior_value")).alias("value"), "unit",
        F.date_add("prior_end", 1).alias("period_start"), "period_end",
        F.when(F.endswith("form", F.lit("/A")), "10-Q/A").otherwise("10-Q").alias("form"),
        "filed_at", "accession_no", F.lit(2).alias("source_rank"),
    )


def statement_facts(facts: DataFrame) -> DataFrame:
    """Facts that may enter a statement: known form, concept and unit; flows only of the period's own length."""
    days = F.datediff("period_end", "period_start")
    low = F.when(F.col("period_type") == "Q", QUARTER_DAYS[0]).otherwise(YEAR_DAYS[0])
    high = F.when(F.col("period_type") == "Q", QUARTER_DAYS[1]).otherwise(YEAR_DAYS[1])
    known = facts.withColumn("period_type", lookup(F.col("form"), PERIOD_TYPE)).withColumn("column", lookup(F.col("concept"), CONCEPT_COLUMNS))
    return known.where(
        F.col("period_type").isNotNull() & F.col("column").isNotNull() & F.col("unit").isin(UNITS)
        & (F.col("period_start").isNull() | ((days >= low) & (days <= high)))
    )


def build_financials(facts: DataFrame, derive: bool = True) -> DataFrame:
    """One row per (symbol, period, period type, filing); restatements stay separate rows."""
    if "source_rank" not in facts.columns:
        facts = facts.withColumn("source_rank", F.lit(0))
    everything = facts.unionByName(derive_quarters(facts)) if derive else facts
    rank = lookup(F.col("concept"), {c: i for i, c in enumerate(CONCEPT_COLUMNS)})
    key = ["symbol", "period_end", "period_type", "accession_no", "form", "filed_at"]
    # numbers alone are aggregated, so both steps hash and need no sort; a NULL value comes before others of its rank
    ranked = statement_facts(everything).select(*key, "column", (rank.cast("long") * 2**32 + F.coalesce("source_rank", F.lit(-(2**31)))).alias("_rank"), "value")
    ranked = ranked.repartition("symbol", "period_end")
    each = ranked.groupBy(*key, "column", "_rank").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("_n"), F.count("value").alias("_known"))
    each = each.withColumn("value", F.when(F.col("_known") == F.col("_n"), F.col("value")))
    at = lambda c, x: F.when(F.col("column") == c, F.col(x))
    wide = each.groupBy(*key).agg(*[F.min_by(at(c, "value"), at(c, "_rank")).alias(c) for c in STATEMENT_COLUMNS])
    return wide.select(
        "symbol", F.col("period_end").alias("period"), "period_type", F.col("accession_no").alias("accn"), "form",
        F.col("filed_at").alias("filed"), *STATEMENT_COLUMNS,
        (F.col("operating_cf") - F.abs("capex")).alias("free_cash_flow"),
    )


def known_state(financials: DataFrame) -> DataFrame:
    """What was known after each filing date of a symbol: one row per (symbol, filed), valid for dates
    strictly after `filed` until the next row. Trailing sums, current and prior fiscal year, latest balance.

    Work grows with filings, not with the dates that are asked for later. A symbol's window holds its
    filings (a handful per quarter); the periods it needs are then fetched by an equi-join on the period.
    """
    order = Window.partitionBy("symbol").orderBy("filed").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = lambda kind: F.collect_set(F.when(F.col("period_type") == kind, F.col("period"))).over(order)
    latest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("period", "filed", "accn"))).over(order)
    at_filing = financials.select("symbol", "filed", seen("Q").alias("_q"), seen("FY").alias("_fy"), *[latest(c).alias(f"bal_{c}") for c in BALANCE_COLUMNS])
    states = at_filing.dropDuplicates(["symbol", "filed"])  # peers of one filing date carry equal values
    current = F.array_max("_fy")
    in_year = lambda p: F.datediff(current, p).between(*YEAR_DAYS)
    states = states.select(
        "symbol", "filed", *[f"bal_{c}" for c in BALANCE_COLUMNS],
        F.slice(F.sort_array("_q", asc=False), 1, 4).alias("_quarters"), current.alias("fy_period"), F.array_max(F.filter("_fy", in_year)).alias("fy_prior"),
    )
    wanted = states.select(
        "symbol", "filed",
        F.explode(F.concat(
            F.transform("_quarters", lambda p: F.struct(F.lit("Q").alias("period_type"), p.alias("period"))),
            F.array(*[F.struct(F.lit("FY").alias("period_type"), F.col(c).alias("period")) for c in ("fy_period", "fy_prior")]),
        )).alias("w"),
    ).select("symbol", "filed", "w.*").where("period is not null")
    columns = list(dict.fromkeys(TTM_COLUMNS + ANNUAL_COLUMNS))
    reports = financials.select("symbol", "period_type", "period", F.col("filed").alias("_filed"), "accn", *columns)
    # later partial filings must not blank earlier values: the last non-NULL per column, valid until the period's next filing
    upto = Window.partitionBy("symbol", "period_type", "period").orderBy("_filed", "accn")
    versions = reports.where("_filed is not null").select(
        "symbol", "period_type", "period", "_filed", F.lead("_filed").over(upto).alias("_next"), *[F.last(c, ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in columns])
    per_period = wanted.join(versions, ["symbol", "period_type", "period"]).where("_filed <= filed and (_next is null or filed < _next)")
    values = per_period.join(states.select("symbol", "filed", "fy_period", "fy_prior"), ["symbol", "filed"])
    is_q = F.col("period_type") == "Q"
    is_fy = lambda which: (F.col("period_type") == "FY") & (F.col("period") == F.col(which))
    sums = values.groupBy("symbol", "filed").agg(
        F.count(F.when(is_q, 1)).alias("_n"),
        F.datediff(F.max(F.when(is_q, F.col("period"))), F.min(F.when(is_q, F.col("period")))).alias("_span"),
        *[F.when(F.count(F.when(is_q, F.col(c))) == 4, F.sum(F.when(is_q, F.col(c)))).alias(f"ttm_{c}") for c in TTM_COLUMNS],
        *[F.max(F.when(is_fy("fy_period"), F.col(c))).alias(f"fy_{c}") for c in ANNUAL_COLUMNS],
        *[F.max(F.when(is_fy("fy_prior"), F.col(c))).alias(f"prior_{c}") for c in ("revenue", "net_income", "eps")],
    )
    full_year = (F.col("_n") == 4) & F.col("_span").between(*TTM_SPAN_DAYS)
    out = states.select("symbol", "filed", "fy_period", *[f"bal_{c}" for c in BALANCE_COLUMNS]).join(sums, ["symbol", "filed"], "left")
    for c in TTM_COLUMNS:
        out = out.withColumn(f"ttm_{c}", F.when(full_year, F.col(f"ttm_{c}")))
    return out.drop("_n", "_span")


STATE_COLUMNS = [
    "fy_period", *[f"bal_{c}" for c in BALANCE_COLUMNS], *[f"ttm_{c}" for c in TTM_COLUMNS],
    *[f"fy_{c}" for c in ANNUAL_COLUMNS], *[f"prior_{c}" for c in ("revenue", "net_income", "eps")],
]


def attach_state(probes: DataFrame, state: DataFrame, date: str = "as_of", unique: bool = True) -> DataFrame:
    """Strict as-of: a filing made on `date` itself is not known yet."""
    return asof_join(probes, state, ["symbol"], date, "filed", STATE_COLUMNS, strict=True, matched_time="known_filed", unique_left=unique)


def factor_columns(price: Column) -> list[Column]:
    c = F.col
    cap = price * c("bal_shares")
    annual = c("fy_period").isNotNull()
    with_year = lambda e: F.when(annual, e)
    return [
        ratio(c("ttm_gross_profit"), c("ttm_revenue")).alias("gross_margin"),
        ratio(c("ttm_operating_income"), c("ttm_revenue")).alias("operating_margin"),
        ratio(c("ttm_free_cash_flow"), c("ttm_revenue")).alias("fcf_margin"),
        ratio(c("ttm_free_cash_flow"), cap).alias("fcf_yield"),
        with_year(ratio(c("fy_net_income"), c("fy_revenue"))).alias("net_margin"),
        with_year(positive_ratio(c("fy_net_income"), c("fy_equity"))).alias("roe"),
        with_year(ratio(c("fy_net_income"), c("fy_assets"))).alias("roa"),
        with_year(growth(c("fy_revenue"), c("prior_revenue"))).alias("revenue_growth"),
        with_year(growth(c("fy_net_income"), c("prior_net_income"))).alias("net_income_growth"),
        with_year(growth(c("fy_eps"), c("prior_eps"))).alias("eps_growth"),
        with_year(positive_ratio(price, c("fy_eps"))).alias("pe"),
        with_year(ratio(cap, c("fy_revenue"))).alias("ps"),
        with_year(positive_ratio(cap, c("bal_equity"))).alias("pb"),
        positive_ratio(c("bal_debt"), c("bal_equity")).alias("debt_to_equity"),
        ratio(c("bal_liabilities"), c("bal_assets")).alias("liabilities_to_assets"),
    ]


def fundamental_factors(probes: DataFrame, financials: DataFrame, *, date: str = "as_of", price: str = "close", unique: bool = True) -> DataFrame:
    """`probes` (symbol, date, price, ...) plus the 15 ratios known strictly before `date`."""
    state = attach_state(probes, known_state(financials), date, unique)
    return state.select(*probes.columns, *factor_columns(F.col(price)))


def fundamentals_for_pairs(pairs: DataFrame, financials: DataFrame, bars: DataFrame, splits: DataFrame, unverified: DataFrame | None = None, *, date: str = "rec_date") -> DataFrame:
    """(symbol, date) pairs -> ratios at the unadjusted price of the date, market cap and age of the newest
    known filing. Pairs without a fresh price, without a known filing, or whose split history is unverified
    (`unverified`: symbol) keep NULLs."""
    keys = pairs.select("symbol", F.col(date).alias("as_of")).distinct()
    if unverified is not None:
        keys = keys.join(unverified.select("symbol"), "symbol", "left_anti")
    priced = raw_close_at(keys, bars, splits, unique=True).where("raw_close is not null")
    state = attach_state(priced, known_state(financials)).where("known_filed is not null")
    out = state.select(
        F.col("symbol").alias("_s"), F.col("as_of").alias("_d"), *factor_columns(F.col("raw_close")),
        (F.col("raw_close") * F.col("bal_shares")).alias("market_cap"), F.datediff("as_of", "known_filed").alias("filing_age_days"),
    )
    return pairs.join(out, (F.col("symbol") == F.col("_s")) & (F.col(date) == F.col("_d")), "left").drop("_s", "_d")


def factor_panel(bars: DataFrame, financials: DataFrame, splits: DataFrame | None = None, *, price: str = "raw", as_of: str = "bar") -> DataFrame:
    """Month-end panel of price and fundamental factors. `price="raw"` values filings at the price of the
    day; `price="adjusted"` uses the split-adjusted close."""
    from tidemark.operators.prices import PRICE_FACTORS, month_ends, price_factors, with_raw_close

    panel = month_ends(price_factors(bars), as_of)
    if price == "raw" and splits is not None:
        panel = with_raw_close(panel, splits).withColumn("close", F.col("raw_close")).drop("raw_close")
    panel = panel.select("symbol", "as_of", "close", *PRICE_FACTORS)
    return fundamental_factors(panel, financials).drop("close")
