from helpers import approx, d, rows

from tidemark.operators import facts as fx
from tidemark.sources import text_files as tf

SCHEMA = "symbol string, concept string, value double, unit string, period_start date, period_end date, form string, filed_at date, accession_no string"


def facts(spark, items):
    return spark.createDataFrame([("A", c, float(v), u, d(s), d(e), f, d(filed), acc) for c, v, u, s, e, f, filed, acc in items], SCHEMA)


def test_annual_and_quarter_rows(spark):
    f = facts(spark, [
        ("Assets", 1000, "USD", None, "2023-09-30", "10-K", "2023-11-01", "k1"), ("Assets", 900, "USD", None, "2023-06-30", "10-Q", "2023-08-01", "q1"),
        ("NetIncomeLoss", 100, "USD", "2022-10-01", "2023-09-30", "10-K", "2023-11-01", "k1"),
    ])
    assert rows(fx.build_financials(f), "period_type", "assets", "net_income") == [("FY", 1000.0, 100.0), ("Q", 900.0, None)]


def test_year_to_date_is_not_a_quarter(spark):
    f = facts(spark, [("NetIncomeLoss", 30, "USD", "2023-04-01", "2023-06-30", "10-Q", "2023-08-01", "q2"), ("NetIncomeLoss", 70, "USD", "2023-01-01", "2023-06-30", "10-Q", "2023-08-01", "q2")])
    assert rows(fx.build_financials(f), "net_income") == [(30.0,)]


def test_restatements_are_kept(spark):
    f = facts(spark, [("Assets", 1000, "USD", None, "2023-09-30", "10-K", "2023-11-01", "k1"), ("Assets", 990, "USD", None, "2023-09-30", "10-K/A", "2024-01-01", "k2")])
    assert rows(fx.build_financials(f), "accn", "assets") == [("k1", 1000.0), ("k2", 990.0)]


def test_free_cash_flow_and_precedence(spark):
    year = ("USD", "2022-10-01", "2023-09-30", "10-K", "2023-11-01", "k1")
    f = facts(spark, [("NetCashProvidedByUsedInOperatingActivities", 500, *year), ("PaymentsToAcquirePropertyPlantAndEquipment", -120, *year),
                      ("RevenueFromContractWithCustomerExcludingAssessedTax", 111, *year), ("Revenues", 222, *year)])
    assert rows(fx.build_financials(f), "free_cash_flow", "revenue") == [(380.0, 222.0)]


def test_quarters_from_cumulative_values(spark):
    ends = ["2023-03-31", "2023-06-30", "2023-09-30", "2023-12-31"]
    filed = ["2023-05-01", "2023-08-01", "2023-11-01", "2024-02-01"]
    c = "NetCashProvidedByUsedInOperatingActivities"
    f = facts(spark, [(c, v, "USD", "2023-01-01", e, "10-K" if i == 3 else "10-Q", filed[i], f"a{i}") for i, (v, e) in enumerate(zip((10, 25, 45, 80), ends))])
    got = rows(fx.build_financials(f).where("period_type = 'Q'"), "period", "operating_cf", "filed")
    assert [g[1] for g in got] == [10.0, 15.0, 20.0, 35.0] and got[-1][2] == d("2024-02-01")


FIN = "symbol string, period date, period_type string, accn string, form string, filed date, " + ", ".join(f"{c} double" for c in [*fx.STATEMENT_COLUMNS, "free_cash_flow"])


def financials(spark, items):
    cols = [*fx.STATEMENT_COLUMNS, "free_cash_flow"]
    return spark.createDataFrame([("A", d(p), t, f"x{i}", "f", d(filed), *[float(v[c]) if v.get(c) is not None else None for c in cols]) for i, (p, t, filed, v) in enumerate(items)], FIN)


def probes(spark, dates, close):
    return spark.createDataFrame([("A", d(x), float(close)) for x in dates], "symbol string, as_of date, close double")


def test_fundamentals_known_by_date(spark):
    fin = financials(spark, [("2022-12-31", "FY", "2023-02-01", dict(revenue=100, net_income=10)), ("2023-12-31", "FY", "2024-02-01", dict(revenue=200, net_income=40, eps=4))])
    out = {r["as_of"]: r for r in fx.fundamental_factors(probes(spark, ["2024-01-31", "2024-02-29", "2023-02-01"], 20), fin).collect()}
    early, late, same_day = out[d("2024-01-31")], out[d("2024-02-29")], out[d("2023-02-01")]
    assert approx(early["net_margin"], 0.1) and early["revenue_growth"] is None
    assert approx(late["net_margin"], 0.2) and approx(late["revenue_growth"], 1.0) and approx(late["pe"], 5.0)
    assert all(same_day[c] is None for c in fx.FUNDAMENTAL_FACTORS)  # a filing on the day is not known


def test_no_lookahead_when_later_filings_change(spark):
    base = [("2022-12-31", "FY", "2023-02-01", dict(revenue=100, net_income=10)), ("2023-12-31", "FY", "2024-02-01", dict(revenue=200, net_income=40))]
    moved = [base[0], ("2023-12-31", "FY", "2024-02-01", dict(revenue=2000, net_income=4000))]
    p = probes(spark, ["2024-02-01"], 20)
    assert rows(fx.fundamental_factors(p, financials(spark, base))) == rows(fx.fundamental_factors(p, financials(spark, moved)))


def test_negative_equity_has_no_ratio(spark):
    fin = financials(spark, [("2022-12-31", "FY", "2023-02-01", dict(net_income=10, equity=-5, debt=20, revenue=1))])
    r = fx.fundamental_factors(probes(spark, ["2023-03-01"], 20), fin).first()
    assert r["roe"] is None and r["debt_to_equity"] is None


def test_partial_filing_does_not_blank_earlier_values(spark):
    fin = financials(spark, [("2022-12-31", "FY", "2023-02-01", dict(revenue=100, net_income=10)), ("2022-12-31", "FY", "2023-03-01", dict(revenue=80))])
    r = fx.fundamental_factors(probes(spark, ["2023-04-01"], 20), fin).first()
    assert approx(r["net_margin"], 10 / 80)


def test_trailing_twelve_months(spark):
    q = [("2023-03-31", "2023-05-01", 10), ("2023-06-30", "2023-08-01", 10), ("2023-09-30", "2023-11-01", 10), ("2023-12-31", "2024-02-01", 20)]
    items = [(p, "Q", f, dict(revenue=100, gross_profit=40, operating_income=20, free_cash_flow=x, shares=10)) for p, f, x in q]
    r = fx.fundamental_factors(probes(spark, ["2024-03-01"], 10), financials(spark, items)).first()
    assert approx(r["gross_margin"], 0.4) and approx(r["operating_margin"], 0.2) and approx(r["fcf_margin"], 0.125) and approx(r["fcf_yield"], 0.5)
    three = fx.fundamental_factors(probes(spark, ["2024-03-01"], 10), financials(spark, items[:3])).first()
    assert three["gross_margin"] is None


def test_company_facts_json(spark):
    doc = '{"facts": {"us-gaap": {"Assets": {"units": {"USD": [{"val": 5, "end": "2023-09-30", "form": "10-K", "filed": "2023-11-01", "accn": "k"}, {"val": 6, "end": "2023-09-30", "form": "8-K", "filed": "2023-11-01", "accn": "x"}]}}, "Unmapped": {"units": {"USD": [{"val": 1, "end": "2023-09-30", "form": "10-K", "filed": "2023-11-01", "accn": "k"}]}}}}}'
    out = tf.extract_facts(spark.createDataFrame([("A", doc)], "symbol string, json string"), list(fx.CONCEPT_COLUMNS))
    assert rows(out, "concept", "value", "period_start", "form") == [("Assets", 5.0, None, "10-K")]


def test_latest_filing_per_form(spark):
    df = spark.createDataFrame([("A", ["8-K", "10-Q", "10-K", "10-Q", "10-K"], ["a1", "a2", "a3", "a4", "a5"], ["2024-05-01"] * 5, ["d"] * 5)], "symbol string, form array<string>, accn array<string>, filed array<string>, doc array<string>")
    assert rows(tf.latest_filings(df), "form", "accn") == [("10-K", "a3"), ("10-Q", "a2")]


def test_filings_need_no_sorted_aggregates(spark):
    """Numbers alone are aggregated; of one rank a NULL value comes first, then the smaller one."""
    rows = [("A", c, v, "USD", d("2023-01-01"), d("2023-03-31"), "10-Q", d("2023-05-01"), "a1", rank) for c, v, rank in [
        ("Revenues", 7.0, 1), ("Revenues", 9.0, 0), ("Revenues", 8.0, 0), ("RevenueFromContractWithCustomerExcludingAssessedTax", 1.0, 0), ("GrossProfit", 3.0, 0), ("GrossProfit", None, 0)]]
    facts = spark.createDataFrame(rows, "symbol string, concept string, value double, unit string, period_start date, period_end date, form string, filed_at date, accession_no string, source_rank int")
    out = fx.build_financials(facts)
    assert [(r.revenue, r.gross_profit) for r in out.collect()] == [(8.0, None)]
    assert "SortAggregate" not in out._jdf.queryExecution().sparkPlan().toString()
