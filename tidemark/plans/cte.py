"""ANSI-SQL twins of the stand-in roles and of shared intermediate results, for checking on DuckDB.

`with_ctes(body)` prefixes a query with exactly the definitions it needs.
"""
from __future__ import annotations

import re

CTES: dict[str, str] = {}


def define(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def _needs(sql: str) -> set[str]:
    words = set(re.findall(r"[a-z_0-9]+", sql))
    found: set[str] = set()
    for name in CTES:
        if name in words:
            found |= {name}
    return found


def with_ctes(body: str) -> str:
    needed, frontier = set(), _needs(body)
    while frontier:
        needed |= frontier
        frontier = set().union(*[_needs(CTES[n]) - {n} for n in frontier]) - needed
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in CTES if n in needed]
    body = body.strip()
    if not parts:
        return body
    head = "WITH RECURSIVE " if "RECURSIVE" in body else "WITH "
    body = body.replace("WITH RECURSIVE ", "WITH ", 1)
    if body.startswith("WITH "):
        return head + ",\n".join(parts) + ",\n" + body[5:]
    return head + ",\n".join(parts) + "\n" + body


define("bars", """
SELECT 'S' || l_suppkey AS symbol, d AS date, open, high, low, close, close * (1 + (l_suppkey % 7) * 0.01::DOUBLE) AS adj_close, volume FROM (
  SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, arg_min(p, seq) AS open, max(p) AS high, min(p) AS low, arg_max(p, seq) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS p, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq FROM lineitem WHERE l_quantity > 0)
  GROUP BY 1, 2)
""")
define("idx", "SELECT 'SPY' AS symbol, date, avg(close) AS close, avg(adj_close) AS adj_close FROM bars GROUP BY date")
define("universe", """
SELECT 'S' || s_suppkey AS symbol, CASE WHEN s_suppkey % 10 = 9 THEN 'ETF' WHEN s_suppkey % 10 <> 8 THEN 'EQUITY' END AS quote_type,
  r_name AS sector, n_name AS industry, s_name AS name
FROM supplier LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) ON s_nationkey = n_nationkey
""")
define("funds", """
SELECT 'X' || (CASE sector WHEN 'AFRICA' THEN 'AF' WHEN 'AMERICA' THEN 'AM' WHEN 'ASIA' THEN 'AS' WHEN 'EUROPE' THEN 'EU' ELSE 'ME' END) AS symbol, date, avg(close) AS close, avg(adj_close) AS adj_close
FROM bars JOIN universe USING (symbol) GROUP BY 1, 2
UNION ALL SELECT 'QQQ', date, avg(high), avg(high) FROM bars GROUP BY date
""")
define("split_table", """
SELECT 'S' || s_suppkey AS symbol, DATE '1997-06-02' AS date, 2.0::DOUBLE AS ratio FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT 'S' || s_suppkey, DATE '1999-03-01', 3.0::DOUBLE FROM supplier WHERE s_suppkey % 7 = 0
""")
define("spells", """
SELECT 'S' || s_suppkey AS symbol, DATE '1995-01-01' + CAST(s_suppkey % 5 * 300 AS INT) AS start_d, CASE WHEN s_suppkey % 3 <> 0 THEN DATE '1995-01-01' + CAST(s_suppkey % 5 * 300 + 1000 AS INT) END AS end_d FROM supplier
UNION ALL SELECT 'S' || s_suppkey, DATE '1995-01-01' + CAST(s_suppkey % 5 * 300 + 900 AS INT), DATE '1995-01-01' + CAST(s_suppkey % 5 * 300 + 1500 AS INT) FROM supplier WHERE s_suppkey % 4 = 1
""")
define("quarter_flows", """
SELECT *, make_date(y, 1, 1) AS ys, make_date(y, q * 3 - 2, 1) AS qs, last_day(make_date(y, q * 3, 1)) AS pe, CAST(last_day(make_date(y, q * 3, 1)) + CAST(30 + k % 30 AS INT) AS DATE) AS fd,
  sum(rev) OVER w AS rev_ytd, sum(gp) OVER w AS gp_ytd, sum(oi) OVER w AS oi_ytd, sum(ni) OVER w AS ni_ytd, sum(ocf) OVER w AS ocf_ytd, sum(capex) OVER w AS capex_ytd
FROM (SELECT k, y, q, rev, gp, tax, qty, gp - qty * 1500 AS oi, gp - qty * 1500 - tax AS ni, gp - qty * 1400 AS ocf, qty * (CASE WHEN k % 2 = 0 THEN -50 ELSE 50 END) AS capex
  FROM (SELECT l_suppkey AS k, CAST(year(l_shipdate) AS INT) AS y, CAST(quarter(l_shipdate) AS INT) AS q, round(sum(l_extendedprice), 2) AS rev, round(sum(l_extendedprice * (1 - l_discount)), 4) AS gp,
    round(sum(l_extendedprice * l_tax), 4) AS tax, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2, 3))
WINDOW w AS (PARTITION BY k, y ORDER BY q ROWS UNBOUNDED PRECEDING)
""")
_C = "RevenueFromContractWithCustomerExcludingAssessedTax"
_ITEMS = [
    (_C, "rev", "qs", "USD", "q < 4", 0), ("Revenues", "rev + 1", "qs", "USD", "q < 4 AND k % 3 = 0", 0), ("GrossProfit", "gp", "qs", "USD", "q < 4", 0),
    ("OperatingIncomeLoss", "oi", "qs", "USD", "q < 4", 0), ("NetIncomeLoss", "ni", "qs", "USD", "q < 4", 0), ("EarningsPerShareDiluted", "ni / 1024", "qs", "USD/shares", "q < 4", 0),
    (_C, "rev_ytd", "ys", "USD", "q > 1", 0), ("GrossProfit", "gp_ytd", "ys", "USD", "q > 1", 0), ("OperatingIncomeLoss", "oi_ytd", "ys", "USD", "q > 1", 0),
    ("NetIncomeLoss", "ni_ytd", "ys", "USD", "q > 1", 0), ("EarningsPerShareDiluted", "ni_ytd / 1024", "ys", "USD/shares", "q = 4", 0),
    ("NetCashProvidedByUsedInOperatingActivities", "ocf_ytd", "ys", "USD", "true", 0), ("PaymentsToAcquirePropertyPlantAndEquipment", "capex_ytd", "ys", "USD", "true", 0),
    ("Assets", "rev * 3", "NULL", "USD", "true", 0), ("Assets", "rev * 9", "NULL", "EUR", "true", 0), ("Liabilities", "rev * (1 + k % 3)", "NULL", "USD", "true", 0),
    ("StockholdersEquity", "rev * (2 - k % 3)", "NULL", "USD", "true", 0), ("CashAndCashEquivalentsAtCarryingValue", "gp * 0.4::DOUBLE", "NULL", "USD", "(k + q) % 4 <> 0", 0),
    ("CommonStockSharesOutstanding", "k + 1000", "NULL", "shares", "true", 0), ("Goodwill", "gp", "NULL", "USD", "true", 0), ("LongTermDebt", "tax * 10", "NULL", "USD", "k % 2 = 0", 0),
    ("LongTermDebtNoncurrent", "tax * 11", "NULL", "USD", "true", 0), (_C, "rev_ytd * 0.99::DOUBLE", "ys", "USD", "q = 4 AND k % 4 = 0", 1), ("NetIncomeLoss", "ni_ytd * 0.8::DOUBLE", "ys", "USD", "q = 4 AND k % 4 = 0", 1),
]
define("facts", """
SELECT 'S' || k AS symbol, concept, value, unit, period_start, pe AS period_end, CASE WHEN q = 4 THEN '10-K' ELSE '10-Q' END || CASE WHEN am = 1 THEN '/A' ELSE '' END AS form,
  CAST(fd + 45 * am AS DATE) AS filed_at, 'S' || k || '-' || y || 'Q' || q || CASE WHEN am = 1 THEN 'A' ELSE '' END AS accession_no,
  CASE WHEN concept IN ('Revenues', '""" + _C + """', 'GrossProfit', 'OperatingIncomeLoss', 'NetIncomeLoss', 'EarningsPerShareDiluted') THEN 0 ELSE 1 END AS source_rank
FROM (""" + "\nUNION ALL ".join(
    f"SELECT k, y, q, pe, fd, '{c}' AS concept, CAST({v} AS DOUBLE) AS value, '{u}' AS unit, CAST({b} AS DATE) AS period_start, {a} AS am FROM quarter_flows WHERE {w}" for c, v, b, u, w, a in _ITEMS
) + ")")
define("calls", """
SELECT o_orderkey, o_custkey // 15 AS k, CAST(o_orderdate AS DATE) AS day, CASE o_orderpriority WHEN '1-URGENT' THEN 'BUY' WHEN '5-LOW' THEN 'SELL' WHEN '4-NOT SPECIFIED' THEN 'HOLD' WHEN '3-MEDIUM' THEN 'REDUCE' END AS action,
  o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '2-HIGH'
""")
define("ticks", "SELECT event_type AS symbol, ts, value AS price, 1 AS volume, event_id FROM events")
define("raw_news", """
SELECT upper(source) AS symbol, DATE '2024-01-01' + CAST(doc_id % 366 AS INT) AS date, strftime(DATE '2024-01-01' + CAST(doc_id % 366 AS INT), '%Y-%m-%d') || 'T12:00:00Z' AS published_at, doc_id AS item_id,
  '{A:' || doc_id || CASE WHEN doc_id % 3 <> 0 THEN ':K:' || CAST(CAST((doc_id % 200 - 100) / 100.0 AS DECIMAL(4,2)) AS VARCHAR) ELSE '' END || ':C:0.9}' || CASE WHEN doc_id % 2 = 0 THEN '!' ELSE '' END ||
  CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE CASE doc_id % 5 WHEN 0 THEN 'Upgraded &amp; raised: ' WHEN 1 THEN 'downgraded &lt;cut&gt;: ' WHEN 2 THEN 'Initiated: ' ELSE '' END || text END AS headline
FROM documents
""")
# --- shared intermediate results -----------------------------------------------------------------
define("daily_factors", """
SELECT symbol, date, close, adj_close / lag(adj_close, 21) OVER w - 1 AS ret_1m, adj_close / lag(adj_close, 63) OVER w - 1 AS ret_3m, adj_close / lag(adj_close, 126) OVER w - 1 AS ret_6m,
  lag(adj_close, 21) OVER w / lag(adj_close, 252) OVER w - 1 AS ret_12m_ex_1m,
  CASE WHEN count(*) OVER w200 = 200 THEN adj_close / avg(adj_close) OVER w200 - 1 END AS sma200_gap,
  CASE WHEN count(r) OVER w60 = 60 THEN stddev_samp(r) OVER w60 * sqrt(252) END AS vol_60d,
  CASE WHEN count(*) OVER w252 = 252 THEN adj_close / max(adj_close) OVER w252 - 1 END AS drawdown_252d,
  lead(date) OVER w AS next_date
FROM (SELECT *, adj_close / lag(adj_close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM bars)
WINDOW w AS (PARTITION BY symbol ORDER BY date), w200 AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING), w60 AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING),
  w252 AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING)
""")
PRICE = ["ret_1m", "ret_3m", "ret_6m", "ret_12m_ex_1m", "sma200_gap", "vol_60d", "drawdown_252d"]
define("month_rows", f"""
SELECT symbol, last_day(date) AS as_of, date, close, {", ".join(PRICE)} FROM daily_factors WHERE next_date IS NULL OR date_trunc('month', next_date) <> date_trunc('month', date)
""")
define("all_prices", """
SELECT symbol, date, close, adj_close FROM bars UNION ALL SELECT symbol, date, close, adj_close FROM idx UNION ALL SELECT symbol, date, close, adj_close FROM funds
""")
define("month_prices", """
SELECT symbol, last_day(date) AS as_of, arg_max(adj_close, date) AS adj_close FROM all_prices GROUP BY 1, 2
""")


def percent(column: str, higher: bool, by: str = "as_of", table_count: str | None = None) -> str:
    """Average rank of ties over the non-NULL count, NULL kept."""
    part = f"PARTITION BY {by}, ({column} IS NULL)"
    order = column if higher else f"{column} DESC"
    return (
        f"CASE WHEN {column} IS NOT NULL THEN (rank() OVER ({part} ORDER BY {order}) + (count(*) OVER (PARTITION BY {by}, {column}) - 1) / 2.0::DOUBLE)"
        f" / count({column}) OVER (PARTITION BY {by}) END"
    )


def score_sql(source: str, categories: dict[str, dict[str, bool]], present: list[str]) -> str:
    """Category scores and total over `source` for the factors it has."""
    ranks = ", ".join(f"{percent(f, up)} AS {f}_p" for fs in categories.values() for f, up in fs.items() if f in present)

    def mean(names: list[str]) -> str:
        if not names:
            return "NULL::DOUBLE"
        total = " + ".join(f"coalesce({n}, 0.0)" for n in names)
        n = " + ".join(f"CAST({n} IS NOT NULL AS INT)" for n in names)
        return f"({total}) / nullif({n}, 0)"

    cats = ", ".join(f"{mean([f + '_p' for f in fs if f in present])} * 100 AS {c}" for c, fs in categories.items())
    return f"SELECT *, {mean(list(categories))} AS total FROM (SELECT symbol, as_of, {cats} FROM (SELECT symbol, as_of, {ranks} FROM {source}))"
