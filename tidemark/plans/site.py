"""Lists, movers, pages, documents, upserts."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.scalar import output_date, output_number
from tidemark.operators import lists as ls, scoring as sc
from tidemark.plans.cte import PRICE, define
from tidemark.plans.market import financial_table, price_panel, price_scores
from tidemark.plans.registry import query, r, rounded
from tidemark.plans.signals import snapshots
from tidemark.plans.standins import Lake, symbol_of
from tidemark.sources import lake as lk
from tidemark.staging import staged


def score_table(lake: Lake) -> DataFrame:
    return staged(price_scores(lake), "scores")


define("equities", "SELECT symbol, name, sector FROM universe WHERE quote_type = 'EQUITY'")
define("ml_rows", "SELECT symbol, as_of, ret_1m AS ml_score FROM month_rows WHERE month(as_of) % 2 = 0")
define("last_scores", "SELECT * FROM price_scores QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY as_of DESC) = 1")


def ml_scores(lake: Lake) -> DataFrame:
    """A model-score table that lacks every second month."""
    return price_panel(lake).where("month(as_of) % 2 = 0").select("symbol", "as_of", F.col("ret_1m").alias("ml_score"))


@query("J4", "SELECT symbol, as_of, round(total, 6) AS total, round(ml_score, 6) AS ml_score FROM price_scores LEFT JOIN ml_rows USING (symbol, as_of)")
def scores_with_model(lake: Lake) -> DataFrame:
    return rounded(sc.with_model_scores(price_scores(lake), ml_scores(lake)).select("symbol", "as_of", "total", "ml_score"))


@query("J5", "SELECT symbol, as_of, name, sector, round(total, 6) AS total FROM price_scores JOIN equities USING (symbol)")
def scores_with_equities(lake: Lake) -> DataFrame:
    eq = lake.universe.where("quote_type = 'EQUITY'").select("symbol", "name", "sector")
    return rounded(price_scores(lake).join(eq, "symbol").select("symbol", "as_of", "name", "sector", "total"))


@query("K6", "SELECT symbol, as_of, round(total, 6) AS total FROM last_scores")
def latest_scores(lake: Lake) -> DataFrame:
    return rounded(ls.latest_per_symbol(price_scores(lake)).select("symbol", "as_of", "total"))


@query("P9", "SELECT symbol, as_of FROM last_scores WHERE as_of >= (SELECT max(as_of) FROM last_scores) - 10")
def fresh_scores(lake: Lake) -> DataFrame:
    return ls.fresh(ls.latest_per_symbol(score_table(lake))).select("symbol", "as_of")


define("row_changes", "SELECT *, total - lag(total, 3) OVER (PARTITION BY symbol ORDER BY as_of) AS total_change, count(*) OVER (PARTITION BY symbol) AS history FROM price_scores QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY as_of DESC) = 1")


@query("W13", "SELECT symbol, as_of, round(total, 6) AS total, round(total_change, 6) AS total_change, history FROM row_changes")
def score_change_rows(lake: Lake) -> DataFrame:
    return rounded(ls.with_row_change(price_scores(lake)).select("symbol", "as_of", "total", "total_change", "history"))


define("date_changes", """
SELECT a.*, a.total - b.total AS total_change FROM price_scores a JOIN (SELECT as_of, row_number() OVER (ORDER BY as_of DESC) AS i FROM (SELECT DISTINCT as_of FROM price_scores)) d ON d.as_of = a.as_of AND d.i = 1
LEFT JOIN (SELECT p.* FROM price_scores p JOIN (SELECT as_of, row_number() OVER (ORDER BY as_of DESC) AS i FROM (SELECT DISTINCT as_of FROM price_scores)) d ON d.as_of = p.as_of AND d.i = 4) b ON b.symbol = a.symbol
""")


@query("J20", "SELECT symbol, as_of, round(total, 6) AS total, round(total_change, 6) AS total_change FROM date_changes")
def score_change_dates(lake: Lake) -> DataFrame:
    return rounded(ls.with_date_change(score_table(lake)).select("symbol", "as_of", "total", "total_change"))


def _list_sql(name: str, column: str, direction: str) -> str:
    return f"SELECT '{name}' AS list, row_number() OVER (ORDER BY {column} {direction}, symbol) AS rank, symbol, round({column}, 6) AS value FROM date_changes WHERE {column} IS NOT NULL QUALIFY rank <= 15"


@query("K3 Q8", "\nUNION ALL ".join(f"SELECT * FROM ({_list_sql(*x)})" for x in (("momentum", "momentum", "DESC"), ("risk", "risk", "DESC"), ("total", "total", "DESC"), ("total_change", "total_change", "DESC"), ("total_change_worst", "total_change", "ASC"))))
def dashboard_lists(lake: Lake) -> DataFrame:
    out = ls.top_lists(ls.with_date_change(score_table(lake)), ["momentum", "risk", "total", "total_change"])
    return rounded(out.withColumn("rank", F.col("rank").cast("long")))


@query("K2 P19", """
SELECT symbol, as_of, round(total, 6) AS total FROM row_changes WHERE history > 3 AND symbol IN (SELECT symbol FROM equities) AND symbol IN (SELECT symbol FROM financials WHERE period_type = 'FY') AND total IS NOT NULL ORDER BY row_changes.total DESC, symbol LIMIT 10
""")
def research_candidates(lake: Lake) -> DataFrame:
    return rounded(ls.top_symbols(price_scores(lake), lake.universe, financial_table(lake), 10))


@query("K8", """
SELECT symbol, CAST(round(momentum) AS BIGINT) AS momentum, CAST(round(risk) AS BIGINT) AS risk, CAST(round(total) AS BIGINT) AS total FROM (SELECT * FROM last_scores WHERE as_of >= (SELECT max(as_of) FROM last_scores) - 10 AND total IS NOT NULL ORDER BY total DESC, symbol LIMIT 10)
""")
def ranking_fallback(lake: Lake) -> DataFrame:
    """Ranking by a category nobody has: falls back to the total."""
    latest = staged(ls.latest_per_symbol(price_scores(lake)), "latest")
    return ls.ranking(latest, "quality").select("symbol", *[F.col(c).cast("long").alias(c) for c in ("momentum", "risk", "total")])


define("index_table", "SELECT symbol, name, sector, round(momentum, 4) AS momentum, round(risk, 4) AS risk, round(total, 4) AS total, round(total_change, 4) AS total_change FROM row_changes JOIN equities USING (symbol) WHERE history > 3")
_IDX = ["symbol", "name", "sector", "momentum", "risk", "total", "total_change"]


@query("X11 P18 Q7", f"SELECT {', '.join(_IDX)} FROM index_table")
def index_rows(lake: Lake) -> DataFrame:
    return ls.index_rows(price_scores(lake), lake.universe).select(*_IDX)


@query("P20 K10", f"SELECT {', '.join(_IDX)} FROM index_table WHERE contains(lower(symbol), '1') OR contains(lower(name), '1') ORDER BY total_change DESC NULLS LAST, symbol LIMIT 20 OFFSET 10")
def list_page(lake: Lake) -> DataFrame:
    rows = ls.index_rows(price_scores(lake), lake.universe).select(*_IDX)
    # pages of 10: the second and third page in one, as the list shows them when paged twice
    return ls.page(rows, query="1", sort="total_change", number=1, size=10).unionByName(ls.page(rows, query="1", sort="total_change", number=2, size=10))


@query("X11 dictionary", "\nUNION ALL ".join(
    f"SELECT '{f}' AS factor, '{c}' AS category, '{ls.FACTOR_LABELS[f]}' AS label, '{'higher' if up else 'lower'}' AS better, count({f}) AS present FROM month_rows"
    for c, fs in sc.CATEGORIES.items() for f, up in fs.items() if f in PRICE))
def data_dictionary(lake: Lake) -> DataFrame:
    return ls.data_dictionary(price_panel(lake))


@query("K4", """
SELECT symbol, round(total, 4) AS total, round(close, 8) AS last_close, direction FROM (SELECT symbol, total FROM (SELECT s.symbol, s.total FROM (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY as_of DESC) = 1) s JOIN equities USING (symbol)
 WHERE quality IS NOT NULL AND growth IS NOT NULL AND value IS NOT NULL AND momentum IS NOT NULL AND risk IS NOT NULL AND total IS NOT NULL ORDER BY round(s.total, 4) DESC, s.symbol LIMIT 10))
LEFT JOIN (SELECT symbol, arg_max(close, date) AS close, CAST(1 AS BIGINT) AS direction FROM bars GROUP BY 1) USING (symbol)
""")
def complete_shortlist(lake: Lake) -> DataFrame:
    """Best complete scores with the latest close."""
    from tidemark.plans.market import factor_panel

    full = staged(sc.score(staged(factor_panel(lake), "metrics")), "scores")
    rows = ls.index_rows(full, lake.universe)
    daily = lake.bar_table.groupBy("symbol").agg(F.max_by("close", "date").alias("close"), F.lit(1).cast("long").alias("direction"))
    return ls.shortlist(rows, daily).select("symbol", "total", F.round("last_close", 8).alias("last_close"), "direction")


@query("K5", """
SELECT symbol, count(*) AS n, string_agg(strftime(date, '%Y-%m-%d'), ',' ORDER BY date) AS dates, round(arg_min(close, date), 2) AS first_close FROM (SELECT symbol, date, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 252) GROUP BY 1
""")
def price_history(lake: Lake) -> DataFrame:
    h = ls.price_history(lake.bars)
    return h.select("symbol", F.size("dates").cast("long").alias("n"), F.array_join("dates", ",").alias("dates"), F.round(F.element_at("closes", 1), 2).alias("first_close"))


@query("P18", f"SELECT symbol, strftime(as_of, '%Y-%m-%d') AS as_of, {r(PRICE, 4)} FROM month_rows")
def rounded_output(lake: Lake) -> DataFrame:
    return price_panel(lake).select("symbol", output_date(F.col("as_of")).alias("as_of"), *[output_number(F.col(c)).alias(c) for c in PRICE])


@query("X10 S16")
def symbol_documents(lake: Lake) -> DataFrame:
    """One JSON document per scored symbol."""
    bars = lake.bar_table
    panel, scored = staged(price_panel(lake).drop("close"), "metrics"), score_table(lake)
    # event types stand in for symbols in the tick data: the n-th type in name order becomes supplier n
    kinds = lake.ticks.select("symbol").distinct().select(F.col("symbol").alias("kind"), F.concat(F.lit("S"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("symbol")).cast("string")).alias("symbol"))
    snaps = snapshots(lake).withColumnRenamed("symbol", "kind").join(kinds, "kind").drop("kind")
    docs = ls.symbol_documents(lake.universe, bars, scored, panel, snaps)
    return docs.select("symbol", F.to_json(F.struct(*[c for c in docs.columns if c != "symbol"]), {"ignoreNullFields": "false"}).alias("document"))


@query("X10 parts", """
SELECT u.symbol, u.sector, p.n AS bars, s.n AS score_rows, round(s.last_total, 4) AS last_total, f.factors FROM universe u
JOIN (SELECT symbol, count(*) AS n, arg_max(total, as_of) AS last_total FROM price_scores GROUP BY 1) s USING (symbol)
LEFT JOIN (SELECT symbol, least(count(*), 252) AS n FROM bars GROUP BY 1) p USING (symbol) LEFT JOIN (SELECT symbol, CAST(7 AS BIGINT) AS factors FROM bars GROUP BY 1) f USING (symbol)
""")
def symbol_document_parts(lake: Lake) -> DataFrame:
    """Sizes and ends of the arrays and maps inside the documents."""
    bars, scored = lake.bar_table, score_table(lake)
    h = ls.price_history(bars).select("symbol", F.size("dates").cast("long").alias("bars"))
    s = ls.score_history(scored).select("symbol", F.size("score_history.total").cast("long").alias("score_rows"), F.element_at("score_history.total", -1).alias("last_total"))
    m = ls.factor_map(price_panel(lake).drop("close")).select("symbol", F.size("factors").cast("long").alias("factors"))
    return lake.universe.select("symbol", "sector").join(s, "symbol").join(h, "symbol", "left").join(m, "symbol", "left")


@query("K6 notes", """
SELECT symbol, generated_at, CASE WHEN i % 3 = 0 THEN 'thesis ' || i ELSE 'raw ' || i END AS thesis FROM (SELECT 'S' || (o_custkey // 15) AS symbol, CAST(o_orderdate AS DATE) AS generated_at, o_orderkey AS i FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey // 15 ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) = 1)
""")
def latest_notes(lake: Lake) -> DataFrame:
    o = lake.table("orders")
    i = F.col("o_orderkey")
    notes = o.select(symbol_of(F.floor(F.col("o_custkey") / 15).cast("long")).alias("symbol"), F.struct(F.to_date("o_orderdate").alias("d"), i).alias("generated_at"), F.when(i % 3 == 0, F.concat(F.lit("thesis "), i.cast("string"))).alias("thesis"),
                     *[F.lit(None).cast("string").alias(c) for c in ("bull_case", "bear_case", "risks", "contradictions")], F.concat(F.lit("raw "), i.cast("string")).alias("raw"))
    return ls.latest_notes(notes).select("symbol", F.col("generated_at.d").alias("generated_at"), "thesis")


# --- upserts ---------------------------------------------------------------------------------------
@query("S5 U5", """
SELECT symbol, date, round(close, 8) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY v DESC) AS rn FROM (
 SELECT symbol, date, close, 0 AS v FROM bars WHERE date < DATE '1999-01-01' UNION ALL SELECT symbol, date, close * 2, 1 FROM bars WHERE date >= DATE '1998-06-01')) WHERE rn = 1
""")
def keyed_upsert(lake: Lake) -> DataFrame:
    b = lake.bar_table.select("symbol", "date", "close")
    new = b.where("date >= date'1998-06-01'").withColumn("close", F.col("close") * 2)
    return rounded(lk.upserted(b.where("date < date'1999-01-01'"), new, ["symbol", "date"]), 8)


@query("S6", """
SELECT symbol, quote_type, sector, CASE WHEN k % 4 = 0 THEN NULL ELSE industry END AS industry, CASE WHEN k % 2 = 0 THEN upper(name) ELSE name END AS name FROM (SELECT *, CAST(substr(symbol, 2) AS BIGINT) AS k FROM universe)
""")
def universe_upsert(lake: Lake) -> DataFrame:
    """Half of the universe comes again from the source: renamed, and partly without the industry field."""
    u = lake.universe
    k = F.substring("symbol", 2, 20).cast("long")
    fresh = u.where(k % 2 == 0).select("symbol", "quote_type", "sector", F.when(k % 4 != 0, F.col("industry")).alias("industry"), F.upper("name").alias("name"))
    return lk.upserted(u, fresh, ["symbol"])


@query("U5", "SELECT l_suppkey, l_shipdate, min(l_orderkey) AS l_orderkey FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate, l_orderkey FROM lineitem) GROUP BY 1, 2")
def keep_first(lake: Lake) -> DataFrame:
    li = lake.table("lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("l_shipdate"), "l_orderkey")
    return lk.keep_one(li, ["l_suppkey", "l_shipdate"], ["l_orderkey"], last=False)


@query("S15", f"SELECT symbol, as_of, {r(PRICE)} FROM month_rows")
def table_sink(lake: Lake) -> DataFrame:
    """The panel written as a table and read back."""
    return rounded(staged(price_panel(lake).drop("close"), "panel"))

