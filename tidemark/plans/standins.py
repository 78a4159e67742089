"""Equity-panel roles played by the generic warehouse tables.

Every role is derived by Spark from the given tables, so its size grows with them. Rows collapse to
their role's key (partial aggregation) before anything is sorted.

role            source
bars            lineitem per (supplier, ship date); price = extended price / quantity
index, funds    mean of those bars per date, and per date and region
universe        supplier with nation and region
spells          supplier
splits          supplier
facts           lineitem per (supplier, quarter), spread over concepts, forms and filings
recs            orders (picks sheet: status F/P and urgent; list: status O/P), 15 customers per supplier
ticks           events
news            documents
filings         pages (markup) and documents (lines)
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions.scalar import lookup
from tidemark.staging import staged

# fixed values of the stand-ins
REGION_FUNDS = {"AFRICA": "XAF", "AMERICA": "XAM", "ASIA": "XAS", "EUROPE": "XEU", "MIDDLE EAST": "XME"}
ACTIONS = {"1-URGENT": "BUY", "5-LOW": "SELL", "4-NOT SPECIFIED": "HOLD", "3-MEDIUM": "REDUCE"}
CUSTOMERS_PER_SUPPLIER = 15


def symbol_of(key: Column) -> Column:
    return F.concat(F.lit("S"), key.cast("string"))


class Lake:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- prices -----------------------------------------------------------------------------------
    @cached_property
    def bars(self) -> DataFrame:
        li = self.table("lineitem").where("l_quantity > 0")
        price = F.col("l_extendedprice") / F.col("l_quantity")
        # trades of a day follow order, line and part, packed without loss into one number (19 digits each for order and
        # line, and for the part), so that the aggregate hashes and needs no sort
        trade = (F.col("l_orderkey") * 65536 + F.col("l_linenumber")).cast("decimal(19,0)")
        at = (trade * F.lit(str(10**19)).cast("decimal(20,0)") + F.col("l_partkey").cast("decimal(19,0)")).cast("decimal(38,0)")
        trades = li.select("l_suppkey", F.to_date("l_shipdate").alias("date"), price.alias("p"), "l_quantity", at.alias("at"))
        day = trades.groupBy("l_suppkey", "date").agg(
            F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"),
            F.sum("l_quantity").cast("long").alias("volume"),
        )
        return day.select(
            symbol_of(F.col("l_suppkey")).alias("symbol"), "date", "open", "high", "low", "close",
            (F.col("close") * (1 + (F.col("l_suppkey") % 7) * 0.01)).alias("adj_close"), "volume",
        )

    @cached_property
    def bar_table(self) -> DataFrame:
        """The bars as a written table, for plans that read them more than once."""
        return staged(self.bars, "bars")

    @cached_property
    def index_bars(self) -> DataFrame:
        """The market index, symbol SPY: mean close of all symbols per day."""
        return self.bar_table.groupBy("date").agg(F.avg("close").alias("close"), F.avg("adj_close").alias("adj_close")).select(F.lit("SPY").alias("symbol"), "date", "close", "adj_close")

    @cached_property
    def fund_bars(self) -> DataFrame:
        """One fund per region and a second broad index (QQQ: mean daily high)."""
        regional = self.bar_table.join(self.universe.select("symbol", "sector"), "symbol")
        funds = regional.groupBy(lookup(F.col("sector"), REGION_FUNDS).alias("symbol"), "date").agg(F.avg("close").alias("close"), F.avg("adj_close").alias("adj_close"))
        broad = self.bar_table.groupBy("date").agg(F.avg("high").alias("close")).select(F.lit("QQQ").alias("symbol"), "date", "close", F.col("close").alias("adj_close"))
        return funds.unionByName(broad)

    @cached_property
    def splits(self) -> DataFrame:
        s = self.table("supplier")
        symbol = symbol_of(F.col("s_suppkey")).alias("symbol")
        return s.where("s_suppkey % 5 = 0").select(symbol, F.to_date(F.lit("1997-06-02")).alias("date"), F.lit(2.0).alias("ratio")).unionByName(
            s.where("s_suppkey % 7 = 0").select(symbol, F.to_date(F.lit("1999-03-01")).alias("date"), F.lit(3.0).alias("ratio"))
        )

    # --- dimensions -------------------------------------------------------------------------------
    @cached_property
    def universe(self) -> DataFrame:
        places = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        kind = F.when(F.col("s_suppkey") % 10 == 9, "ETF").when(F.col("s_suppkey") % 10 != 8, "EQUITY")
        return self.table("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
            symbol_of(F.col("s_suppkey")).alias("symbol"), kind.alias("quote_type"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"), F.col("s_name").alias("name"),
        )

    @cached_property
    def spells(self) -> DataFrame:
        k = F.col("s_suppkey")
        s = self.table("supplier")
        start = F.date_add(F.to_date(F.lit("1995-01-01")), (k % 5 * 300).cast("int"))
        first = s.select(symbol_of(k).alias("symbol"), start.alias("start"), F.when(k % 3 != 0, F.date_add(start, 1000)).alias("end"))
        second = s.where("s_suppkey % 4 = 1").select(symbol_of(k).alias("symbol"), F.date_add(start, 900).alias("start"), F.date_add(start, 1500).alias("end"))
        return first.unionByName(second)

    # --- filings ----------------------------------------------------------------------------------
    @cached_property
    def facts(self) -> DataFrame:
        li = self.table("lineitem")
        ext, q = F.col("l_extendedprice"), F.col("l_quantity")
        day = F.to_date("l_shipdate")
        quarter = li.groupBy(F.col("l_suppkey").alias("k"), F.year(day).alias("y"), F.quarter(day).alias("q")).agg(
            F.round(F.sum(ext), 2).alias("rev"), F.round(F.sum(ext * (1 - F.col("l_discount"))), 4).alias("gp"),
            F.round(F.sum(ext * F.col("l_tax")), 4).alias("tax"), F.sum(q).alias("qty"),
        )
        flows = quarter.select(
            "k", "y", "q", "rev", "gp", "tax", (F.col("gp") - F.col("qty") * 1500).alias("oi"), (F.col("gp") - F.col("qty") * 1500 - F.col("tax")).alias("ni"),
            (F.col("gp") - F.col("qty") * 1400).alias("ocf"), (F.col("qty") * F.when(F.col("k") % 2 == 0, -50).otherwise(50)).alias("capex"),
        )
        # a fiscal year holds four rows per company
        ytd = Window.partitionBy("k", "y").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
        rows = flows.select("*", *[F.sum(c).over(ytd).alias(f"{c}_ytd") for c in ("rev", "gp", "oi", "ni", "ocf", "capex")])
        first = F.make_date(F.col("y"), F.lit(1), F.lit(1))
        start = F.make_date(F.col("y"), F.col("q") * 3 - 2, F.lit(1))
        end = F.last_day(F.make_date(F.col("y"), F.col("q") * 3, F.lit(1)))
        rows = rows.select("*", first.alias("ys"), start.alias("qs"), end.alias("pe"), F.date_add(end, (30 + F.col("k") % 30).cast("int")).alias("fd"))
        annual, c = F.col("q") == 4, F.col

        def fact(concept, value, begin=None, unit="USD", when=None, amended=False):
            item = F.struct(
                F.lit(concept).alias("concept"), value.cast("double").alias("value"), F.lit(unit).alias("unit"),
                (begin if begin is not None else F.lit(None).cast("date")).alias("period_start"), F.lit(amended).alias("amended"),
            )
            return item if when is None else F.when(when, item)

        contract = "RevenueFromContractWithCustomerExcludingAssessedTax"
        items = [
            fact(contract, c("rev"), c("qs"), when=~annual), fact("Revenues", c("rev") + 1, c("qs"), when=~annual & (c("k") % 3 == 0)),
            fact("GrossProfit", c("gp"), c("qs"), when=~annual), fact("OperatingIncomeLoss", c("oi"), c("qs"), when=~annual),
            fact("NetIncomeLoss", c("ni"), c("qs"), when=~annual), fact("EarningsPerShareDiluted", c("ni") / 1024, c("qs"), "USD/shares", ~annual),
            fact(contract, c("rev_ytd"), c("ys"), when=c("q") > 1), fact("GrossProfit", c("gp_ytd"), c("ys"), when=c("q") > 1),
            fact("OperatingIncomeLoss", c("oi_ytd"), c("ys"), when=c("q") > 1), fact("NetIncomeLoss", c("ni_ytd"), c("ys"), when=c("q") > 1),
            fact("EarningsPerShareDiluted", c("ni_ytd") / 1024, c("ys"), "USD/shares", annual),
            fact("NetCashProvidedByUsedInOperatingActivities", c("ocf_ytd"), c("ys")),
            fact("PaymentsToAcquirePropertyPlantAndEquipment", c("capex_ytd"), c("ys")),
            fact("Assets", c("rev") * 3), fact("Assets", c("rev") * 9, unit="EUR"), fact("Liabilities", c("rev") * (1 + c("k") % 3)),
            fact("StockholdersEquity", c("rev") * (2 - c("k") % 3)), fact("CashAndCashEquivalentsAtCarryingValue", c("gp") * 0.4, when=(c("k") + c("q")) % 4 != 0),
            fact("CommonStockSharesOutstanding", c("k") + 1000, unit="shares"), fact("Goodwill", c("gp")),
            fact("LongTermDebt", c("tax") * 10, when=c("k") % 2 == 0), fact("LongTermDebtNoncurrent", c("tax") * 11),
            fact(contract, c("rev_ytd") * 0.99, c("ys"), when=annual & (c("k") % 4 == 0), amended=True),
            fact("NetIncomeLoss", c("ni_ytd") * 0.8, c("ys"), when=annual & (c("k") % 4 == 0), amended=True),
        ]
        long = rows.select("k", "y", "q", "pe", "fd", F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("f")).select("k", "y", "q", "pe", "fd", "f.*")
        am = F.col("amended")
        income = F.col("concept").isin("Revenues", contract, "GrossProfit", "OperatingIncomeLoss", "NetIncomeLoss", "EarningsPerShareDiluted")
        return long.select(
            symbol_of(F.col("k")).alias("symbol"), "concept", "value", "unit", "period_start", F.col("pe").alias("period_end"),
            F.concat(F.when(F.col("q") == 4, "10-K").otherwise("10-Q"), F.when(am, "/A").otherwise("")).alias("form"),
            F.when(am, F.date_add("fd", 45)).otherwise(F.col("fd")).alias("filed_at"),
            F.concat(symbol_of(F.col("k")), F.lit("-"), F.col("y").cast("string"), F.lit("Q"), F.col("q").cast("string"), F.when(am, "A").otherwise("")).alias("accession_no"),
            F.when(income, 0).otherwise(1).alias("source_rank"),
        )

    # --- recommendations --------------------------------------------------------------------------
    @cached_property
    def calls(self) -> DataFrame:
        """Orders that carry an action, with the symbol they are about."""
        return self.table("orders").select(
            "o_orderkey", F.floor(F.col("o_custkey") / CUSTOMERS_PER_SUPPLIER).cast("long").alias("k"), F.to_date("o_orderdate").alias("day"),
            lookup(F.col("o_orderpriority"), ACTIONS).alias("action"), "o_orderstatus", "o_totalprice",
        ).where("action is not null")

    @cached_property
    def raw_list(self) -> DataFrame:
        """The published list as its text file would hold it."""
        c = self.calls.where("o_orderstatus in ('O', 'P')")
        return c.select(
            F.date_format("day", "MM/dd/yy").alias("date"), F.concat(F.lit(" s"), F.col("k").cast("string"), F.lit(" ")).alias("symbol"),
            F.concat(F.lit(" Company "), F.col("k").cast("string")).alias("name"), F.concat(F.lower("action"), F.lit(" ")).alias("recommendation"),
        )

    @cached_property
    def raw_sheet(self) -> DataFrame:
        """The picks sheet as its text export would hold it."""
        c = self.calls.where("o_orderstatus in ('F', 'P') and action = 'BUY'")
        k, o = F.col("k"), F.col("o_orderkey")
        closed = F.when(o % 4 == 0, F.concat(F.lit(" (Closed: "), F.date_format(F.date_add("day", 200), "MM/dd/yyyy"), F.lit(")"))).otherwise("")
        million = F.concat(F.lit("$"), F.floor(F.col("o_totalprice")).cast("long").cast("string"), F.lit("M"))
        return c.select(
            F.col("day").alias("rec_date"),
            F.concat(F.lit("Company "), k.cast("string"), closed, F.when(o % 6 == 0, " Corporate Action Details").otherwise("")).alias("company"),
            F.concat(F.lit(" S"), k.cast("string"), F.when(k % 11 == 0, ".DL1").otherwise(""), F.when(o % 5 == 0, " old").otherwise("")).alias("ticker"),
            F.when(o % 9 == 0, "n/a").otherwise(million).alias("market_cap"),
            F.when(o % 2 == 0, "David").otherwise("Tom").alias("team"), F.when(o % 2 == 0, (o % 25).cast("double")).alias("risk_rating"),
            F.when(o % 8 == 0, "unavailable").otherwise((o % 300 + 1).cast("string")).alias("rec_price"),
            F.when(o % 7 != 0, (o % 1000).cast("double") / 500 - 0.5).alias("return"),
            F.when(o % 7 != 0, (o % 100).cast("double") / 1000).alias("spx_return"),
            F.when(o % 7 != 0, (o % 1000).cast("double") / 500 - 0.5 - (o % 100).cast("double") / 1000).alias("excess_return"),
        )

    # --- intraday, news ---------------------------------------------------------------------------
    @cached_property
    def ticks(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1).cast("long").alias("volume"), "event_id")

    @cached_property
    def raw_news(self) -> DataFrame:
        """Provider headlines: a tag, escaped entities, text; every ninth is empty behind its tag."""
        d = self.table("documents")
        i = F.col("doc_id")
        score = (i % 200 - 100).cast("double") / 100
        tag = F.concat(F.lit("{A:"), i.cast("string"), F.when(i % 3 != 0, F.concat(F.lit(":K:"), score.cast("decimal(4,2)").cast("string"))).otherwise(""), F.lit(":C:0.9}"), F.when(i % 2 == 0, "!").otherwise(""))
        word = F.when(i % 5 == 0, "Upgraded &amp; raised: ").when(i % 5 == 1, "downgraded &lt;cut&gt;: ").when(i % 5 == 2, "Initiated: ").otherwise("")
        day = F.date_add(F.to_date(F.lit("2024-01-01")), (i % 366).cast("int"))
        return d.select(
            F.upper("source").alias("symbol"), day.alias("date"), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T12:00:00Z")).alias("published_at"), i.alias("item_id"),
            F.concat(tag, F.when(i % 9 == 0, "  ").otherwise(F.concat(word, F.col("text")))).alias("headline"),
        )
