"""Text inputs: membership and recommendation lists, the picks sheet, news tags, company-facts and
submissions JSON, research replies."""
from __future__ import annotations

import html
import html.entities
import json as json_module

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.scalar import lookup, parse_market_cap

# fixed values: symbols the list spells wrongly
SYMBOL_FIXES = {"LIONS": "LGF.A"}
# fixed values: patterns of the picks sheet and of news tags
CLOSED = r"\s*\(Closed:\s*(\d{2}/\d{2}/\d{4})\)"
CORPORATE_ACTION = r"\s*Corporate Action Details$"
DELISTED = r"\.DL\d?$"
NEWS_TAG = r"^\{[^}]*\}!?"
NEWS_SENTIMENT = r"K:(-?\d+(?:\.\d+)?)"
FORMS = ["10-K", "10-K/A", "10-Q", "10-Q/A"]
NOTE_FIELDS = ["thesis", "bull_case", "bear_case", "risks", "contradictions"]


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def read_membership_csv(spark: SparkSession, path: str) -> DataFrame:
    """ticker,start_date,end_date -> spells; a blank end date is an open spell."""
    raw = spark.read.schema("ticker string, start_date string, end_date string").option("header", True).csv(path)
    return membership_rows(raw)


def membership_rows(raw: DataFrame) -> DataFrame:
    day = lambda c: F.try_to_date(blank_to_null(F.trim(F.col(c))), "yyyy-MM-dd")
    return raw.select(F.col("ticker").alias("symbol"), day("start_date").alias("start"), day("end_date").alias("end"))


def read_list_csv(spark: SparkSession, path: str) -> DataFrame:
    return clean_list(spark.read.schema("date string, symbol string, name string, recommendation string").option("header", True).csv(path))


def two_digit_date(text: Column) -> Column:
    """MM/dd/yy with the POSIX pivot: 69-99 are the 1900s (Spark alone reads every year as 20yy)."""
    day = F.to_date(text, "MM/dd/yy")
    return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)


def clean_list(raw: DataFrame) -> DataFrame:
    """Recommendation list: month/day/two-digit-year dates, trimmed upper-case codes, fixed symbols, one
    row per (date, symbol, recommendation)."""
    symbol = F.upper(F.trim("symbol"))
    clean = raw.select(
        two_digit_date(F.col("date")).alias("date"), F.coalesce(lookup(symbol, SYMBOL_FIXES), symbol).alias("symbol"),
        F.trim("name").alias("name"), F.upper(F.trim("recommendation")).alias("recommendation"),
    )
    return clean.groupBy("date", "symbol", "recommendation").agg(F.min("name").alias("name")).select("date", "symbol", "name", "recommendation")


def clean_sheet(raw: DataFrame) -> DataFrame:
    """Picks sheet: closing date out of the company name, suffixes stripped, first token of the ticker,
    delisting mark, market cap in units, price NULL where it is not a number."""
    ticker = F.trim("ticker")
    closed = blank_to_null(F.regexp_extract("company", CLOSED, 1))
    company = F.trim(F.regexp_replace(F.regexp_replace("company", CLOSED, ""), CORPORATE_ACTION, ""))
    price = F.col("rec_price").try_cast("double")
    return raw.select(
        F.to_date("rec_date").alias("rec_date"), company.alias("company"), ticker.alias("ticker_raw"),
        F.regexp_replace(F.element_at(F.split(ticker, r"\s+"), 1), DELISTED, "").alias("ticker"), ticker.rlike(DELISTED).alias("delisted"),
        F.to_date(closed, "MM/dd/yyyy").alias("closed_date"), parse_market_cap(F.col("market_cap")).alias("market_cap"), "team", "risk_rating",
        price.alias("rec_price"), "return", "spx_return", "excess_return", price.isNull().alias("price_unavailable"),
    )


def _entity_table() -> dict[str, str]:
    """Named entities of the HTML standard (without the closing mark) and the numbers that do not stand for their own
    code point, both as Python's html module knows them."""
    named = {n.removesuffix(";"): c for n, c in html.entities.html5.items() if n.endswith(";")}
    odd = {f"#{n}": html.unescape(f"&#{n};") for n in range(160) if html.unescape(f"&#{n};") != chr(n)}
    return named | odd


# names that older pages write without the closing mark, longest first
_OPEN_NAMES = "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


def unescape(text: Column, open_names: bool = True) -> Column:
    """HTML entities decoded, named and numeric, by expressions alone. Text is cut at each ampersand, so nothing is
    decoded twice; a text without one is left as it is. Without `open_names`, names that lack the closing mark stay."""
    table = F.from_json(F.lit(json_module.dumps(_entity_table())), F.lit("map<string,string>"))

    def point(number: Column) -> Column:
        sound = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        return F.when(sound, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\uFFFD")

    def one(part: Column) -> Column:
        decimal, hexa = F.regexp_extract(part, r"^#([0-9]+);?", 1), F.regexp_extract(part, r"^#[xX]([0-9a-fA-F]+);?", 1)
        number = F.when(decimal != "", F.when(F.length(decimal) < 10, decimal.cast("long")).otherwise(-1)).when(hexa != "", F.when(F.length(hexa) < 9, F.conv(hexa, 16, 10).cast("long")).otherwise(-1))
        name = F.regexp_extract(part, "^([A-Za-z][A-Za-z0-9]{0,31});", 1)
        old = F.regexp_extract(part, f"^({_OPEN_NAMES})", 1) if open_names else F.lit("")
        rest = lambda n: F.substring(part, n + 1, F.length(part))
        return (
            F.when(number.isNotNull(), F.concat(F.coalesce(F.try_element_at(table, F.concat(F.lit("#"), number.cast("string"))), point(number)), F.regexp_replace(part, "^#([0-9]+|[xX][0-9a-fA-F]+);?", "")))
            .when((name != "") & F.try_element_at(table, name).isNotNull(), F.concat(F.try_element_at(table, name), rest(F.length(name) + 1)))
            .when(old != "", F.concat(F.try_element_at(table, old), rest(F.length(old))))
            .otherwise(F.concat(F.lit("&"), part))
        )

    cut = F.split(text, "&")
    decoded = F.concat(F.get(cut, F.lit(0)), F.array_join(F.transform(F.slice(cut, F.lit(2), F.size(cut)), one), ""))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def clean_news(news: DataFrame, full_entities: bool = True) -> DataFrame:
    """Splits the provider tag off: sentiment to a number (NULL when none was given), text unescaped and trimmed of
    all Unicode blanks, empty headlines dropped. Every entity is decoded; `full_entities` is kept for callers."""
    sentiment = blank_to_null(F.regexp_extract("headline", NEWS_SENTIMENT, 1)).cast("double")
    text = F.regexp_replace(unescape(F.regexp_replace("headline", NEWS_TAG, "")), r"(?U)^\s+|\s+$", "")
    return news.select(*[c for c in news.columns if c != "headline"], text.alias("headline"), sentiment.alias("sentiment")).where("headline <> ''")


_ENTRY = "array<struct<val: double, start: string, end: string, form: string, filed: string, accn: string>>"
FACTS_JSON = f"struct<facts: struct<`us-gaap`: map<string, struct<units: map<string, {_ENTRY}>>>>>"


def extract_facts(docs: DataFrame, concepts: list[str], json: str = "json") -> DataFrame:
    """Company-facts documents (symbol, json) -> long facts of the mapped concepts and annual/quarterly forms."""
    parsed = docs.select("symbol", F.from_json(json, FACTS_JSON).alias("d"))
    by_concept = parsed.select("symbol", F.explode("d.facts.us-gaap").alias("concept", "c")).where(F.col("concept").isin(concepts))
    by_unit = by_concept.select("symbol", "concept", F.explode("c.units").alias("unit", "entries"))
    rows = by_unit.select("symbol", "concept", "unit", F.explode("entries").alias("e")).where(F.col("e.form").isin(FORMS))
    return rows.select(
        "symbol", "concept", F.col("e.val").alias("value"), "unit", F.to_date("e.start").alias("period_start"), F.to_date("e.end").alias("period_end"),
        F.col("e.form").alias("form"), F.to_date("e.filed").alias("filed_at"), F.col("e.accn").alias("accession_no"),
    )


def latest_filings(submissions: DataFrame, forms: tuple[str, ...] = ("10-K", "10-Q")) -> DataFrame:
    """(symbol, form[], accn[], filed[], doc[]) with the newest first -> first entry of each kept form.
    The arrays belong to one row, so nothing is shuffled."""
    zipped = F.arrays_zip("form", "accn", "filed", "doc")
    first = lambda f: F.try_element_at(F.filter(zipped, lambda x: x["form"] == f), F.lit(1))
    rows = submissions.select("symbol", F.explode(F.array(*[first(f) for f in forms])).alias("x")).where("x is not null")
    return rows.select("symbol", "x.form", "x.accn", F.to_date("x.filed").alias("filed"), "x.doc")


def parse_note(replies: DataFrame, text: str = "raw") -> DataFrame:
    """Model replies -> five fields from the outermost JSON object, NULL when there is none; text kept."""
    body = blank_to_null(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    parsed = F.from_json(body, ", ".join(f"{f} string" for f in NOTE_FIELDS))
    return replies.select(*replies.columns, *[parsed[f].alias(f) for f in NOTE_FIELDS])
