"""News, filings, retrieval, questions, conversations."""
from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import grounding as gr, lists as ls, scoring as sc, text as tx
from tidemark.plans.cte import define
from tidemark.plans.learning import walk
from tidemark.plans.market import price_panel, price_scores
from tidemark.plans.registry import query, rounded
from tidemark.plans.standins import Lake
from tidemark.session import scratch_root
from tidemark.sources import datasets as ds, lake as lk, text_files as tf
from tidemark.staging import staged

# every entity that the tables hold, the ampersand last so that nothing is decoded twice
_UNESCAPE = "{x}"
for _e, _c in (("&lt;", "60"), ("&gt;", "62"), ("&quot;", "34"), ("&#39;", "39"), ("&apos;", "39"), ("&nbsp;", "160"), ("&#160;", "160"), ("&copy;", "169"), ("&middot;", "183"), ("&#8217;", "8217"), ("&mdash;", "8212"), ("&amp;", "38")):
    _UNESCAPE = f"replace({_UNESCAPE}, '{_e}', chr({_c}))"
_BLANK = "[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
define("news", f"""
SELECT * FROM (SELECT symbol, date, published_at, item_id, regexp_replace({_UNESCAPE.format(x="regexp_replace(headline, '^[{][^}]*[}]!?', '')")}, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS headline,
 CAST(nullif(regexp_extract(headline, 'K:(-?[0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS sentiment FROM raw_news) WHERE headline <> ''
""")


@query("S4 P1", "SELECT symbol, published_at, item_id, headline, sentiment FROM news")
def clean_news(lake: Lake) -> DataFrame:
    return tf.clean_news(lake.raw_news).select("symbol", "published_at", "item_id", "headline", "sentiment")


@query("P1 full entity set", "SELECT symbol, published_at, item_id, headline, sentiment FROM news")
def clean_news_all_entities(lake: Lake) -> DataFrame:
    return tf.clean_news(lake.raw_news).select("symbol", "published_at", "item_id", "headline", "sentiment")


@query("S3", "SELECT symbol, item_id, date FROM news WHERE date IN (SELECT DISTINCT date FROM raw_news ORDER BY date DESC LIMIT 30)")
def recent_news(lake: Lake) -> DataFrame:
    return tf.clean_news(lk.latest_partitions(lake.raw_news, 30)).select("symbol", "item_id", "date")


@query("S1", "SELECT symbol, item_id FROM news WHERE symbol = 'SRC7'")
def news_of_symbol(lake: Lake) -> DataFrame:
    return lk.read_symbol(tf.clean_news(lake.raw_news), "SRC7").select("symbol", "item_id")


def _news_lake(lake: Lake) -> str:
    """Raw headlines as a dataset with a folder per date."""
    path = f"{scratch_root(lake.spark)}/lake-{uuid.uuid4().hex}/news"
    rows = lake.raw_news.select("symbol", "published_at", "item_id", "headline", "date")
    rows.repartition("date").write.partitionBy("date").parquet(path)
    return path


@query("S1 path", "SELECT symbol, date, open, close, volume FROM bars WHERE symbol IN ('S7', 'S11') AND date BETWEEN DATE '1996-01-01' AND DATE '1998-06-30'")
def bars_of_symbols(lake: Lake) -> DataFrame:
    """Two symbols' bars of a span of dates, from a dataset with a folder per symbol."""
    path = f"{scratch_root(lake.spark)}/lake-{uuid.uuid4().hex}/bars"
    bars = lake.bars.select("symbol", "date", "open", "close", "volume")
    bars.repartition("symbol").sortWithinPartitions("date").write.partitionBy("symbol").parquet(path)
    return ds.read_dataset(lake.spark, path, bars.schema, symbols=["S7", "S11"], start=date(1996, 1, 1), end=date(1998, 6, 30))


@query("S3 path", "SELECT symbol, item_id, published_at, headline, sentiment FROM news WHERE symbol = 'SRC7' AND date IN (SELECT DISTINCT date FROM raw_news WHERE date <= DATE '2024-11-30' ORDER BY date DESC LIMIT 30)")
def recent_news_of_symbol(lake: Lake) -> DataFrame:
    return ds.read_news(lake.spark, _news_lake(lake), "SRC7", 30, date(2024, 11, 30)).select("symbol", "item_id", "published_at", "headline", "sentiment")


@query("S4 path", "SELECT symbol, item_id, published_at, sentiment FROM news")
def all_news(lake: Lake) -> DataFrame:
    return ds.read_all_news(lake.spark, _news_lake(lake)).select("symbol", "item_id", "published_at", "sentiment")


@query("S2", "SELECT DISTINCT symbol FROM raw_news")
def news_symbols(lake: Lake) -> DataFrame:
    return lk.list_symbols(lake.raw_news)


@query("A23", """
SELECT symbol, count(*) FILTER (recent AND contains(lower(headline), 'upgraded')) AS upgrades, count(*) FILTER (recent AND contains(lower(headline), 'downgraded')) AS downgrades, count(*) FILTER (recent AND contains(lower(headline), 'initiated')) AS initiations
FROM (SELECT *, CAST(replace(replace(published_at, 'T', ' '), 'Z', '') AS TIMESTAMP) >= TIMESTAMP '2024-12-31 00:00:00' - INTERVAL 180 DAY AS recent FROM news) GROUP BY 1
""")
def headline_actions(lake: Lake) -> DataFrame:
    return tx.action_counts(tf.clean_news(lake.raw_news), F.to_timestamp(F.lit("2024-12-31 00:00:00")))


@query("K7", "SELECT symbol, item_id, rank FROM (SELECT symbol, item_id, row_number() OVER (PARTITION BY symbol ORDER BY published_at DESC, item_id DESC) AS rank FROM news) WHERE rank <= 8")
def newest_headlines(lake: Lake) -> DataFrame:
    return tx.newest_headlines(tf.clean_news(lake.raw_news)).select("symbol", "item_id", F.col("rank").cast("long").alias("rank"))


# --- filings ---------------------------------------------------------------------------------------
_HIDE = "html"
for _p, _f in ((r"<!--.*?-->", "gis"), (r"<script\b.*?</script\s*>", "gis"), (r"<style\b.*?</style\s*>", "gis"), (r"<ix:header\b.*?</ix:header\s*>", "gis")):
    _HIDE = f"regexp_replace({_HIDE}, '{_p}', '', '{_f}')"
_HIDE = f"regexp_replace({_HIDE}, '</({tx.BLOCK_TAGS})\\s*>|<br\\b[^>]*>', chr(10), 'gi')"
_HIDE = f"regexp_replace({_HIDE}, '</(td|th)\\s*>', ' ', 'gi')"
_HIDE = _UNESCAPE.format(x=f"regexp_replace({_HIDE}, '<[^>]*>', '', 'g')")


@query("X1", f"""
SELECT page_id, line_no, line FROM (SELECT page_id, CAST(generate_subscripts(l, 1) AS BIGINT) - 1 AS line_no, unnest(l) AS line FROM (
 SELECT page_id, list_filter(list_transform(string_split({_HIDE}, chr(10)), lambda x: trim(regexp_replace(x, '{_BLANK}+', ' ', 'g'))), lambda x: x <> '') AS l FROM pages))
""")
def page_lines(lake: Lake) -> DataFrame:
    lines = lake.table("pages").select("page_id", F.posexplode(tx.document_lines(F.col("html"))).alias("line_no", "line"))
    return lines.select("page_id", F.col("line_no").cast("long").alias("line_no"), "line")


# fixed values of the stand-in: section names put in front of every sixth line
_ITEMS = ["1", "1A", "7", "7A", "8", "2"]
define("filing_lines", f"""
SELECT doc_id, form, list_filter(flatten(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 6 = 0 THEN ['Item ' || {_ITEMS}[1 + (i - 1) // 6 % 6] || '. Section', x] ELSE [x] END)), lambda x: x <> '') AS lines
FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN '10-K' ELSE '10-Q' END AS form FROM documents)
""")


def filings(lake: Lake) -> DataFrame:
    d = lake.table("documents")
    items = F.array(*[F.lit(i) for i in _ITEMS])
    head = lambda i: F.concat(F.lit("Item "), F.element_at(items, (F.floor(i / 6) % 6 + 1).cast("int")), F.lit(". Section"))
    lines = F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 6 == 0, F.array(head(i), x)).otherwise(F.array(x))))
    return d.select(
        F.upper("source").alias("symbol"), F.col("doc_id").cast("string").alias("accn"), F.when(F.col("doc_id") % 2 == 0, "10-K").otherwise("10-Q").alias("form"),
        F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 366).cast("int")).alias("filed"), F.filter(lines, lambda x: x != "").alias("lines"),
    )


_CHUNK_SQL = """
WITH RECURSIVE doc_lines AS MATERIALIZED (SELECT doc_id, form, CAST(generate_subscripts(lines, 1) AS BIGINT) AS i, unnest(lines) AS line FROM filing_lines),
marked AS MATERIALIZED (SELECT *, length(line) AS n, CASE WHEN length(line) <= 150 THEN nullif(upper(regexp_extract(line, '^item\\s*([0-9]{1,2}[AB]?)\\b\\.?', 1, 'i')), '') END AS head FROM doc_lines),
walk AS (
 SELECT doc_id, CAST(0 AS BIGINT) AS i, NULL::VARCHAR AS item, CAST(1 AS BIGINT) AS start, CAST(0 AS BIGINT) AS size, NULL::VARCHAR AS cut_item, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM filing_lines
 UNION ALL
 SELECT doc_id, i, item, CASE WHEN full_now THEN i + 1 ELSE start END, CASE WHEN full_now THEN 0 ELSE size END, CASE WHEN flush THEN old_item WHEN full_now THEN item END, CASE WHEN flush THEN old_start WHEN full_now THEN start END, CASE WHEN flush THEN i WHEN full_now THEN i + 1 END FROM (
  SELECT *, size >= 1500 AS full_now FROM (SELECT w.doc_id, m.i, coalesce(m.head, w.item) AS item, w.item AS old_item, w.start AS old_start, CASE WHEN m.head IS NOT NULL THEN m.i ELSE w.start END AS start, CASE WHEN m.head IS NOT NULL THEN 0 ELSE w.size END + m.n AS size,
   m.head IS NOT NULL AND m.i > w.start AS flush FROM walk w JOIN marked m ON m.doc_id = w.doc_id AND m.i = w.i + 1))),
cuts AS (SELECT doc_id, cut_item AS item, a, b FROM walk WHERE a IS NOT NULL UNION ALL SELECT w.doc_id, w.item, w.start, w.i + 1 FROM walk w JOIN (SELECT doc_id, max(i) AS i FROM walk GROUP BY 1) USING (doc_id, i) WHERE w.start <= w.i),
texts AS (SELECT c.doc_id, any_value(m.form) AS form, c.item, c.a, string_agg(m.line, ' ' ORDER BY m.i) AS text FROM cuts c JOIN marked m ON m.doc_id = c.doc_id AND m.i >= c.a AND m.i < c.b GROUP BY c.doc_id, c.item, c.a)
SELECT CAST(doc_id AS VARCHAR) AS accn, item, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS chunk, text FROM texts
WHERE length(text) >= 200 AND ((form = '10-K' AND item IN ('1', '1A', '7', '7A')) OR (form = '10-Q' AND item IN ('2', '1A')))
"""


@query("X2 X3", _CHUNK_SQL)
def filing_chunks(lake: Lake) -> DataFrame:
    return tx.chunk_filings(filings(lake)).select("accn", "item", F.col("chunk").cast("long").alias("chunk"), "text")


# fixed values: the stop words of these checks
STOP = ["the", "and", "of", "to", "in", "is", "that", "for", "on", "with", "by", "an", "as", "at", "le", "la", "les", "der", "die", "das", "und"]


def _tokens_sql(x: str) -> str:
    words = f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: NOT list_contains({STOP}, w))"
    return (f"list_transform({words}, lambda w: CASE WHEN length(w) > 3 AND w LIKE '%ies' THEN w[1:length(w) - 3] || 'y' WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[1:length(w) - 1] ELSE w END)")


@query("X4", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens_sql('text')}) AS term FROM documents) GROUP BY 1, 2")
def word_counts(lake: Lake) -> DataFrame:
    terms = lake.table("documents").select("doc_id", F.explode(tx.tokens(F.col("text"), STOP)).alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


define("doc_terms", f"SELECT upper(source) AS symbol, doc_id, term, count(*) AS tf FROM (SELECT source, doc_id, unnest({_tokens_sql('text')}) AS term FROM documents) GROUP BY 1, 2, 3")
define("term_idf", """
SELECT symbol, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT symbol, term, count(*) AS df FROM doc_terms GROUP BY 1, 2) JOIN (SELECT upper(source) AS symbol, count(*) AS n FROM documents GROUP BY 1) USING (symbol)
""")
define("query_terms", f"SELECT symbol, item_id, term, (1 + ln(count(*))) * any_value(idf) AS q FROM (SELECT 'SRC' || item_id % 20 AS symbol, item_id, unnest({_tokens_sql('text')}) AS term FROM benchmark) JOIN term_idf USING (symbol, term) GROUP BY 1, 2, 3")


@query("X5", """
SELECT query_id, symbol, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
 SELECT q.item_id AS query_id, d.symbol, d.doc_id AS chunk_id, sum((1 + ln(d.tf)) * i.idf * q.q) / (any_value(n.norm) * any_value(qn.norm)) AS score
 FROM query_terms q JOIN doc_terms d USING (symbol, term) JOIN term_idf i USING (symbol, term)
 JOIN (SELECT doc_id, sqrt(sum(((1 + ln(tf)) * idf) ** 2)) AS norm FROM doc_terms JOIN term_idf USING (symbol, term) GROUP BY 1) n ON n.doc_id = d.doc_id
 JOIN (SELECT item_id, sqrt(sum(q * q)) AS norm FROM query_terms GROUP BY 1) qn ON qn.item_id = q.item_id GROUP BY 1, 2, 3)) WHERE rank <= 3
""")
def passage_retrieval(lake: Lake) -> DataFrame:
    chunks = lake.table("documents").select(F.upper("source").alias("symbol"), F.col("doc_id").alias("chunk_id"), "text")
    b = lake.table("benchmark")
    asked = b.select(F.concat(F.lit("SRC"), (F.col("item_id") % 20).cast("string")).alias("symbol"), F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    out = tx.retrieve(chunks, asked, stop_words=STOP)
    return rounded(out.withColumn("rank", F.col("rank").cast("long")))


# --- questions -------------------------------------------------------------------------------------
define("questions", "SELECT conv_id * 1000 + turn AS question_id, upper(regexp_replace(text, '[^ -~]', ' ', 'g')) AS question, text FROM conversations WHERE role = 'user'")
define("known_words", "SELECT DISTINCT symbol FROM (SELECT unnest(regexp_extract_all(upper(regexp_replace(text, '[^ -~]', ' ', 'g')), '[A-Z]+')) AS symbol FROM benchmark) WHERE length(symbol) BETWEEN 3 AND 5")


def questions(lake: Lake) -> DataFrame:
    c = lake.table("conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.upper(F.regexp_replace("text", "[^ -~]", " ")).alias("question"), "text")


def known_words(lake: Lake) -> DataFrame:
    words = lake.table("benchmark").select(F.explode(F.regexp_extract_all(F.upper(F.regexp_replace("text", "[^ -~]", " ")), F.lit("[A-Z]+"), F.lit(0))).alias("symbol"))
    return words.where("length(symbol) between 3 and 5").distinct()


@query("X6", """
SELECT question_id, symbol, mention FROM (SELECT question_id, symbol, row_number() OVER (PARTITION BY question_id ORDER BY pos) AS mention FROM (
 SELECT question_id, symbol, min(pos) AS pos FROM (SELECT question_id, generate_subscripts(m, 1) AS pos, unnest(m) AS symbol FROM (SELECT question_id, regexp_extract_all(question, '\\b([A-Z]{1,5}(?:[.-][A-Z])?)\\b', 1) AS m FROM questions))
 WHERE symbol IN (SELECT symbol FROM known_words) GROUP BY 1, 2)) WHERE mention <= 3
""")
def symbol_mentions(lake: Lake) -> DataFrame:
    return tx.mentions(questions(lake), known_words(lake)).select("question_id", "symbol", F.col("mention").cast("long").alias("mention"))


# fixed values: category words of this check, in order of precedence
_WORDS = {"reti": "quality", "that": "growth", "the": "value", "le": "momentum", "die": "risk"}


@query("X7", """
SELECT question_id, CASE WHEN regexp_matches(q, '\\breti\\b') THEN 'quality' WHEN regexp_matches(q, '\\bthat\\b') THEN 'growth' WHEN regexp_matches(q, '\\bthe\\b') THEN 'value' WHEN regexp_matches(q, '\\ble\\b') THEN 'momentum' WHEN regexp_matches(q, '\\bdie\\b') THEN 'risk' ELSE 'total' END AS category
FROM (SELECT question_id, lower(question) AS q FROM questions)
""")
def question_categories(lake: Lake) -> DataFrame:
    return questions(lake).select("question_id", tx.find_category(F.col("question"), _WORDS).alias("category"))


@query("X13", "SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS question, starts_with(coalesce(arg_max(text, turn) FILTER (role = 'user'), ''), '### Task:') AS passed_through FROM conversations GROUP BY 1")
def last_user_message(lake: Lake) -> DataFrame:
    return tx.last_user_message(lake.table("conversations"))


@query("X14", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'T' || doc_id END AS thesis, CASE WHEN doc_id % 3 = 0 THEN '2' END AS bull_case, NULL::VARCHAR AS bear_case, CASE WHEN doc_id % 3 = 0 THEN source END AS risks, NULL::VARCHAR AS contradictions, length(replies.raw) AS raw_chars
FROM (SELECT doc_id, source, replace(replace(text, '{', ''), '}', '') || CASE doc_id % 3 WHEN 0 THEN '```{"thesis": "T' || doc_id || '", "bull_case": 2, "risks": "' || source || '"}``` done' WHEN 1 THEN ' {broken' ELSE '' END AS raw FROM documents) replies
""")
def note_fields(lake: Lake) -> DataFrame:
    d, i = lake.table("documents"), F.col("doc_id")
    body = F.regexp_replace("text", "[{}]", "")
    json = F.concat(F.lit('```{"thesis": "T'), i.cast("string"), F.lit('", "bull_case": 2, "risks": "'), F.col("source"), F.lit('"}``` done'))
    raw = F.concat(body, F.when(i % 3 == 0, json).when(i % 3 == 1, " {broken").otherwise(""))
    out = tf.parse_note(d.select("doc_id", raw.alias("raw")))
    return out.select("doc_id", *tf.NOTE_FIELDS, F.length("raw").cast("long").alias("raw_chars"))


# --- grounding -------------------------------------------------------------------------------------
@query("X12", """
WITH ask AS (SELECT conv_id AS question_id, arg_max(text, turn) FILTER (role = 'user') AS text FROM conversations GROUP BY 1),
named AS (SELECT question_id, symbol, row_number() OVER (PARTITION BY question_id ORDER BY pos) AS mention FROM (SELECT question_id, symbol, min(pos) AS pos FROM (
  SELECT question_id, generate_subscripts(m, 1) AS pos, unnest(m) AS symbol FROM (SELECT question_id, regexp_extract_all(upper(regexp_replace(text, '[^ -~]', ' ', 'g')), '\\b([A-Z]{1,5}(?:[.-][A-Z])?)\\b', 1) AS m FROM ask))
  WHERE symbol IN (SELECT symbol FROM known_words) GROUP BY 1, 2) QUALIFY mention <= 3),
latest AS (SELECT symbol, max(as_of) AS as_of, arg_max(total, as_of) AS total FROM price_scores GROUP BY 1)
SELECT a.question_id, CASE WHEN n.symbol IS NULL THEN 'ranking' ELSE 'symbol' END AS route, n.symbol, s.as_of, round(s.total, 6) AS total, CASE WHEN n.symbol IS NOT NULL THEN CAST(ceil(4.0 / count(n.symbol) OVER (PARTITION BY a.question_id)) AS BIGINT) END AS excerpts
FROM ask a LEFT JOIN named n USING (question_id) LEFT JOIN latest s ON s.symbol = 'S' || (length(n.symbol) * 7 + mention)
""")
def question_context(lake: Lake) -> DataFrame:
    """One row per question and named symbol with its latest score and excerpt budget, or one ranking row."""
    last = tx.last_user_message(lake.table("conversations")).select(F.col("conv_id").alias("question_id"), F.col("question").alias("text"))
    asked = last.withColumn("question", F.upper(F.regexp_replace("text", "[^ -~]", " ")))
    named = tx.mentions(asked, known_words(lake))
    scored = ls.latest_per_symbol(price_scores(lake)).select(F.col("symbol").alias("_s"), "as_of", "total")
    from pyspark.sql import Window

    per = F.count("symbol").over(Window.partitionBy("question_id"))  # at most three names per question
    out = asked.select("question_id").join(named, "question_id", "left").withColumn("excerpts", F.when(F.col("symbol").isNotNull(), F.ceil(F.lit(4.0) / per).cast("long")))
    stand_in = F.concat(F.lit("S"), (F.length("symbol") * 7 + F.col("mention")).cast("string"))
    out = out.withColumn("_key", stand_in).join(scored, F.col("_key") == F.col("_s"), "left")
    return rounded(out.select("question_id", F.when(F.col("symbol").isNull(), "ranking").otherwise("symbol").alias("route"), "symbol", "as_of", "total", "excerpts"))


@query("X12 full")
def grounded_questions(lake: Lake) -> DataFrame:
    """The whole grounding row per question: two questions in three name the supplier of their own number."""
    # numbers become capital-letter symbols, Z then the number in base 26 letters
    code = lambda n: F.concat(F.lit("Z"), F.translate(F.upper(F.conv(n.cast("string"), 10, 26)), "0123456789ABCDEFGHIJKLMNOP", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    last = tx.last_user_message(lake.table("conversations")).where("question <> ''")
    asked = last.select(F.col("conv_id").alias("question_id"), F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("About "), code(F.col("conv_id")), F.lit(": "), F.lower("question"))).otherwise(F.col("question")).alias("question"))
    of_source = code(F.regexp_extract("symbol", r"(\d+)$", 1))
    of_supplier = lambda d: d.withColumn("symbol", code(F.substring("symbol", 2, 20)))
    panel = staged(price_panel(lake).drop("close"), "metrics")
    news = tf.clean_news(lake.raw_news).withColumn("symbol", of_source)
    chunks = lake.table("documents").select(F.col("source").alias("symbol"), F.col("doc_id").alias("chunk_id"), "text").withColumn("symbol", of_source)
    model = of_supplier(walk(lake, panel).predictions)
    out = gr.ground(asked, of_supplier(sc.score(panel)), of_supplier(panel), chunks, staged(news, "news"), F.to_timestamp(F.lit("2024-12-31 00:00:00")), stop_words=STOP, ml_scores=model)
    return out.select("question_id", "route", "symbol", "category", F.size("excerpt_texts").alias("excerpts"), F.size("headlines").alias("headlines"), F.size("ranking").alias("ranked"), "upgrades", "scores.total")

