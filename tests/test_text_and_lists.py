import math
import random

import pytest
from helpers import approx, d, rows
from pyspark.sql import functions as F

from tidemark.operators import lists as ls, text as tx
from tidemark.sources import text_files as tf


def lines_to_chunks(spark, lines, form="10-K", min_chars=0):
    df = spark.createDataFrame([("A", "x", form, d("2024-01-01"), lines)], "symbol string, accn string, form string, filed date, lines array<string>")
    return [(r["item"], r["text"]) for r in tx.chunk_filings(df, min_chars=min_chars).orderBy("chunk").collect()]


def test_sections(spark):
    lines = ["Cover", "Item 1. Business", "We sell.", "ITEM 1A. Risk factors", "Tariffs.", "Item 8. Statements", "Numbers.", "Item 7. Discussion", "Grew."]
    out = lines_to_chunks(spark, lines)
    assert [i for i, _ in out] == ["1", "1A", "7"] and not any("Numbers" in t for _, t in out)


def test_contents_table_makes_no_chunk(spark):
    assert lines_to_chunks(spark, ["Item 1. Business 3", "Item 1A. Risk 9", "Item 7. MD&A 20"], min_chars=200) == []


def test_long_prose_is_no_heading(spark):
    out = lines_to_chunks(spark, ["Item 1A. Risk", "Item 8 " + "of this report says " * 10, "More."])
    assert [i for i, _ in out] == ["1A"]


def test_greedy_cut(spark):
    lines = ["Item 1. B", *["x" * 400] * 9]
    out = lines_to_chunks(spark, lines, min_chars=200)
    want, buf = [], []
    for x in lines:
        buf.append(x)
        if sum(map(len, buf)) >= 1500:
            want.append(" ".join(buf)); buf = []
    want.append(" ".join(buf))
    assert [t for _, t in out] == [w for w in want if len(w) >= 200]


def test_markup_lines(spark):
    html = "<html><head><style>p{}</style></head><ix:header><p>hidden</p></ix:header><body><div>One  line</div><p>Two &amp; more</p><table><tr><td>a</td><td>b</td></tr></table><script>x()</script></body></html>"
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(tx.document_lines(F.col("h"))).first()[0] == ["One line", "Two & more", "a b"]


def test_tokens(spark):
    df = spark.createDataFrame([("The tariffs and companies' boss gas",)], "t string")
    assert df.select(tx.tokens(F.col("t"), ["the", "and"])).first()[0] == ["tariff", "company", "boss", "gas"]


def test_retrieval_with_any_number_of_salts(spark):
    chunks = spark.createDataFrame([("A", 1, "our tariff risk on imports"), ("A", 2, "cloud revenue grew"), ("A", 3, "employees and offices"), ("B", 4, "tariffs tariffs")], "symbol string, chunk_id long, text string")
    asked = spark.createDataFrame([("A", 10, "tariffs risks?"), ("A", 11, "zebra"), ("Z", 12, "tariff")], "symbol string, query_id long, query string")
    one, many = (rows(tx.retrieve(chunks, asked, salts=s, stop_words=["our", "on", "and"]).withColumn("score", F.round("score", 9))) for s in (None, 7))
    assert one == many and [(r[0], r[2]) for r in one] == [(10, 1)]


def _cosines(chunks, asked):
    """{query: [(rounded score, chunk), ...] best first}, by the definition."""
    def vector(words, idf):
        return {t: (1 + math.log(words.count(t))) * idf[t] for t in set(words) if t in idf}

    out = {}
    for symbol in {c[0] for c in chunks}:
        mine = {c[1]: c[2].split() for c in chunks if c[0] == symbol}
        idf = {t: math.log((1 + len(mine)) / (1 + sum(t in w for w in mine.values()))) + 1 for t in {t for w in mine.values() for t in w}}
        for s, key, text in asked:
            q = vector(text.split(), idf) if s == symbol else {}
            found = []
            for chunk, words in mine.items():
                v = vector(words, idf)
                dot = sum(w * v.get(t, 0.0) for t, w in q.items())
                if dot > 0:
                    found.append((-round(dot / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in q.values())), 9), chunk))
            if found:
                out[key] = [(-score, chunk) for score, chunk in sorted(found)]
    return out


@pytest.mark.parametrize("salts", [1, 3])
def test_retrieval_with_bounds_equals_all_scores(spark, salts):
    """Few rare and many frequent words, repeated chunks (ties), one symbol with most chunks."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) ** 1.3 for i in range(40)], k=n))
    chunks = [("A" if i % 4 else "B", i, text(rng.randint(1, 25))) for i in range(160)]
    chunks += [(s, i + 500, t) for s, i, t in chunks[:60]]
    asked = [("A" if i % 3 else "B", 1000 + i, text(rng.randint(1, 6))) for i in range(30)] + [("A", 2000, "w0 w0"), ("A", 2001, "w0 w39"), ("B", 2002, "w1 w0 w38 w39")]
    kind = "symbol string, {} long, {} string"
    c, q = spark.createDataFrame(chunks, kind.format("chunk_id", "text")), spark.createDataFrame(asked, kind.format("query_id", "query"))
    got = {}
    for r in tx.retrieve(c, q, k=4, salts=salts, stop_words=[]).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((round(r.score, 9), r.chunk_id))
    want = {key: found[:4] for key, found in _cosines(chunks, asked).items()}
    assert {key: [c for _, c in v] for key, v in got.items()} == {key: [c for _, c in v] for key, v in want.items()}
    assert all(abs(a - b) < 2e-9 for key in want for (a, _), (b, _) in zip(got[key], want[key]))


def test_frequent_words_are_not_essential(spark):
    chunks = spark.createDataFrame([("A", i, "common filler" + (" rare" if i < 5 else "")) for i in range(50)], "symbol string, chunk_id long, text string")
    asked = spark.createDataFrame([("A", 1, "rare common")], "symbol string, query_id long, query string")
    postings, vectors = tx.unit_postings(chunks, tx._counts(asked, "query_id", "query", []), 1, [])
    terms = {r.term: r for r in tx.bounded_terms(postings, vectors, 3).collect()}
    assert terms["rare"].essential and not terms["common"].essential and terms["rare"].rest > 0


def test_mentions(spark):
    known = spark.createDataFrame([("AAPL",), ("MSFT",), ("A",), ("IT",)], "symbol string")
    q = spark.createDataFrame([(1, "Compare AAPL with MSFT and AAPL"), (2, "A good stock?"), (3, "what about $A"), (4, "aapl it"), (5, "ÉAAPL x")], "question_id int, question string")
    assert rows(tx.mentions(q, known)) == [(1, "AAPL", 1), (1, "MSFT", 2), (3, "A", 1)]


def test_category_and_ranking_words(spark):
    q = spark.createDataFrame([("cheapest stocks",), ("best quality",), ("show me something",)], "q string")
    assert [tuple(r) for r in q.select(tx.find_category(F.col("q")), tx.wants_ranking(F.col("q"))).collect()] == [("value", True), ("quality", True), ("total", False)]


def test_task_prompts_pass_through(spark):
    t = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (1, 2, "user", "### Task: title"), (2, 0, "user", "what?"), (2, 1, "assistant", "x"), (3, 0, "assistant", "x")], "conv_id int, turn int, role string, text string")
    assert rows(tx.last_user_message(t)) == [(1, "### Task: title", True), (2, "what?", False), (3, "", False)]


def test_news(spark):
    n = spark.createDataFrame([("A", "{A:1:L:en:K:-0.97:C:0.9}!Down &amp; out"), ("A", "{A:2:C:1}Flat"), ("A", "{A:3:K:0.1}!  ")], "symbol string, headline string")
    for full in (False, True):
        assert sorted(rows(tf.clean_news(n, full), "headline")) == [("Down & out",), ("Flat",)]
    assert {r["sentiment"] for r in tf.clean_news(n).collect()} == {-0.97, None}


def test_action_counts_and_newest(spark):
    n = spark.createDataFrame([("A", "2024-06-10", "UPGRADED to buy", 1), ("A", "2024-06-25", "Broker downgraded it", 2), ("A", "2023-01-01", "upgraded", 3), ("B", "2024-06-01", "initiated", 4)], "symbol string, published_at string, headline string, item_id int")
    got = rows(tx.action_counts(n, F.to_timestamp(F.lit("2024-06-30"))), "symbol", "upgrades", "downgrades", "initiations")
    assert got == [("A", 1, 1, 0), ("B", 0, 0, 1)]
    assert [r["item_id"] for r in tx.newest_headlines(n, 2).where("symbol = 'A'").orderBy("rank").collect()] == [2, 1]


def test_note_fields(spark):
    r = spark.createDataFrame([("Sure:\n```json\n{\"thesis\": \"t\", \"risks\": \"r\"}\n```",), ("no json",), ("{broken",)], "raw string")
    out = tf.parse_note(r).collect()
    assert (out[0]["thesis"], out[0]["risks"], out[0]["bull_case"]) == ("t", "r", None) and out[0]["raw"].startswith("Sure")
    assert all(o[f] is None for o in out[1:] for f in tf.NOTE_FIELDS)


def test_company_resolution(spark):
    reg = spark.createDataFrame([(1, "LIVE", ["Live Corp"]), (2, None, ["McAfee, Inc."]), (3, None, ["Mcafee Holdings", "Other"]), (4, None, ["Solo & Sons Ltd"])], "cik long, ticker string, names array<string>")
    fd = spark.createDataFrame([(2, d("2009-01-01"), 50), (3, d("2015-01-01"), 900)], "cik long, filed_at date, n long")
    p = spark.createDataFrame([("LIVE", "whatever", d("2010-01-01")), ("MFE", "McAfee (old)", d("2010-01-01")), ("S", "Solo and Sons", d("2010-01-01")), ("X", "Nobody", d("2010-01-01")), ("O", "Nobody", d("2010-01-01"))], "symbol string, company string, known_by date")
    assert rows(tx.resolve_companies(p, reg, fd, {"O": 99})) == [("LIVE", 1, "ticker"), ("MFE", 2, "name-best-of-2"), ("O", 99, "override"), ("S", 4, "name")]


SCORES = "symbol string, as_of date, quality double, growth double, value double, momentum double, risk double, total double"


def test_ranking_falls_back_and_drops_stale(spark):
    day = d("2024-06-30")
    df = spark.createDataFrame([("AAPL", day, None, None, 50.0, 1.0, 1.0, 3.0), ("MSFT", day, None, None, 60.0, 1.0, 1.0, 2.0), ("A", day, None, None, 70.0, 1.0, 1.0, 1.0), ("OLD", d("2024-06-19"), None, None, 99.0, 1.0, 1.0, 99.0)], SCORES)
    assert [r["symbol"] for r in ls.ranking(df, "value").collect()] == ["A", "MSFT", "AAPL"]
    assert [r["symbol"] for r in ls.ranking(df, "quality").collect()] == ["AAPL", "MSFT", "A"]
    assert [r["symbol"] for r in ls.ranking(df, "ml_score").collect()] == ["AAPL", "MSFT", "A"]


def test_change_by_rows_differs_from_change_by_dates(spark):
    days = [d(f"2024-0{m}-28") for m in range(1, 6)]
    data = [("A", x, *[None] * 5, float(i)) for i, x in enumerate(days)] + [("B", x, *[None] * 5, float(10 * i)) for i, x in enumerate(days) if i != 2]
    df = spark.createDataFrame(data, SCORES)
    by_row = {r["symbol"]: r["total_change"] for r in ls.with_row_change(df).collect()}
    by_date = {r["symbol"]: r["total_change"] for r in ls.with_date_change(df).collect()}
    assert by_row == {"A": 3.0, "B": 40.0} and by_date == {"A": 3.0, "B": 30.0}


def test_page_sorts_missing_last(spark):
    df = spark.createDataFrame([("A", "Alpha", "Tech", 1.0), ("B", "Beta", "Tech", None), ("C", "Gamma", "Energy", 3.0)], "symbol string, name string, sector string, total double")
    assert [r["symbol"] for r in ls.page(df).collect()] == ["C", "A", "B"]
    assert [r["symbol"] for r in ls.page(df, query="A").collect()] == ["C", "A", "B"] and [r["symbol"] for r in ls.page(df, query="alp").collect()] == ["A"]
    assert [r["symbol"] for r in ls.page(df, sector="Tech", number=1, size=1).collect()] == ["B"]


_ = approx


def test_entities_and_unicode_blanks(spark):
    import html

    from tidemark.sources.text_files import unescape

    texts = ["", "a & b", "&amp;lt; &lt;b&gt; &copy 2020 &copyx &notit; &nosuch; &", "&#8217;&#x2019;&#160;&#0;&#128;&#xD800;&#99999999999; &#12", "&mdash;&nbsp;&rarr;&ampamp;", "&&amp;&;&#;&#x;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescape(F.col("t")).alias("u"))
    for r in df.collect():
        assert r.u == html.unescape(r.t), r.t
    page = "<p>Item&#160;1A.&#160;Risk Factors</p><p>It&#8217;s a risk &mdash; " + "word " * 60 + "</p>"
    lines = tx.document_lines(F.lit(page))
    got = spark.range(1).select(F.lit("A").alias("symbol"), F.lit("1").alias("accn"), F.lit("10-K").alias("form"), F.lit("2024-01-01").alias("filed"), lines.alias("lines"))
    assert got.first().lines[0] == "Item 1A. Risk Factors"
    assert [c.item for c in tx.chunk_filings(got).collect()] == ["1A"]


def test_lines_keep_entity_names_that_lack_their_closing_mark(spark):
    page = "<title>a&amp;&amp</title>b<p>x&amp;y &copy 2020 &amp;amp;</p><p>z&amp</p>"
    lines = spark.createDataFrame([(page,)], "h string").select(tx.document_lines(F.col("h"))).first()[0]
    assert lines == ["a&&ampbx&y &copy 2020 &amp;", "z&amp"]
