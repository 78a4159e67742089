"""Facts a question needs, as one table: named symbols get their own rows, other questions a ranking."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators import lists as ls, text as tx
from tidemark.operators.scoring import SCORE_COLUMNS, with_model_scores
from tidemark.staging import staged


MODEL = "ml_score"


def score_lines(scores: DataFrame, rows: int = ls.DELTA_ROWS, ml_scores: DataFrame | None = None) -> DataFrame:
    """Latest scores per symbol and their changes against `rows` rows earlier; with `ml_scores` also the model's score of
    the same date, NULL where it has none."""
    w = Window.partitionBy("symbol").orderBy("as_of")
    if ml_scores is not None:
        scores = with_model_scores(scores, ml_scores.select("symbol", "as_of", MODEL))
    extra = [MODEL] if ml_scores is not None else []
    marked = scores.select("symbol", "as_of", *SCORE_COLUMNS, *extra, *[(F.col(c) - F.lag(c, rows).over(w)).alias(f"{c}_change") for c in SCORE_COLUMNS])
    return ls.latest_per_symbol(marked)


def ground(
    questions: DataFrame, scores: DataFrame, metrics: DataFrame, chunks: DataFrame, news: DataFrame, now: Column,
    notes: DataFrame | None = None, stop_words: Sequence[str] | None = None, top: int = 10, ml_scores: DataFrame | None = None,
) -> DataFrame:
    """questions (question_id, question) -> one row per question and named symbol (scores, factors, note,
    headline counts, newest headlines, matching excerpts), and one row per question without a name holding
    the category's ranking. chunks: symbol, chunk_id, text. news: cleaned headlines.

    Each part is one row per symbol before it is joined; the arrays hold at most 8 headlines, 4 excerpts
    and `top` ranked symbols. With `ml_scores` (symbol, as_of, ml_score) questions about the model are ranked by it; without,
    or where no fresh symbol has one, by the total.
    """
    score_table = staged(score_lines(scores, ml_scores=ml_scores), "lines")
    named = tx.mentions(questions, score_table)
    count = F.count(F.lit(1)).over(Window.partitionBy("question_id"))  # three names at most
    named = staged(named.withColumn("excerpts", F.ceil(F.lit(float(tx.EXCERPTS_TOTAL)) / count).cast("int")).withColumn("key", F.concat_ws("|", "question_id", "symbol")), "named")
    asked = named.join(questions, "question_id").select("symbol", F.col("key").alias("query_id"), F.col("question").alias("query"))
    found = tx.retrieve(chunks, asked, tx.EXCERPTS_TOTAL, stop_words=stop_words).withColumnRenamed("query_id", "key")
    found = found.join(named.select("key", "excerpts"), "key").where("rank <= excerpts").join(chunks.select("symbol", "chunk_id", "text"), ["symbol", "chunk_id"])
    found = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("excerpt_texts"))
    lines = tx.newest_headlines(news).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("rank", "published_at", "headline", "sentiment"))).alias("headlines"))
    out = named.join(score_table.select("symbol", F.struct("as_of", *[c for c in score_table.columns if c not in ("symbol", "as_of")]).alias("scores")), "symbol")
    out = out.join(ls.factor_map(metrics), "symbol", "left").join(tx.action_counts(news, now), "symbol", "left").join(lines, "symbol", "left").join(found, "key", "left")
    if notes is not None:
        note = ls.latest_per_symbol(notes)
        out = out.join(note.select("symbol", F.struct(*[c for c in note.columns if c != "symbol"]).alias("note")), "symbol", "left")
    out = out.drop("key").withColumn("route", F.lit("symbol"))
    fresh = ls.fresh(score_table)
    ranks = ls.top_lists(fresh, [*SCORE_COLUMNS, *([MODEL] if ml_scores is not None else [])], top).groupBy(F.col("list").alias("category")).agg(F.array_sort(F.collect_list(F.struct("rank", "symbol", "value"))).alias("ranking"))
    others = questions.join(named.select("question_id").distinct(), "question_id", "left_anti").select("question_id", tx.find_category(F.col("question")).alias("asked"))
    # a category nobody is scored in falls back to the total
    usable = others.join(ranks.select(F.col("category").alias("asked"), F.lit(True).alias("ok")), "asked", "left").withColumn("category", F.when(F.col("ok"), F.col("asked")).otherwise("total"))
    listed = usable.join(ranks, "category", "left").select("question_id", "category", "ranking").withColumn("route", F.lit("ranking"))
    return out.unionByName(listed, allowMissingColumns=True)
