"""Benchmark decontamination (operator 9): normalised test n-grams as a broadcast hash set, training windows scanned.

Every run of `n` words holds exactly one stretch of `ANCHOR` words that starts at a multiple of `STRIDE` words of the
document and lies inside it (n = STRIDE + ANCHOR - 1). Only those stretches of a document are hashed and looked up
among all such stretches of the benchmark; a match is then verified word by word on every window around it. Items of
fewer than n words are one window each and are looked up at every place. Nothing but expressions of the engine runs.
The benchmark's set is broadcast below a size that is checked, and joined by shuffle beyond it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import text_of
from tidemark.llm.words import BETWEEN, WORD, words
from tidemark.staging import staged

#: rows of the benchmark's window table up to which it is broadcast
BROADCAST_ROWS = 500_000


def _digest(array: Column) -> Column:
    return F.xxhash64(array)


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(item, size, gram): the windows of every item; none for an item without words."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    cut = F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).when(F.size("w") > 0, F.array("w"))
    return items.select("item", F.explode(cut).alias("gram")).select("item", F.size("gram").alias("size"), "gram").distinct()


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """(doc_id, mark, pos, size, item): every occurrence of a window, by the row's id and text digest."""
    anchor = n // 2 + 1
    stride = n - anchor + 1
    windows = staged(benchmark_windows(benchmark, n), "windows")
    sizes = {r["size"]: r["count"] for r in windows.groupBy("size").count().collect()}  # at most n sizes
    total = sum(sizes.values())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("mark"), words(F.col("text")).alias("w"))
    found = []
    if sizes.get(n):
        grams = windows.where(F.col("size") == n)
        marks = grams.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(stride)), lambda i: _digest(F.slice("gram", i, anchor)))).alias("digest")).distinct()
        # words around the stretch travel with it, so a match needs no second look at the text
        at = F.when(F.size("w") >= anchor, F.transform(F.sequence(F.lit(0), F.size("w") - anchor, F.lit(stride)), lambda i: F.struct(
            _digest(F.slice("w", i + 1, anchor)).alias("digest"), F.greatest(i - (stride - 1), F.lit(0)).alias("from"),
            F.slice("w", F.greatest(i - (stride - 1), F.lit(0)) + 1, i - F.greatest(i - (stride - 1), F.lit(0)) + n).alias("around"))))
        near = texts.select("doc_id", "mark", F.explode(at).alias("s")).select("doc_id", "mark", "s.*").join(_sized(marks, total * stride), "digest", "left_semi")
        inner = F.when(F.size("around") >= n, F.transform(F.sequence(F.lit(0), F.size("around") - n), lambda i: F.struct((F.col("from") + i).alias("pos"), F.slice("around", i + 1, n).alias("gram"))))
        found.append((near.select("doc_id", "mark", F.explode(inner).alias("s")).select("doc_id", "mark", "s.pos", "s.gram"), grams))
    for size in sorted(sizes):
        if size < n:
            every = F.when(F.size("w") >= size, F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.struct(i.alias("pos"), F.slice("w", i + 1, size).alias("gram"))))  # noqa: B023
            found.append((texts.select("doc_id", "mark", F.explode(every).alias("s")).select("doc_id", "mark", "s.pos", "s.gram"), windows.where(F.col("size") == size)))
    if not found:
        found.append((texts.select("doc_id", "mark", F.lit(0).alias("pos"), "w").withColumnRenamed("w", "gram").limit(0), windows))
    out = None
    for near, grams in found:
        verified = near.join(_sized(grams, total), "gram").select("doc_id", "mark", "pos", "size", "item").distinct()
        out = verified if out is None else out.unionByName(verified)
    return out


def _cover(found: DataFrame) -> DataFrame:
    """Per document the number of covered words, the items and their digest."""
    key = ["doc_id", "mark"]
    spans = found.groupBy(*key, "pos").agg(F.max("size").alias("size"))
    before = F.coalesce(F.max(F.col("pos") + F.col("size")).over(Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = spans.withColumn("new", F.greatest(F.lit(0), F.col("pos") + F.col("size") - F.greatest("pos", before))).groupBy(*key).agg(F.sum("new").alias("n_hit"))
    items = found.groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.col("doc_id").alias("h_id"), F.col("mark").alias("h_mark"), "items")
    # null ids meet as well
    return covered.join(items, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("mark") == F.col("h_mark"))).select("h_id", "h_mark", "n_hit", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words).

    A null text has no words. Rows with null or repeated ids are told apart by their text; equal rows get equal
    results. Items without words, null ones too, match nothing; an item counts once however often it occurs. An empty
    benchmark leaves every document clean.
    """
    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("mark"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = counts.join(_cover(hits(docs, benchmark, n)), F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("mark") == F.col("h_mark")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                         F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
                         ((F.coalesce("n_hit", F.lit(0)) > 0) & (share * F.coalesce("n_hit", F.lit(0)) >= F.col("n_words"))).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """`docs` without contaminated documents; the columns stay as they came, whatever their names."""
    cover = _cover(hits(docs, benchmark, n))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    keyed = whole.withColumns({"d": F.col("doc.doc_id").cast("long"), "m": F.xxhash64(F.coalesce(F.col("doc.text").cast("string"), F.lit("")))})
    suspects = cover.select("h_id", "h_mark", "n_hit")
    return keyed.join(suspects, F.col("d").eqNullSafe(F.col("h_id")) & (F.col("m") == F.col("h_mark")), "left").where(
        (F.col("n_hit").isNull()) | (share * F.col("n_hit") < F.size(words(F.col("doc.text"))))).select("doc.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """(doc_id, text): texts with every hit word cut out, and the characters between hit words with it."""
    found = hits(docs, benchmark, n)
    cut = found.groupBy("doc_id", "mark").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("pos"), F.col("pos") + F.col("size") - 1)))).alias("cut")).select(F.col("doc_id").alias("h_id"), F.col("mark").alias("h_mark"), "cut")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    joined = texts.join(cut, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.xxhash64("text") == F.col("h_mark")), "left")
    gap, word = F.split("text", WORD), F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    pieces = F.transform(F.sequence(F.lit(0), F.size(word)), lambda i: F.concat(
        F.when(F.array_contains("cut", i - 1) & F.array_contains("cut", i), F.lit("")).otherwise(F.get(gap, i)),
        F.when((i >= F.size(word)) | F.array_contains("cut", i), F.lit("")).otherwise(F.get(word, i))))
    return joined.select("doc_id", F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(pieces, "")).alias("text"))


__all__ = ["BETWEEN", "benchmark_windows", "contamination", "hits", "without_contaminated", "without_spans"]
