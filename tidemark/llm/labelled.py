"""Bounded samples of labelled documents, and the folds they are split by."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def sample(docs: DataFrame, labels: DataFrame, columns: list[str], rows: int, keep: Column | None = None) -> DataFrame:
    """At most `rows` labelled documents (doc_id, text, label columns), the ones with the least id hash.

    Rows with a null id or a null label are left out; of an id's repeated labels the largest counts. The ids are
    bounded by `rows`, so they are broadcast and the texts are not shuffled.
    """
    known = labels.where(F.col("doc_id").isNotNull())
    for c in columns:
        known = known.where(F.col(c).isNotNull())
    if keep is not None:
        known = known.where(keep)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(c).cast("int").alias(c) for c in columns])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")
