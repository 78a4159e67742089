"""A training corpus from raw documents: five operators of tidemark.llm, one after another.

Each stage takes (spark, docs, folder) and returns a table that is written as parquet and read again as the next
one's docs. All but the last return the columns of `documents`, with the rows they keep unchanged.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import small_batches, table
from tidemark.llm.dedup_exact import keep_first_copies
from tidemark.llm.decontaminate import without_contaminated
from tidemark.llm.near_dedup import keep_representatives
from tidemark.llm.packing import packed
from tidemark.llm.queries import tokenizer_file
from tidemark.llm.toxicity import without_toxic
from tidemark.session import tune
from tidemark.staging import staged


def prepare(spark: SparkSession) -> None:
    """Stages follow one another in the same executors, whose idle Python workers still hold what they took, so batches of
    whole texts are kept small."""
    tune(spark)
    small_batches(spark)


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    prepare(spark)
    return without_toxic(docs, table(spark, folder, "documents"), table(spark, folder, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The first document of each text (blank runs counting as one blank)."""
    prepare(spark)
    return keep_first_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group linked by word-shingle similarity (five words, 0.8 or more)."""
    prepare(spark)
    return keep_representatives(docs, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    prepare(spark)
    return without_contaminated(docs, table(spark, folder, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences."""
    prepare(spark)
    return packed(docs, tokenizer_file())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL can express neither the classifier nor best-fit packing
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
