"""The corpus operators over the given tables, with production parameters: one query per operator."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontaminate, dedup_exact, licenses, near_dedup, packing, pii, prefix_trie, quality, sharding, suffix_dedup, token_files, toxicity, turn_repair, twins
from tidemark.llm.common import small_batches, table, text_of
from tidemark.session import tune


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return table(spark, folder, "documents")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_documents(spark, folder), tokenizer_file())


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(_documents(spark, folder), table(spark, folder, "labels"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    return toxicity.toxicity(docs, docs, table(spark, folder, "labels"))


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_round_trip(_documents(spark, folder), tokenizer_file()).drop("part")


def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_groups(_documents(spark, folder), shingle=4)


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(_documents(spark, folder))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    small_batches(spark)
    return dedup_exact.exact_groups(docs)


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeats_removed(_documents(spark, folder)).drop("kept_text")


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(_documents(spark, folder), table(spark, folder, "benchmark"))


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(_documents(spark, folder))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return prefix_trie.trie(prefix_trie.continued(table(spark, folder, "conversations")))


def op12_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    tune(spark)
    return turn_repair.digest(turn_repair.repaired(turn_repair.damaged(table(spark, folder, "conversations"))))


def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    dealt = sharding.sharded(_documents(spark, folder))
    return dealt.select("doc.doc_id", "size", F.crc32(text_of("doc.text").cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_quality, op3_toxicity, op4_token_files, op5_near_dedup, op6_licenses, op7_exact_dedup, op8_suffix_dedup, op9_decontamination, op10_personal_data,
    op11_prefix_trie, op12_turn_repair, op13_sharding)}

#: DuckDB twins, where SQL can say the whole result
ORACLE = {"op5_near_dedup": twins.NEAR_DEDUP, "op6_licenses": twins.LICENSES, "op7_exact_dedup": twins.EXACT_DEDUP, "op9_decontamination": twins.DECONTAMINATION,
          "op11_prefix_trie": twins.PREFIX_TRIE, "op12_turn_repair": twins.TURN_REPAIR}
