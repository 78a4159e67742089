"""Exact deduplication by deterministic block naming (operator 7).

Texts are cut into blocks of a fixed number of bytes. Blocks are sorted and numbered: equal blocks get one integer
name, unequal ones different names. Adjacent names of a text are then paired and the pairs named the same way, level
by level, until each text is down to one name. The identity of a text is (its number of blocks, that name): two texts
have the same identity if and only if they are the same bytes. No hash decides anything.

Block bytes are shuffled once: each Arrow batch, cut where its texts reach `PIECE_BYTES`, first reduces its blocks to
distinct ones, so a block that a third of all rows hold travels once per piece. Names are (partition of the sort, rank within it): integers, ordered within a
partition, never collected. The levels handle integers only, of texts longer than one block.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import released, text_of
from tidemark.staging import discard, staged

BLANKS = r"[\x20\x09-\x0D]+"
#: bytes of text whose blocks a task holds at once (a single longer text is held whole)
PIECE_BYTES = 2 << 20


def normalised(column: str = "text"):
    """The text with each run of ASCII blanks as one blank; null counts as empty."""
    return F.regexp_replace(text_of(column), BLANKS, " ")


MIXED = "slot long, block binary, row long, pos int, batch string, n_blocks int, doc_id long, text_sha256 string"


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut, in their order, into runs of rows with at most `most` bytes of text (column 1), one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _blocks(size: int, most: int = PIECE_BYTES):
    """Batches of (doc_id, text, text_sha256) to the distinct blocks of a piece and, per block of a text, a reference."""
    kind = pa.schema([("slot", pa.int64()), ("block", pa.binary()), ("row", pa.int64()), ("pos", pa.int32()), ("batch", pa.string()),
                      ("n_blocks", pa.int32()), ("doc_id", pa.int64()), ("text_sha256", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = TaskContext.get().partitionId() << 40
        for batch in _pieces(batches, most):
            mark, slots, of, counts = uuid.uuid4().hex, {}, [], []
            for text in batch.column(1).to_pylist():
                raw = text.encode("utf-8", "surrogatepass")
                n = max(1, -(-len(raw) // size))
                of += [slots.setdefault(raw[i * size:(i + 1) * size], len(slots)) for i in range(n)]
                counts.append(n)
            n, m, counts = len(slots), len(of), np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n), pa.int64()), pa.array(list(slots), pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array([mark] * n, pa.string()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], schema=kind)
            text = np.repeat(np.arange(len(counts)), counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(of, pa.int64()), pa.nulls(m, pa.binary()), pa.array(rows + text), pa.array(np.arange(m) - (np.cumsum(counts) - counts)[text], pa.int32()), pa.array([mark] * m, pa.string()),
                 pa.array(counts[text], pa.int32()), batch.column(0).take(pa.array(text)), batch.column(2).take(pa.array(text))], schema=kind)
            rows += len(counts)

    return released(cut)


def _named(df: DataFrame, keys: list[str], carry: list[str], name: str) -> DataFrame:
    """Rows sorted by their key within its hash partition; a new name where the key changes. Streams over batches."""
    spark = df.sparkSession
    picked = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *carry)
    kinds = dict(picked.dtypes)
    out = ", ".join(f"{c} {kinds[c]}" for c in carry) + f", {name} long"
    width = len(keys)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, last = TaskContext.get().partitionId() << 40, None
        current = base
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i) for i in range(width)]
            new = np.zeros(batch.num_rows, bool)
            for c in columns:
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            first = tuple(c[0].as_py() for c in columns)
            new[0] = first != last
            last = tuple(c[-1].as_py() for c in columns)
            names = current + np.cumsum(new)
            current = int(names[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[width:], pa.array(names)], names=[*carry, name])

    ordered = picked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *[f"_k{i}" for i in range(width)]).sortWithinPartitions(*[f"_k{i}" for i in range(width)])
    return ordered.mapInArrow(number, out)


def identities(texts: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """(row, doc_id, text_sha256, n_blocks, name) for each row of (doc_id, text, text_sha256).

    `row` numbers the rows; (n_blocks, name) is equal exactly where the texts are equal.
    """
    mixed = staged(texts.select("doc_id", "text", "text_sha256").mapInArrow(_blocks(block_bytes), MIXED), "blocks")
    names = staged(_named(mixed.where("block IS NOT NULL"), ["block"], ["batch", "slot"], "name"), "block-names")
    level = staged(mixed.where("row IS NOT NULL").join(names, ["batch", "slot"]).select("row", "pos", "name", "n_blocks", F.col("n_blocks").alias("left"), "doc_id", "text_sha256"), "level")
    discard(mixed, names)
    facts = level.where("pos = 0").select("row", "doc_id", "text_sha256")
    done = [level.where("n_blocks = 1").select("row", "n_blocks", "name")]
    waiting = level.where("n_blocks > 1").select("row", "pos", "name", "n_blocks", "left")
    longest = waiting.agg(F.max("left")).first()[0] or 1
    while longest > 1:
        name_at = lambda k: F.max(F.expr(f"CASE WHEN pos % 2 = {k} THEN name END"))
        pairs = staged(waiting.groupBy("row", F.expr("pos div 2").cast("int").alias("pos"), "n_blocks", "left").agg(name_at(0).alias("l"), F.coalesce(name_at(1), F.lit(-1)).alias("r")), "pairs")
        # pairs are made distinct before they are sorted, so one that many texts share is sorted once
        numbered = staged(_named(pairs.select("l", "r").distinct().select("l", "r", F.col("l").alias("left_name"), F.col("r").alias("right_name")), ["l", "r"], ["left_name", "right_name"], "name"), "pair-names")
        named = pairs.join(numbered, (F.col("l") == F.col("left_name")) & (F.col("r") == F.col("right_name")))
        after = staged(named.select("row", "pos", "name", "n_blocks", F.expr("cast((left + 1) div 2 as int)").alias("left")), "level")
        discard(pairs, numbered)
        done.append(after.where("left = 1").select("row", "n_blocks", "name"))
        waiting = after.where("left > 1")
        longest = (longest + 1) // 2
    return reduce(DataFrame.unionByName, done).join(facts, "row")


def _first(named: DataFrame) -> DataFrame:
    return named.groupBy("n_blocks", "name").agg(F.count("*").alias("group_size"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))


def _prepared(docs: DataFrame) -> DataFrame:
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("text"))
    return text.withColumn("text_sha256", F.sha2("text", 256))


def exact_groups(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept and text_sha256.

    Of equal normalised texts the row with the smallest doc_id stays; null ids come last, and of rows with equal ids
    one stays. Null and empty texts are equal to each other. Every row appears once, repeated ones too; an empty
    table gives an empty one.
    """
    named = staged(identities(_prepared(docs), block_bytes), "identities")
    return named.join(_first(named), ["n_blocks", "name"]).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")


def keep_first_copies(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """`docs` without later copies; the columns stay as they came, whatever their names.

    The rows to keep are found by their identity and fetched by (doc_id, digest). Repeated rows with one doc_id and
    one text cannot be told apart that way; where such rows exist, one of them is taken.
    """
    named = staged(identities(_prepared(docs), block_bytes), "identities")
    first = _first(named).select(F.col("first.row").alias("row"))
    keys = named.join(first, "row").select(F.struct("doc_id", "text_sha256").alias("key"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    keyed = whole.withColumn("key", F.struct(F.col("doc.doc_id").cast("long").alias("doc_id"), F.sha2(F.regexp_replace(F.coalesce(F.col("doc.text").cast("string"), F.lit("")), BLANKS, " "), 256).alias("text_sha256")))
    kept = keyed.join(keys, "key", "left_semi")
    again = named.groupBy(F.struct("doc_id", "text_sha256").alias("key")).count().where("count > 1")
    if not again.isEmpty():
        kept = kept.groupBy("key").agg(F.first("doc").alias("doc"))
    return kept.select("doc.*")
