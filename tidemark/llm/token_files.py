"""Token-id files (operator 4): flat unsigned integers beside 64-bit document offsets.

A corpus is a folder of part pairs. `part-00003.ids` holds the ids of its documents one after another, little-endian
unsigned integers of 2 bytes (4 where the vocabulary needs them); `part-00003.idx` holds n + 1 64-bit offsets into it
followed by the n document ids (64-bit, the smallest value for null). Parts follow each other in doc_id order, and
the number of ids before a part is the prefix sum over the parts' sizes. Readers map both files into memory.

A part is written under a name of its own task attempt and then renamed, so that a lost executor's half-written file
is never seen; a repeated attempt writes the same bytes. Files go to the shared scratch folder by its own scheme
(pyarrow's file systems); a scheme other than a mounted folder is read whole, part by part, rather than mapped.
"""
from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.tokens import WordEncoder, parts as text_parts, with_end
from tidemark.session import scratch_root
from tidemark.staging import staged

NO_ID = -(2**63)
PARTS = "part int, n_docs long, n_ids long, width int"
#: bytes of text that a part is meant for: its index is held by the task that writes it
PART_BYTES = 256 << 20


def _opened(folder: str):
    """The file system of a folder's URI, and its path there."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def _settle(system, attempt: str, target: str) -> None:
    """Give an attempt's file its name. An earlier attempt of the task may have left the same bytes there already, which
    some file systems do not rename over: then its file stays."""
    from pyarrow import fs

    there = system.get_file_info(target)
    if there.type == fs.FileType.File and there.size == system.get_file_info(attempt).size:
        system.delete_file(attempt)
    else:
        system.move(attempt, target)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, parts: int | None = None) -> DataFrame:
    """Encode every text, write the parts in doc_id order (null first, ties by text) and return one row per part, with the
    bytes of an id (`width`): 2, or 4 where the vocabulary or the end id needs them.

    There are as many parts as shuffle partitions, or as PART_BYTES asks for by the planner's size of the input. Null
    texts are empty and hold the end id alone; an empty table writes no part.
    """
    spark = docs.sparkSession
    if parts is None:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), min(1_000_000, -(-size // PART_BYTES)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sizes, names, stream = WordEncoder.of(tokenizer), [], [], None
        wide = "<u2" if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        part, (system, base) = TaskContext.get().partitionId(), _opened(folder)
        at = f"{base}/part-{part:05d}"
        attempt = f"{at}.{uuid.uuid4().hex}"
        for batch in text_parts(batches):
            bounds, ids = with_end(*encoder.batch(batch.column(1)), end_id)
            if stream is None:
                system.create_dir(base, recursive=True)
                stream = system.open_output_stream(f"{attempt}.ids")
            stream.write(ids.astype(wide).tobytes())
            sizes.append(np.diff(bounds))
            names.append(batch.column(0).fill_null(NO_ID).to_numpy())
        if stream is None:
            return
        stream.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<i8")
        with system.open_output_stream(f"{attempt}.idx") as out:
            out.write(offsets.tobytes() + np.concatenate(names).astype("<i8").tobytes())
        for kind in ("ids", "idx"):
            _settle(system, f"{attempt}.{kind}", f"{at}.{kind}")
        width = int(wide[2:])
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(offsets) - 1], pa.int64()), pa.array([int(offsets[-1])], pa.int64()), pa.array([width], pa.int32())], names=["part", "n_docs", "n_ids", "width"])

    return staged(ordered.mapInArrow(write, PARTS), "token-parts")


def _mapped(folder: str, name: str, kind: str):
    from pyarrow import fs

    system, base = _opened(folder)
    path = f"{base}/{name}"
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), kind)


def read_token_files(spark: SparkSession, folder: str, parts: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 and the part it lies in.

    `parts` is what the writer returned: a row per file, so the prefix sums over it stay small.
    """
    known = sorted((r.part, r.n_docs, r.n_ids, r.width) for r in parts.collect())
    before = np.concatenate([[0], np.cumsum([n for _, _, n, _ in known])]).astype(np.int64)
    rows = [(p, n, int(b), w) for (p, n, _, w), b in zip(known, before)]
    files = spark.createDataFrame(rows, "part int, n_docs long, base long, width int").repartition(max(1, len(rows)), "part")
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index = _mapped(folder, f"part-{row['part']:05d}.idx", "<i8")
                ids, n = _mapped(folder, f"part-{row['part']:05d}.ids", f"<u{row['width']}"), row["n_docs"]
                for first in range(0, n, 4096):
                    last = min(n, first + 4096)
                    offsets, names = index[first:last + 1], index[n + 1 + first:n + 1 + last]
                    wide = np.asarray(ids[offsets[0]:offsets[-1]]).astype("<u4").view(np.uint8)
                    local = ((offsets - offsets[0]) * 4).tolist()
                    crc = [zlib.crc32(wide[a:b]) for a, b in zip(local[:-1], local[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.asarray(names), mask=np.asarray(names) == NO_ID), pa.array(offsets[:-1] + row["base"]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64()), pa.array([row["part"]] * (last - first), pa.int32())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "part"])

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, part int")


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files into the shared scratch folder and read every document back from them."""
    spark = docs.sparkSession
    folder = f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    parts = write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(spark, folder, parts)
