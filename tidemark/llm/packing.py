"""Best-fit packing of token sequences (operator 1).

Bulk-synchronous best fit. Pieces and gaps are ordered by size, and every row holds a rank within its size. A round

1. sweeps the sizes from the largest piece down, giving each size its successors: the smallest gaps that hold it;
2. resolves conflicts by rank: row r of a piece size goes to row r of the gaps it was given (a distributed join);
3. updates the gaps, writes them, and repeats. Pieces that no gap holds open new sequences, the largest ones as many
   as the remaining tokens need, before the next round.

Only the number of rows per size reaches the driver: at most `capacity` of them, whatever the input. Rows are ranked
within (size, input part) and part totals are summed, so no size is gathered in one task.
"""
from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.tokens import WordEncoder, parts as text_parts, with_end
from tidemark.staging import discard, staged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Every document's ids, end id included, cut into pieces of at most `capacity`.

    A null text is empty and gives the end id alone. Rows with a null or repeated doc_id are documents of their own.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        for batch in text_parts(batches):
            bounds, ids = with_end(*encoder.batch(batch.column(1)), end_id)
            sizes = np.diff(bounds)
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            at = bounds[:-1][row] + start
            raw = ids.astype("<u4", copy=False).view(np.uint8)
            crc = [zlib.crc32(raw[4 * a:4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def _ranked(df: DataFrame, size: str, part: str, order: list[str], out: str) -> DataFrame:
    """Ranks from 0 within a size: counted within (size, part), shifted by the parts before."""
    within = df.withColumn("_r", F.row_number().over(Window.partitionBy(size, part).orderBy(*order)))
    counts = df.groupBy(size, part).count()
    before = counts.withColumn("_before", F.sum("count").over(Window.partitionBy(size).orderBy(part)) - F.col("count"))
    return within.join(before.select(size, part, "_before"), [size, part]).withColumn(out, F.col("_r") - 1 + F.col("_before")).drop("_r", "_before")


Run = tuple[int, int, int]  # gap size before the round, first rank within it, gaps


def sweep(waiting: np.ndarray, gaps: np.ndarray) -> tuple[list[tuple], list[tuple]]:
    """One successor sweep over counts by size.

    Pieces from the largest size down take the smallest gaps that hold them, as many equal pieces to a gap as fit; what
    is left of a gap may serve a smaller size. Gaps of one size are handled as runs of ranks, so the work and the
    returned lists grow with the number of sizes, not with rows. Returns the moves (piece size, first piece of it,
    pieces, old gap size, first gap rank, pieces per gap, offset of the first) and the runs' new gaps (old gap size,
    first rank, gaps, new gap).
    """
    capacity = len(gaps) - 1
    runs: dict[int, list[Run]] = {g: [(g, 0, int(gaps[g]))] for g in np.flatnonzero(gaps).tolist()}
    sizes, moves = sorted(runs), []

    def put(gap: int, run: Run) -> None:
        if gap not in runs:
            runs[gap] = []
            bisect.insort(sizes, gap)
        runs[gap].append(run)

    for size in np.flatnonzero(waiting)[::-1].tolist():
        left, at = int(waiting[size]), 0
        while left and (i := bisect.bisect_left(sizes, size)) < len(sizes):
            gap = sizes[i]
            old, first, n = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], sizes[i]
            each = gap // size
            take = min(left, n * each)
            full, rest = divmod(take, each)
            moves.append((size, at, take, old, first, each, capacity - gap))
            if full:
                put(gap - each * size, (old, first, full))
            if rest:
                put(gap - rest * size, (old, first + full, 1))
            if n > full + (rest > 0):
                put(gap, (old, first + full + (rest > 0), n - full - (rest > 0)))
            left, at = left - take, at + take
    return moves, [(old, first, n, gap) for gap, found in runs.items() for old, first, n in found]


def pack(parts: DataFrame, capacity: int = 4096) -> DataFrame:
    """Place every row of `parts` (a `length` from 1 to `capacity` and any other columns) in a sequence.

    Adds sequence_id and offset; within a sequence offsets run from 0 without gaps. Ties in length are broken by the
    input part and then by the other columns, so equal rows are interchangeable. An empty table gives an empty table.
    """
    spark = parts.sparkSession
    # a row travels as one column, so its names cannot meet the ones used here
    flat = staged(parts.select(F.col("length").cast("long").alias("length"), F.struct(*[F.col(f"`{c}`") for c in parts.columns]).alias("row"), F.spark_partition_id().alias("_part")), "pieces")
    ranked = staged(_ranked(flat, "length", "_part", ["row"], "_rank").drop("_part"), "ranked-pieces")
    discard(flat)
    waiting = np.zeros(capacity + 1, np.int64)
    for size, n in ranked.groupBy("length").count().collect():  # at most `capacity` rows
        if size is None or not 1 <= size <= capacity:
            raise ValueError(f"a length of {size} does not fit {capacity}")
        waiting[size] = n
    done = np.zeros(capacity + 1, np.int64)  # rows of each size that are placed, in rank order
    gap_counts, opened = np.zeros(capacity + 1, np.int64), 0
    gaps, placed = None, []

    def table(rows: list[tuple], names: str) -> DataFrame:
        """A round's moves or runs: as many as the sizes allow, whatever the number of rows."""
        return F.broadcast(spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names.split())))

    def chosen(plan: DataFrame) -> DataFrame:
        return ranked.join(plan, "length").where("_rank >= first_rank AND _rank < first_rank + take")

    while waiting.any():
        if gaps is not None:  # match
            moves, runs = sweep(waiting, gap_counts)
            rows = [(size, int(done[size]) + at, take, old, first, each, used) for size, at, take, old, first, each, used in moves]
            for size, _, take, *_ in moves:
                done[size] += take
                waiting[size] -= take
            free = staged(_ranked(gaps.withColumn("_part", F.expr("sequence_id % 256")), "gap", "_part", ["sequence_id"], "gap_rank").drop("_part"), "free-gaps")
            if rows:
                given = chosen(table(rows, "length first_rank take gap first_gap each used")).withColumn("gap_rank", F.expr("first_gap + (_rank - first_rank) div each"))
                placed.append(staged(given.join(free, ["gap", "gap_rank"]).withColumn("offset", F.expr("used + (_rank - first_rank) % each * length")).select("row", "sequence_id", "offset"), "placed"))
            gap_counts[:] = 0
            for _, _, n, gap in runs:
                gap_counts[gap] += n
            if waiting.any():
                now = free.join(table(runs, "gap first_gap n left"), "gap").where("gap_rank >= first_gap AND gap_rank < first_gap + n AND left > 0")
                fresh = staged(now.select("sequence_id", F.col("left").alias("gap")), "gaps")
                discard(gaps)
                gaps = fresh
            discard(free)
            gap_counts[0] = 0
        if waiting.any():  # open
            need = -(-int(waiting @ np.arange(capacity + 1)) // capacity)
            if gaps is None:
                need = max(need, int(waiting[capacity // 2 + 1:].sum()))
            rows = []
            for size in np.flatnonzero(waiting)[::-1].tolist():
                if take := min(need, int(waiting[size])):
                    rows.append((size, int(done[size]), take, opened))
                    done[size] += take
                    waiting[size] -= take
                    gap_counts[capacity - size] += take
                    opened, need = opened + take, need - take
            gap_counts[0] = 0
            new = chosen(table(rows, "length first_rank take first_sequence")).withColumn("sequence_id", F.expr("first_sequence + _rank - first_rank")).withColumn("offset", F.lit(0).cast("long"))
            placed.append(staged(new.select("row", "length", "sequence_id", "offset"), "opened"))
            fresh = placed[-1].select("sequence_id", F.expr(f"{capacity} - length").alias("gap")).where("gap > 0")
            both = staged(fresh if gaps is None else gaps.unionByName(fresh), "gaps")
            if gaps is not None:
                discard(gaps)
            gaps = both
    if not placed:
        return ranked.select("row.*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return reduce(DataFrame.unionByName, [p.select("row", "sequence_id", "offset") for p in placed]).select("row.*", "sequence_id", "offset")


def packed(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity)
