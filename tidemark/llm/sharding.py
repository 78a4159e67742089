"""Shards of near equal size by histogram sort (operator 13).

Rows are ordered by (hash of the text, doc_id, row number), so equal texts stand together and no two rows share a key.
The order is never sorted as a whole: probes (candidate keys) go out, every task counts the bytes and rows between
them, the sums give the exact bytes below each probe, and only cells that still hold a wanted boundary are probed
again, more finely. Once every boundary is met within the tolerance, or no row lies between two probes any more, rows
move once, straight to the part that the boundaries name. A boundary is an edge between two texts where one lies
within the tolerance; only a group of equal texts too large for that is cut, by doc_id, then by row number.

A shard may be far larger than a task can hold, so it is made of several parts of about `part_bytes`. The counts
below the boundaries also say how many rows stand before each part, so slots need no second pass.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import text_of
from tidemark.staging import staged

#: a row's size beyond its text: room for its id
ROW_BYTES = 8
#: cells of the first round, and new probes in each cell that is looked into again
FIRST_CELLS, FINER = 4096, 64
LOWEST = -(2**63)

Key = tuple[int, int, int]


def size_of(text: Column) -> Column:
    return F.octet_length(F.coalesce(text.cast("string"), F.lit(""))).cast("long") + ROW_BYTES


class Cell(NamedTuple):
    """What lies between two probes: bytes, rows, least and greatest key."""

    size: int
    rows: int
    least: Key
    most: Key


def cell_of(probes: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Per row the number of probes at or below its key; probes are sorted rows of three numbers."""
    first = probes[:, 0]
    found = np.searchsorted(first, keys[0], "right")
    # probes that share their first number with a row are compared further: they cut a group of equal texts
    deep = np.unique(first[(probes[:, 1] > LOWEST) | (probes[:, 2] > LOWEST)])
    for value in deep[np.isin(deep, keys[0])]:
        low, high = np.searchsorted(first, value, "left"), np.searchsorted(first, value, "right")
        at = np.flatnonzero(keys[0] == value)
        second = probes[low:high, 1]
        within = np.searchsorted(second, keys[1][at], "right")
        for v in np.unique(second[probes[low:high, 2] > LOWEST]):
            a, b = np.searchsorted(second, v, "left"), np.searchsorted(second, v, "right")
            same = keys[1][at] == v
            within[same] = a + np.searchsorted(probes[low + a:low + b, 2], keys[2][at][same], "right")
        found[at] = low + within
    return found


def _count(keyed: DataFrame, probes: list[Key]) -> dict[int, Cell]:
    """The cells that hold rows. What comes to the driver is one row per cell, whatever the input."""
    wanted = np.array(probes, np.int64).reshape(-1, 3)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            k1, k2, k3, size = (np.asarray(c) for c in batch.columns)
            order = np.lexsort((k3, k2, k1))
            keys = [k1[order], k2[order], k3[order]]
            cell = cell_of(wanted, keys)
            starts = np.flatnonzero(np.diff(cell, prepend=-1))
            if not len(starts):
                continue
            ends = np.append(starts[1:], len(cell)) - 1
            sums = np.add.reduceat(size[order], starts)
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                least, most = tuple(int(k[a]) for k in keys), tuple(int(k[b]) for k in keys)
                old = found.get(c := int(cell[a]))
                n, s = b - a + 1, int(sums[i])
                found[c] = [s, n, least, most] if old is None else [old[0] + s, old[1] + n, min(old[2], least), max(old[3], most)]
        if found:
            yield pa.RecordBatch.from_pylist(
                [{"cell": c, "size": s, "rows": n, "least": dict(zip("abc", lo)), "most": dict(zip("abc", hi))} for c, (s, n, lo, hi) in found.items()], schema=shape)

    key = pa.struct([(c, pa.int64()) for c in "abc"])
    shape = pa.schema([("cell", pa.int64()), ("size", pa.int64()), ("rows", pa.int64()), ("least", key), ("most", key)])
    spelt = "struct<a:long,b:long,c:long>"
    counted = keyed.mapInArrow(histogram, f"cell long, size long, rows long, least {spelt}, most {spelt}")
    cells = counted.groupBy("cell").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max("most").alias("most"))
    return {r["cell"]: Cell(r["size"], r["rows"], tuple(r["least"]), tuple(r["most"])) for r in cells.collect()}


def _finer(cell: Cell) -> list[Key]:
    """New probes inside a cell: steps of the first number in which its least and greatest keys differ."""
    at = next(i for i in range(3) if cell.least[i] != cell.most[i])
    low, high = cell.least[at], cell.most[at]
    steps = sorted({low + (high - low) * i // FINER + 1 for i in range(FINER)} | {high})
    edges = [cell.least[:at] + (v,) + (LOWEST,) * (2 - at) for v in steps]
    return [cell.least[:at + 1] + (LOWEST,) * (2 - at), *edges]


class Boundary(NamedTuple):
    probe: Key
    size: int  # bytes below it
    rows: int  # rows below it


def splitters(keyed: DataFrame, targets: list[float], slack: float) -> list[Boundary]:
    """For each target the probe whose exact bytes below come nearest, within `slack` where rows allow it. `keyed`
    holds (k1, k2, k3, size). Boundaries never fall below one another; targets of equal place share a boundary."""
    probes = [(LOWEST + (2**64 // FIRST_CELLS) * i, LOWEST, LOWEST) for i in range(1, FIRST_CELLS)]
    settled: dict[int, Boundary] = {}
    known: list[Boundary] = []
    while True:
        cells = _count(keyed, probes)
        below_size = below_rows = 0
        known, looked = [], set()
        open_cells: dict[int, list[int]] = {}
        for i in range(len(probes) + 1):  # a boundary is the lower edge of cell i, which is probe i - 1
            cell = cells.get(i)
            if i:
                known.append(Boundary(probes[i - 1], below_size, below_rows))
            if cell:
                for t, target in enumerate(targets):
                    if t not in settled and below_size <= target < below_size + cell.size:
                        open_cells.setdefault(i, []).append(t)
                below_size, below_rows = below_size + cell.size, below_rows + cell.rows
        sizes = np.array([b.size for b in known])
        finer: list[Key] = []
        for i, wanted in open_cells.items():
            for t in wanted:
                j = int(np.searchsorted(sizes, targets[t]))
                best = min((b for b in known[max(0, j - 1):j + 1]), key=lambda b: abs(b.size - targets[t]), default=None)
                cell = cells[i]
                if best and abs(best.size - targets[t]) <= slack or cell.least == cell.most and best:
                    settled[t] = best
                elif i not in looked:
                    looked.add(i)
                    finer += _finer(cell) if cell.least != cell.most else [cell.least]
        if len(settled) + sum(t >= below_size for t in targets) >= len(targets) or not finer:
            break
        # what is settled keeps its probe; other cells are not looked into again
        edges = {probes[j] for i in open_cells for j in (i - 1, i) if 0 <= j < len(probes)}
        probes = sorted(set(finer) | edges | {b.probe for b in settled.values()})
    last = Boundary((2**63 - 1,) * 3, below_size, below_rows)
    out = [settled.get(t, last) for t in range(len(targets))]
    return [max(out[:i + 1], key=lambda b: b.size) for i in range(len(out))]


def sharded(docs: DataFrame, count: int = 24, tolerance: float = 0.01, part_bytes: int = 128 << 20) -> DataFrame:
    """(doc, size, shard, slot): every row of `docs` as a struct `doc`, its size (UTF-8 bytes of the text plus 8), a
    shard 0 .. count - 1 and its place there, gapless from 0.

    Shards hold near equal bytes: every boundary lies within `tolerance` of a shard's share, or at the nearest row
    where single rows are larger. Equal texts share a shard where a boundary within the tolerance allows it. A null
    text has size 8; null ids stand first within their text; repeated rows are rows of their own. An empty table
    gives an empty one; with fewer rows than shards some shards are empty. Columns of any name stay inside `doc`.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    keyed = docs.select(doc, F.xxhash64(text_of()).alias("k1"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("k2"),
                        F.monotonically_increasing_id().alias("k3"), size_of(F.col("text")).alias("size"))
    # written once: row numbers must not change between rounds or when a task is run again
    keyed = staged(keyed, "keyed")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    parts_each = max(1, -(-total // (count * part_bytes)))
    parts = count * parts_each
    targets = [total * i / parts for i in range(1, parts)]
    cuts = splitters(keyed.select("k1", "k2", "k3", "size"), targets, tolerance * total / count) if total else []
    probes = np.array([b.probe for b in cuts], np.int64).reshape(-1, 3)
    before = np.array([0, *[b.rows for b in cuts]], np.int64)
    # rows that stand before a part within its shard
    base = before - before[np.arange(len(before)) // parts_each * parts_each]

    @F.pandas_udf("part int, shard int, base long")
    def place(k1: pd.Series, k2: pd.Series, k3: pd.Series) -> pd.DataFrame:
        part = cell_of(probes, [k1.to_numpy(), k2.to_numpy(), k3.to_numpy()])
        return pd.DataFrame({"part": part.astype(np.int32), "shard": (part // parts_each).astype(np.int32), "base": base[part]})

    dealt = keyed.withColumn("place", place("k1", "k2", "k3")).select("doc", "size", "k1", "k2", "k3", "place.*").repartitionById(parts, F.col("part"))
    order = Window.partitionBy("part").orderBy("k1", "k2", "k3")  # a part has about part_bytes, whatever the input
    return dealt.select("doc", "size", "shard", (F.col("base") + F.row_number().over(order) - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, count: int = 24, tolerance: float = 0.01) -> DataFrame:
    """The shards as parquet folders `shard=N` under `path`, read back."""
    sharded(docs, count, tolerance).write.mode("error").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path).withColumn("shard", F.col("shard").cast("int"))


__all__ = ["cell_of", "sharded", "size_of", "splitters", "write_shards"]
