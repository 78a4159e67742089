"""Near-duplicate detection by MinHash (operator 5).

Signatures of many universal-hash minima are cut into bands; texts that share a band meet in a bucket. A node is a
distinct shingle set, named by its 128-bit fingerprint, whatever rows hold it. In a bucket every node is first paired
with the least one only (a star), pairs are checked on their signatures and then on their full sets, and components
grow by alternating large-star and small-star. Where a bucket then still holds several components, the pairs across
them are compared as well, small buckets as pairs, large ones block by block with only joining links emitted. So every
pair that shares a band is either joined already or compared, while no group is spelt out into all its pairs.

Sets travel as arrays of 64-bit shingle hashes, made once for the nodes that share a bucket, and pairs are checked by
expressions on them; texts enter no join and no group.

With 6 rows and 48 bands a pair of similarity 0.8 misses every band with probability below 5e-7.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import released, text_of
from tidemark.llm.graph import components
from tidemark.llm.shingles import mixed, shingle_sets
from tidemark.staging import discard, staged

BANDS, ROWS = 48, 6
#: members of a bucket (with several components left) that are still paired one by one
SMALL_BUCKET = 48
#: shingle hashes in one block of a larger bucket
BLOCK_HASHES = 200_000
#: texts hashed at once
TEXTS_AT_ONCE = 256


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_240_229)
    return r.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1), r.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def _names(f1: np.ndarray, f2: np.ndarray) -> pa.Array:
    """Fingerprints as 16-byte names."""
    both = np.stack([f1.astype(">u8"), f2.astype(">u8")], axis=1)
    return pa.array([x.tobytes() for x in both], pa.binary())


def _fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets and the two halves of their fingerprints; 0 for empty sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    full, f1, f2 = np.flatnonzero(sizes), np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    if len(full):
        flat, first = np.concatenate(sets), (np.cumsum(sizes) - sizes)[full]
        f1[full] = np.add.reduceat(mixed(flat), first)
        f2[full] = np.add.reduceat(mixed(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first) ^ mixed(sizes[full].astype(np.uint64))
    return sizes, f1, f2


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, mark, n, node, signature, bands) per row: the text's hash, set size, the set's name, 16 bits of each
    minimum."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients()
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(at, TEXTS_AT_ONCE)
                sets = shingle_sets(batch.column(2).to_pylist(), shingle)
                sizes, f1, f2 = _fingerprints(sets)
                full = np.flatnonzero(sizes)
                minima = np.zeros((BANDS * ROWS, len(sets)), np.uint64)
                if len(full):
                    flat, first = np.concatenate(sets), (np.cumsum(sizes) - sizes)[full]
                    for i in range(BANDS * ROWS):
                        minima[i, full] = np.minimum.reduceat(flat * a[i] + b[i], first)
                minima >>= np.uint64(32)
                rows = minima.reshape(BANDS, ROWS, -1)
                keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], rows.shape[::2]).copy()
                for j in range(ROWS):
                    keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
                short = np.ascontiguousarray((minima & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16).T)
                lists = lambda flat, width: pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * width), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(sizes), _names(f1, f2), lists(short, BANDS * ROWS), lists(np.ascontiguousarray(keys.T).view(np.int64), BANDS)],
                    names=["doc_id", "mark", "n", "node", "signature", "bands"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("mark"), text_of().alias("text"))
    return keyed.mapInArrow(released(sign), "doc_id long, mark long, n long, node binary, signature array<short>, bands array<long>")


def _sets(docs: DataFrame, signed: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, n, signature, hashes) of the wanted nodes, from one row each."""
    first = signed.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark")).alias("row"), F.first("signature").alias("signature"))
    keyed = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text_of()).alias("mark")).alias("row"), text_of().alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(at, TEXTS_AT_ONCE)
                sets = shingle_sets(batch.column(1).to_pylist(), shingle)
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets).view(np.int64) if len(sets) else np.zeros(0, np.int64)
                hashes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), batch.column(2), hashes], names=["node", "n", "signature", "hashes"])

    # rows that repeat an id and a text are one
    texts = keyed.join(first, "row").select("node", "text", "signature").dropDuplicates(["node"])
    return texts.mapInArrow(released(hashed), "node binary, n long, signature array<short>, hashes array<long>")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x and y| >= percent * |x or y| for arrays of distinct hashes."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _needed(percent: int) -> int:
    """Minima that must agree: as many as a pair of that similarity has, less about eight deviations."""
    return int(np.ceil((percent / 100 - 0.2) * BANDS * ROWS))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures and then full sets are similar enough."""
    of = lambda side, *columns: sets.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
    signed = pairs.join(of("a", "n", "signature"), "a").join(of("b", "n", "signature"), "b")
    agree = F.size(F.filter(F.zip_with("signature_a", "signature_b", lambda x, y: x == y), lambda same: same))
    likely = signed.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").where(agree >= _needed(percent)).select("a", "b")
    likely = staged(likely, "pairs")
    full = likely.join(of("b", "n", "hashes"), "b").join(of("a", "n", "hashes"), "a").withColumn("both", F.size(F.array_intersect("hashes_a", "hashes_b")))
    return full.where(f"100 * both >= {percent} * (n_a + n_b - both)").select("a", "b")


def _across_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join components inside large buckets: members are dealt into blocks by a hash of their name, as many as
    the bucket's hashes need, blocks are compared two by two, and a call emits at most one link per pair of components
    that it joins."""
    sized = members.join(sets.select("node", "n"), "node")
    need = sized.groupBy("bucket").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK_HASHES)).cast("int").alias("blocks"))
    dealt = sized.join(need, "bucket").select("bucket", "node", "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    # a block meets itself and every other once: (low, high)
    met = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def compare(key, rows):
        sets_ = [np.asarray(h, np.int64) for h in rows.hashes]
        parent, found = {c: c for c in rows.component}, []

        def root(c):
            while parent[c] != c:
                c = parent[c]
            return c

        matrix = np.stack([np.asarray(s, np.int16) for s in rows.signature]) if len(rows) else np.zeros((0, BANDS * ROWS), np.int16)
        component, block_of, node = rows.component.tolist(), rows.block.tolist(), rows.node.tolist()
        for i in range(len(rows)):
            agree = (matrix[i + 1:] == matrix[i]).sum(axis=1)
            for j in (np.flatnonzero(agree >= _needed(percent)) + i + 1).tolist():
                if key[1] != key[2] and block_of[i] == block_of[j] or root(component[i]) == root(component[j]):
                    continue
                if _similar(sets_[i], sets_[j], percent):
                    parent[root(component[i])] = root(component[j])
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
        return pd.DataFrame(found, columns=["a", "b"])

    return met.select("bucket", "node", "component", "block", "low", "high").join(sets.select("node", "signature", "hashes"), "node").groupBy("bucket", "low", "high").applyInPandas(compare, "a binary, b binary")


def near_components(docs: DataFrame, shingle: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n, node) per row of docs, and (node, component) per node that is joined to another one."""
    signed = staged(signatures(docs, shingle), "signatures")
    entries = signed.where("n > 0").select("node", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("top")).where("lead < top").select("bucket", "lead")
    members = staged(entries.join(shared, "bucket").distinct(), "buckets")
    sets = staged(_sets(docs, signed, members.select("node").distinct(), shingle), "sets")
    stars = members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    links = staged(confirmed(stars, sets, percent), "links")
    joined = components(links)
    rest = members.join(joined, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed_buckets = rest.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("size")).where("least < most")
    rest = staged(rest.join(mixed_buckets.select("bucket", "size"), "bucket"), "rest")
    few = rest.where(f"size <= {SMALL_BUCKET}")
    other = few.select("bucket", F.col("node").alias("b"), F.col("component").alias("with"))
    pairs = few.join(other, "bucket").where("node < b AND component <> with").select(F.col("node").alias("a"), "b").distinct()
    # a star pair that failed is not tried again
    pairs = pairs.join(stars, ["a", "b"], "left_anti")
    # the two checks are jobs of their own, so that their workers do not stand side by side
    more = staged(confirmed(pairs, sets, percent), "links")
    across = staged(_across_blocks(rest.where(f"size > {SMALL_BUCKET}").select("bucket", "node", "component"), sets, percent), "links")
    if not (more.isEmpty() and across.isEmpty()):
        joined = components(links.unionByName(more).unionByName(across))
    joined = staged(joined, "components")
    discard(members, rest, sets)
    return signed.select("doc_id", "mark", "n", "node"), joined


def _grouped(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, mark, n, group, first) per row: its group (an empty set is alone with its row) and the group's first row."""
    rows, joined = near_components(docs, shingle, percent)
    # a set without shingles links with nothing: rows that hold one stand for themselves
    alone = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("mark").cast("string")).cast("binary")
    grouped = rows.join(joined, "node", "left").withColumn("group", F.when(F.col("n") > 0, F.coalesce("component", "node")).otherwise(alone))
    first = grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first"))
    return grouped.select("doc_id", "mark", "n", "group").join(first, "group")


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id it reaches over links) and kept (it is that one).

    A text without words has no shingles and links with nothing. Rows that share a doc_id are rows of their own: each
    has the links of its own text. A null doc_id takes part; component_id is null where only such rows are joined, and
    then the row with the least text hash is kept. Rows equal in id and text have equal results. An empty table gives
    an empty one.
    """
    found = _grouped(docs, shingle, percent)
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("first.none") == F.col("doc_id").isNull())
    kept = own & (F.col("doc_id").isNotNull() | (F.col("mark") == F.col("first.mark")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), kept.alias("kept"))


def keep_representatives(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each near-duplicate group, the one of the least doc_id (nulls last, then by text hash);
    its columns stay as they came. Rows equal in id and text stay or go together."""
    found = _grouped(docs, shingle, percent)
    key = lambda i, m: F.struct(i.isNull().alias("none"), i.cast("long").alias("doc_id"), m.alias("mark"))
    other = found.where(key(F.col("doc_id"), F.col("mark")) != F.col("first")).select(key(F.col("doc_id"), F.col("mark")).alias("row")).distinct()
    dropped = staged(other.select(F.col("row.none").alias("none"), F.coalesce("row.doc_id", F.lit(0)).alias("id"), F.col("row.mark").alias("mark")), "dropped")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    keyed = whole.withColumns({"none": F.col("doc.doc_id").isNull(), "id": F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(0)), "mark": F.xxhash64(text_of("doc.text"))})
    return keyed.join(dropped, ["none", "id", "mark"], "left_anti").select("doc.*")
