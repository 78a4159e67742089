"""Repeated-substring removal by suffix order (operator 8).

Every byte that some repeated string of `length` bytes covers is removed; repeats may lie in one text or in several.

A window of `length` bytes is named by its anchor: the k-byte gram with the least hash in it (leftmost of equals). Equal
windows have equal anchors at equal places, so the windows of one anchor hash form a group that can be judged alone, and
windows whose anchor occurs once in the corpus are unique. The windows of one anchor occurrence are consecutive; the
bytes they span are a slice. Equal slices of a group are counted, not gathered: from two on, all their windows repeat.
Only groups with several different slices are left. Their distinct slices are laid out as one text, its Burrows-Wheeler
transform is built, and intervals are expanded breadth first: backward extension of the intervals of prefix length v
yields those of v + 1 and with them the common-prefix boundaries by increasing value, up to `length`. Suffixes that no
boundary below `length` separates share a window.

A group with more than GROUP_SLICES different slices is judged on single windows instead (k = length: every window is
its own anchor), which are counted before they are shuffled. So no group, however hot, is gathered in one task.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import ramp, text_of
from tidemark.llm.shingles import mixed
from tidemark.staging import discard, staged

LENGTH, GRAM = 200, 64
#: different slices of one anchor up to which they are ordered together
GROUP_SLICES = 4096
#: bytes that are hashed at once
PIECE = 1 << 18

_RANDOM = np.random.default_rng(0xB17E)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 2**64))
ANCHORS = "doc_id long, mark long, first int, last int, anchor long, slice long"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _ODD, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def window_runs(raw: np.ndarray, bounds: np.ndarray, length: int, gram: int, tables: tuple[np.ndarray, np.ndarray]):
    """Per run of windows with one anchor: text, first and last window start, anchor hash, hash of the bytes they span.

    `raw` holds texts one after another between `bounds`.
    """
    n = len(raw)
    up, down = tables
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], dtype=np.uint64, out=total[1:])
    grams = mixed((total[gram:] - total[:n - gram + 1]) * down[:n - gram + 1])
    reach = length - gram + 1  # grams in a window
    bits = np.uint64(34)  # 30 bits of hash decide, then the place: the same choice in every batch, whatever its size
    packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    rows = -(-len(packed) // reach)
    padded = np.full(rows * reach, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(packed)] = packed
    table = padded.reshape(rows, reach)
    ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(table, axis=1).ravel()
    least = np.minimum(ahead[:len(packed) - reach + 1], behind[reach - 1:len(packed)])
    sizes = np.diff(bounds)
    long_ = np.flatnonzero(sizes >= length)
    counts = sizes[long_] - length + 1
    starts = ramp(bounds[:-1][long_], counts)
    text = np.repeat(long_, counts)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    last = starts[np.append(at[1:], len(starts)) - 1]
    first, text, anchor = starts[at], text[at], anchor[at]
    span = mixed((total[last + length] - total[first]) * down[first] + (last - first).astype(np.uint64))
    base = bounds[:-1][text]
    return text, first - base, last - base, grams[anchor], span


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PIECE bytes together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _runs_of(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    tables = _powers(PIECE)
    for batch in batches:
        coded = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
        for a, b in _pieces(coded):
            raw = np.frombuffer(b"".join(coded[a:b]), np.uint8)
            if len(raw) < length:
                continue
            if len(raw) >= len(tables[0]):
                tables = _powers(len(raw))
            bounds = np.cumsum([0] + [len(t) for t in coded[a:b]])
            text, first, last, anchor, span = window_runs(raw, bounds, length, gram, tables)
            row = pa.array(text + a)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(anchor.view(np.int64)), pa.array(span.view(np.int64))],
                names=["doc_id", "mark", "first", "last", "anchor", "slice"])


PACK = 7  # symbols of 9 bits in one sort key


def _suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` symbols, and the sorted keys of their first PACK symbols.

    The first sort takes PACK symbols at once, every later one doubles what is compared.
    """
    n = len(symbols)
    key = np.zeros(n, np.int64)
    for j in range(PACK):
        key <<= 9
        key[:n - j] |= symbols[j:]
    order = np.argsort(key)
    packed, span = key[order], PACK
    while True:
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
        if span >= depth or int(rank[order[-1]]) == n - 1:
            return order, packed
        key = rank * np.int64(n + 1)
        key[:n - span] += rank[span:] + 1
        order = np.argsort(key)
        span *= 2


def repeated_starts(slices: list[bytes], length: int) -> list[np.ndarray]:
    """Per slice, the starts of its `length`-byte windows that occur elsewhere in these slices.

    A slice ends in a symbol that bytes do not have, so no window runs over an end.
    """
    if not slices:
        return []
    sizes = np.array([len(s) for s in slices])
    n = int(sizes.sum()) + len(slices)
    ends = np.cumsum(sizes + 1) - 1
    body = np.ones(n, bool)
    body[ends] = False
    symbols = np.zeros(n, np.int64)
    symbols[body] = np.frombuffer(b"".join(slices), np.uint8).astype(np.int64) + 1
    order, packed = _suffix_order(symbols, length)
    before = symbols[order - 1]  # the transform; what precedes the first suffix is the last end
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    step = place[order - 1]  # backward step: where the suffix one symbol longer stands
    # boundaries between neighbours by their common prefix, once it is known; the packed keys give those below PACK
    prefix = np.full(n + 1, -1, np.int16)
    prefix[0] = prefix[n] = 0
    differ = packed[1:] ^ packed[:-1]
    heads = np.flatnonzero(differ) + 1
    prefix[heads] = sum((differ[heads - 1] >> 9 * j == 0).astype(np.int16) for j in range(1, PACK))
    low, high = np.concatenate([[0], heads]), np.append(heads, n)
    for v in range(PACK, length):
        # backward extension of every interval of prefix length v; matches stop at an end
        count = high - low
        rows, owner = ramp(low, count), np.repeat(np.arange(len(low)), count)
        good = before[rows] > 0
        rows, owner = rows[good], owner[good]
        if not len(rows):
            break
        kind = owner * 257 + before[rows]
        by = np.argsort(kind)
        kind, to = kind[by], step[rows[by]]
        first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        low, high = np.minimum.reduceat(to, first), np.maximum.reduceat(to, first) + 1
        fresh = prefix[high] == -1
        low, high = low[fresh], high[fresh]
        prefix[high] = v
        if not len(low):
            break
    same = prefix[1:n] == -1  # neighbours with a common prefix of at least `length`
    shared = np.zeros(n, bool)
    shared[:-1] |= same
    shared[1:] |= same
    found = np.zeros(n, bool)
    found[order[shared]] = True
    return [np.flatnonzero(found[e - s:e - length + 1]) if s >= length else np.zeros(0, np.int64) for e, s in zip(ends.tolist(), sizes.tolist())]


def _as_spans(starts: np.ndarray, length: int) -> list[int]:
    """Starts of windows to bounds [from, to, from, to, ...] of the bytes they cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return np.stack([starts[np.concatenate([[0], cut + 1])], starts[np.append(cut, len(starts) - 1)] + length], axis=1).ravel().tolist()


def covered_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, mark, spans): byte bounds of repeated stretches, in pieces that may overlap; texts without any are absent."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("mark"), text_of().alias("text"))

    def runs(batches):
        return _runs_of(batches, length, gram)

    anchors = staged(rows.mapInArrow(runs, ANCHORS), "anchors")
    sample = F.struct("doc_id", "mark", "first", "last")
    slices = staged(anchors.groupBy("anchor", "slice").agg(F.count("*").alias("times"), F.min(sample).alias("at")), "slices")
    groups = slices.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("times").alias("all")).where("all > 1")
    alive = staged(slices.join(groups, "anchor").select("anchor", "slice", "times", "at", "kinds"), "repeating")
    discard(slices)
    whole = alive.where("times > 1").select("anchor", "slice", F.array(F.lit(0), F.expr("at.last - at.first") + length).alias("spans"))
    apart = alive.where(f"kinds > 1 AND kinds <= {GROUP_SLICES}")
    # one text per distinct slice: fetched by its first occurrence, many slices of a text at once
    wanted = apart.groupBy("at.doc_id", "at.mark").agg(F.collect_list(F.struct("anchor", "slice", "at.first", "at.last")).alias("cuts")).select(F.col("doc_id").alias("w_id"), F.col("mark").alias("w_mark"), "cuts")
    held = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark"))).select("text", "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                anchor, name, data = [], [], []
                for text, cuts in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    raw = text.encode("utf-8", "surrogatepass")
                    for c in cuts:
                        anchor.append(c["anchor"])
                        name.append(c["slice"])
                        data.append(raw[c["first"]:c["last"] + length])
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(name, pa.int64()), pa.array(data, pa.binary())], names=["anchor", "slice", "data"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; whole groups are put together up to about PIECE * 4 bytes and ordered at once."""
        anchor, name, data, size = [], [], [], 0

        def flush(n):
            pairs = {}
            for i in range(n):
                pairs[(anchor[i], name[i])] = data[i]
            found = repeated_starts(list(pairs.values()), length)
            keys = list(pairs)
            spans = [_as_spans(s, length) for s in found]
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(spans, pa.list_(pa.int32()))], names=["anchor", "slice", "spans"])

        for batch in batches:
            for x, y, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if size > 4 * PIECE and x != anchor[-1]:
                    yield flush(len(anchor))
                    anchor, name, data, size = [], [], [], 0
                anchor.append(x)
                name.append(y)
                data.append(z)
                size += len(z)
        if anchor:
            yield flush(len(anchor))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = held.mapInArrow(cut, "anchor long, slice long, data binary").repartition(parts, "anchor").sortWithinPartitions("anchor")
    judged = staged(ordered.mapInArrow(judge, "anchor long, slice long, spans array<int>"), "judged")
    known = staged(judged.where("size(spans) > 0").unionByName(whole).groupBy("anchor", "slice").agg(F.flatten(F.collect_list("spans")).alias("spans")), "known")
    discard(judged)
    moved = F.expr("transform(spans, x -> x + first)")
    covered = anchors.join(known, ["anchor", "slice"]).select("doc_id", "mark", moved.alias("spans"))
    hot = alive.where(f"kinds > {GROUP_SLICES}")
    if not hot.isEmpty():
        covered = covered.unionByName(_single_windows(rows, anchors, hot.select("anchor").distinct(), length))
    return covered


def _single_windows(rows: DataFrame, anchors: DataFrame, hot: DataFrame, length: int) -> DataFrame:
    """Windows of hot anchors one by one: each is named by the hash of all its bytes and counted before the shuffle."""
    wanted = anchors.join(hot, "anchor").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("runs")).select(F.col("doc_id").alias("w_id"), F.col("mark").alias("w_mark"), "runs")
    held = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark"))).select("doc_id", "mark", "text", "runs")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(2)[i].as_py().encode("utf-8", "surrogatepass")
                starts = [s for r in batch.column(3)[i].as_py() for s in range(r["first"], r["last"] + 1)]
                names = [hashlib.blake2b(raw[s:s + length], digest_size=16).digest() for s in starts]
                row = pa.array(np.full(len(starts), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(starts, pa.int32()), pa.array(names, pa.binary())], names=["doc_id", "mark", "first", "window"])

    single = staged(held.mapInArrow(name, "doc_id long, mark long, first int, window binary"), "windows")
    often = single.groupBy("window").count().where("count > 1").select("window")
    return single.join(often, "window").select("doc_id", "mark", F.array("first", F.col("first") + length).alias("spans"))


def repeats_removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and kept_text.

    Null texts are empty, and texts shorter than `length` are left alone. Rows that repeat an id and a text repeat
    each other's bytes. kept_text is the rest, undecodable cut characters replaced. An empty table gives none.
    """
    found = covered_spans(docs, length, gram).groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans")).select(F.col("doc_id").alias("s_id"), F.col("mark").alias("s_mark"), "spans")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("mark"), text_of().alias("text"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("mark") == F.col("s_mark")), "left").select("doc_id", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sizes, removed, runs, digest, kept = [], [], [], [], []
                for text, spans in zip(batch.column(1).to_pylist(), batch.column(2)):
                    raw = text.encode("utf-8", "surrogatepass")
                    bounds = np.asarray(spans.values) if spans.is_valid else np.zeros(0, np.int64)
                    depth = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(depth, bounds[::2], 1)
                    np.add.at(depth, bounds[1::2], -1)
                    gone = np.cumsum(depth)[:-1] > 0 if len(bounds) else np.zeros(len(raw), bool)
                    rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    sizes.append(len(raw))
                    removed.append(len(raw) - len(rest))
                    runs.append(int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(raw) else 0)
                    digest.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest), pa.array(kept)],
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
