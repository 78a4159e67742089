"""Prefix trie of conversations (operator 11).

Turns become 128-bit ids. Conversations are dealt by range of their id sequence (then conv_id), so every shard holds a
stretch of the trie in order. In a shard the ids form padded matrices, sorted by numpy's lexsort; the changes between
neighbouring rows, OR-accumulated from column to column, mark where a node of each depth starts, and reduceat over
those starts gives every depth its members, leaves and sums. Only the nodes on the paths of a shard's first and last
row can have members elsewhere: those travel as partial sums with a hash of their path, are added up, and pass their
totals up among themselves; there are at most two paths a shard, whatever the number of conversations.

Matrices are cut into blocks of columns, and only rows that go on enter the next block, so one long conversation does
not widen the matrix of all others. Texts are hashed where they are read; a conversation travels as 20 bytes a turn.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import ramp
from tidemark.staging import staged

#: columns of a matrix, turn ids of a shard, conversation ids hashed in one piece
COLUMNS, SHARD_TURNS, PIECE = 16, 1_000_000, 10_000
#: boundary nodes up to which they are broadcast to their children
SMALL = 200_000
#: a conversation takes at most so many turns from the one that it continues
SHARED, FAMILY = 9, 5

EMPTY = hashlib.sha256().hexdigest()


# --- sequences -----------------------------------------------------------------------------------
def sequences(conversations: DataFrame) -> DataFrame:
    """(family, conv_id, turns): every conversation's turns (a, b, n) in order: two halves of the id of (role, text), and
    the text's UTF-8 bytes. Turns stand by number, null first; turns of equal number by their ids. Null texts and roles
    are empty; rows without conv_id belong to no conversation. Rows are dealt by family (conv_id less its remainder)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    id_of = lambda seed: F.xxhash64(F.lit(seed), empty("role"), empty("text"))
    turn = F.struct(F.col("turn").cast("long").alias("at"), id_of(1).alias("a"), id_of(2).alias("b"), F.octet_length(empty("text")).alias("n"))
    conv = F.col("conv_id").cast("long")
    thin = conversations.where("conv_id is not null").select((conv - F.pmod(conv, F.lit(FAMILY))).alias("family"), conv.alias("conv_id"), turn.alias("turn"))
    lists = thin.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return lists.withColumn("turns", F.transform("turns", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["n"].alias("n"))))


def continued(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) where a conversation c begins with the first h turns of conversation c - c mod 5, h being
    crc32(c) mod 9, followed by its own turns after its first h."""
    own = sequences(conversations)
    heads = own.where("conv_id = family").select("family", F.slice("turns", 1, SHARED - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED)).cast("int")
    own = own.withColumn("h", h)
    after = F.filter("turns", lambda t, i: i >= F.col("h"))
    head = F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.greatest("h", F.lit(1))))
    none = F.array().cast(own.schema["turns"].dataType)
    return own.join(heads, "family", "left").select("conv_id", F.concat(F.coalesce(head, none), after).alias("turns"))


# --- one shard -----------------------------------------------------------------------------------
class Level(NamedTuple):
    """Nodes of one depth: the sorted rows that reach it, and where among them each node starts."""

    rows: np.ndarray
    starts: np.ndarray


def levels(conv: np.ndarray, lengths: np.ndarray, codes: np.ndarray, width: int = COLUMNS) -> tuple[np.ndarray, list[Level]]:
    """The order of the rows (by sequence, then conv) and the nodes of depth 1, 2, ... `codes` holds all sequences one
    after another, as numbers in the order of the ids."""
    bounds = np.cumsum(lengths) - lengths
    order, active, group = np.arange(len(conv)), np.arange(len(conv)), np.zeros(len(conv), np.int64)
    out: list[Level] = []
    while len(active):
        done = len(out)
        row = order[active]
        left = lengths[row] - done
        columns = min(width, int(left.max()))
        if columns <= 0 and done:
            break
        taken = np.minimum(left, columns)
        padded = np.full((len(row), columns), -1, np.int64)
        padded[np.repeat(np.arange(len(row)), taken), ramp(np.zeros(len(row), np.int64), taken)] = codes[ramp(bounds[row] + done, taken)]
        sort = np.lexsort((conv[row], *padded.T[::-1], group))
        order[active], padded = row[sort], padded[sort]
        change = np.ones(padded.shape, bool)
        change[1:] = (padded[1:] != padded[:-1]) | (group[1:] != group[:-1])[:, None]
        np.logical_or.accumulate(change, axis=1, out=change)
        for j in range(columns):
            at = np.flatnonzero(padded[:, j] >= 0)
            out.append(Level(active[at], np.flatnonzero(change[at, j])))
        if columns < width:
            break
        on = padded[:, -1] >= 0
        active, group = active[on], np.cumsum(change[:, -1])[on]
    return order, out


def _path_key(before: bytes, a: int, b: int) -> bytes:
    return hashlib.blake2b(before + int(a).to_bytes(8, "little", signed=True) + int(b).to_bytes(8, "little", signed=True), digest_size=16).digest()


ROOT = bytes(16)
KINDS = {"inner": 0, "boundary": 1, "ends": 2}
_COLUMNS = [("kind", pa.int8()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()),
            ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("bytes", pa.int64()), ("ends", pa.string())]
SHAPE = pa.schema(_COLUMNS)
SPELT = "kind byte, key binary, parent_key binary, conv_id long, parent_conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, ends string"


def _batch(**columns) -> pa.RecordBatch:
    n = max(len(c) for c in columns.values())
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in SHAPE], schema=SHAPE)


def shard_nodes(conv: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, width: int = COLUMNS) -> Iterator[pa.RecordBatch]:
    """The trie of one shard's rows: finished inner nodes, partial boundary nodes, and who ends at those."""
    by_id = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[by_id][1:] != a[by_id][:-1]) | (b[by_id][1:] != b[by_id][:-1])
    codes = np.empty(len(a), np.int64)
    codes[by_id] = np.cumsum(new) - 1
    order, found = levels(conv, lengths, codes, width)
    bounds = np.cumsum(lengths) - lengths
    conv, lengths, bounds = conv[order], lengths[order], bounds[order]
    last, depth_of = len(conv) - 1, len(found)
    keys = {0: [ROOT], last: [ROOT]}
    for row, path in keys.items():
        for i in range(bounds[row], bounds[row] + lengths[row]):
            path.append(_path_key(path[-1], a[i], b[i]))
    saved, leaves = np.zeros(last + 1, np.int64), np.zeros(last + 1, np.int64)
    # least member of every node, and which of its depth's nodes lie on a boundary path
    least = [np.array([conv.min()])] + [np.minimum.reduceat(conv[r], s) for r, s in found]
    begins = [np.zeros(1, np.int64)] + [r[s] for r, s in found]
    border = [np.ones(1, bool)]
    for (rows, starts), at in zip(found, begins[1:]):
        edge = np.zeros(len(starts), bool)
        edge[0] |= at[0] == 0
        edge[-1] |= rows[-1] == last
        border.append(edge)
    below = np.zeros(0, np.int64), np.zeros(0, bool)  # starts and edges of the next depth
    for depth in range(depth_of, -1, -1):
        rows, starts = found[depth - 1] if depth else (np.arange(last + 1), np.zeros(1, np.int64))
        at, edge = begins[depth], border[depth]
        members = np.diff(np.append(starts, len(rows)))
        # of an inner node all children are inner; of a boundary node only the inner ones count here
        parents = np.searchsorted(at, below[0][~below[1]], "right") - 1
        children = np.bincount(parents, minlength=len(at))
        size = sizes[bounds[at] + depth - 1] if depth else np.zeros(1, np.int64)
        inner = ~edge
        saved[at[inner]] += ((members - 1) * size)[inner]
        leaves[at[inner & (children == 0)]] = 1
        total_saved, total_leaves = np.add.reduceat(saved[rows], starts), np.add.reduceat(leaves[rows], starts)
        ended = np.add.reduceat(lengths[rows] == depth, starts, dtype=np.int64)
        if depth and inner.any():
            up = np.searchsorted(begins[depth - 1], at[inner], "right") - 1
            on_border = border[depth - 1][up]
            # a child of a boundary node learns its parent's least member later
            key_of = [None if not on else keys[0 if begins[depth - 1][u] == 0 else last][depth - 1] for on, u in zip(on_border.tolist(), up.tolist())]
            texts = [hashlib.sha256(",".join(map(str, conv[p:p + e].tolist())).encode()).hexdigest() if e else EMPTY for p, e in zip(at[inner].tolist(), ended[inner].tolist())]
            yield _batch(kind=np.full(inner.sum(), KINDS["inner"], np.int8), parent_key=key_of, conv_id=least[depth][inner], parent_conv_id=pa.array(least[depth - 1][up], mask=on_border),
                         depth=np.full(inner.sum(), depth), n_convs=members[inner], n_children=children[inner], n_leaves=total_leaves[inner], saved_tokens=total_saved[inner], ends=texts)
        for i in np.flatnonzero(edge).tolist():
            path = keys[0 if at[i] == 0 else last]
            key = path[depth]
            yield _batch(kind=[KINDS["boundary"]], key=[key], parent_key=[path[depth - 1] if depth else None], conv_id=[least[depth][i]], depth=[depth], n_convs=[members[i]], n_children=[children[i]],
                         n_leaves=[total_leaves[i]], saved_tokens=[total_saved[i]], bytes=[size[i]])
            for p in range(at[i], at[i] + ended[i], PIECE):
                piece = conv[p:min(p + PIECE, at[i] + ended[i])].tolist()
                yield _batch(kind=[KINDS["ends"]], key=[key], conv_id=[piece[0]], ends=[",".join(map(str, piece))])
        below = at, edge


def _in_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]  # a shard holds about SHARD_TURNS turns
    if not held:
        return
    whole = pa.Table.from_batches(held)
    lists = whole.column("turns").combine_chunks()
    flat = lists.flatten()
    numbers = [np.asarray(flat.field(c)) for c in ("a", "b", "n")]
    lengths = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    small: list[pa.RecordBatch] = []
    for made in shard_nodes(np.asarray(whole.column("conv_id")), lengths, *numbers[:2], numbers[2].astype(np.int64)):
        small.append(made)
        if sum(x.num_rows for x in small) > 5000:
            yield from pa.Table.from_batches(small).combine_chunks().to_batches(10_000)
            small = []
    if small:
        yield from pa.Table.from_batches(small).combine_chunks().to_batches(10_000)


# --- across shards -------------------------------------------------------------------------------
def _recombined(partial: DataFrame) -> DataFrame:
    """Boundary nodes with whole totals: partial sums are added by key, then every node passes its own part up. The one
    task that does so reads at most two paths a shard."""
    total = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = partial.groupBy("key").agg(F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"), *total)

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = {r["key"]: r for batch in batches for r in batch.to_pylist()}
        # the partial sums hold all inner nodes below; boundary nodes are what is left to pass up
        more = {key: [0, 0] for key in nodes}
        for r in sorted(nodes.values(), key=lambda r: -r["depth"]):
            saved, leaves = more[r["key"]]
            saved, leaves = saved + (r["n_convs"] - 1) * r["bytes"], leaves + (r["n_children"] == 0)
            r["saved_tokens"], r["n_leaves"] = r["saved_tokens"] + saved, r["n_leaves"] + leaves
            if up := nodes.get(r["parent_key"]):
                r["parent_conv_id"] = up["conv_id"]
                up["n_children"] += 1
                above = more[r["parent_key"]]
                above[0], above[1] = above[0] + saved, above[1] + leaves
        rows = list(nodes.values())
        for i in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_pylist(rows[i:i + 5000], schema=shape)

    names = ["key", "conv_id", "parent_conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    shape = pa.schema([SHAPE.field(c) for c in names])
    return merged.repartition(1).mapInArrow(climb, ", ".join(f"{c} {'binary' if c == 'key' else 'long'}" for c in names))


def _ends(pieces: DataFrame) -> DataFrame:
    """(key, ends): the SHA-256 over a node's pieces in order, read as a stream, so a node's members are never held."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != key:
                    done += [(key, state.hexdigest())] if state else []
                    key, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in ((0, pa.binary()), (1, pa.string()))], names=["key", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends"])

    return pieces.select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(walk, "key binary, ends string")


def trie(rows: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie over (conv_id, turns): conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Members of a node are the conversations that start with its turns; the root (depth 0, no parent) has them all,
    those without turns too. saved_tokens sums (n_convs - 1) times the bytes of the last turn over the node's subtree;
    ends_sha256 is taken of the ascending ids of the members that end there, joined by commas. Equal sequences may lie
    in several shards, in order of conv_id. An empty table has no nodes.
    """
    rows = staged(rows, "sequences")
    count = rows.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    parts = max(1, -(-count // shard_turns), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) if count > 50_000 else 1)
    flat = F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"])))
    dealt = rows.select("conv_id", "turns", flat.alias("ids")).repartitionByRange(parts, "ids", "conv_id").select("conv_id", "turns")
    made = staged(dealt.mapInArrow(_in_shard, SPELT), "nodes")
    boundary = staged(_recombined(made.where(F.col("kind") == KINDS["boundary"])), "boundary")
    whole = boundary.join(_ends(made.where(F.col("kind") == KINDS["ends"])), "key", "left")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    inner = made.where(F.col("kind") == KINDS["inner"])
    known = boundary.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"))
    if boundary.count() <= SMALL:
        known = F.broadcast(known)
    inner = inner.join(known, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up"))
    ends: Column = F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256")
    return inner.select(*names, ends).unionByName(whole.select(*names, ends))


__all__ = ["continued", "levels", "sequences", "shard_nodes", "trie"]
