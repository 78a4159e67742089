"""Prefix trie, turn repair and sharding against plain statements, on odd and lopsided tables."""
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie, sharding, turn_repair
from tidemark.llm.queries import op13_sharding

SCHEMA = "conv_id long, turn long, role string, text string"
CLASHES = ["family", "turns", "head", "h", "code", "copy", "gone", "last", "key", "kind", "ids", "up", "k1", "part", "place", "size", "doc", "shard", "slot", "base"]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(c) for c in CLASHES}) if extra else df


def some_conversations(seed=3, n=60):
    r = random.Random(seed)
    texts = ["Hello there.", "What is it?", "No end", "Fine!", "", " \t", "übrig。", "a" * 300 + "."]
    rows = []
    for c in range(n):
        for t in range(r.randrange(0, 12)):
            rows.append((c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), r.choice([*texts, None])))
    # one opening of a third of all, whole repeats, a gap in the numbers, very long ones
    for c in range(n, n + 30):
        rows += [(c, 0, "user", "Hello there."), (c, 1, "assistant", "Fine!")]
    rows += [(200, t * 3, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(150)] + [(201, t * 3, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(150)]
    rows += [(300, None, None, None), (301, 0, "user", "x" * 50_000), (-3, 0, "user", "below zero."), (302, 5, "user", "twice."), (302, 5, "user", "twice.")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return some_conversations()


# --- 11 ------------------------------------------------------------------------------------------
def plain_trie(full):
    """Node -> values, from every prefix of every sequence of (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    for node, who in members.items():
        under = [x for x in members if x[:len(node)] == node]
        kids = lambda x: sum(len(y) == len(x) + 1 and y[:len(x)] == x for y in under)
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), kids(node), sum(kids(x) == 0 for x in under),
                    sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x), hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return Counter(out)


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        own[c].append((t is not None, t or 0, role or "", text or ""))
    ids = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    out = {}
    for c, turns in ids.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = ids.get(c - c % 5, [])[:h] + turns[h:]
    return out


def unique_turns(rows):
    """Turn numbers without ties: tied turns stand in an order of their ids."""
    seen, out = set(), []
    for r in rows:
        if (r[0], r[1]) not in seen:
            out.append(r)
            seen.add((r[0], r[1]))
    return out


@pytest.mark.parametrize("shard", [10**6, 60, 1])
def test_trie(spark, rows, shard):
    some = [r for r in unique_turns(rows) if r[0] < 100] + [(c, t, "user", f"same {t}") for c in range(1000, 1040) for t in range(30)]
    got = prefix_trie.trie(prefix_trie.continued(frame(spark, [*some, (None, 0, "user", "nobody's")])), shard)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain_trie(rebuilt(some))


def test_trie_of_nothing_and_of_ties(spark, rows):
    empty = frame(spark, rows).limit(0)
    assert prefix_trie.trie(prefix_trie.continued(empty)).count() == 0
    tied = [(5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (6, 1, "user", "a"), (6, 1, "user", "b"), (6, 1, "user", "a")]
    made = prefix_trie.sequences(frame(spark, tied)).collect()
    assert len(made) == 2 and made[0].turns == made[1].turns and len(made[0].turns) == 3
    assert prefix_trie.trie(prefix_trie.continued(frame(spark, rows))).where("depth = 0").first().n_convs == len({r[0] for r in rows})


@pytest.mark.parametrize("width", [1, 3, 16])
def test_levels_do_not_depend_on_the_block_width(width):
    r = np.random.default_rng(2)
    lengths = r.integers(0, 9, 40)
    codes = r.integers(0, 2, lengths.sum())
    order, found = prefix_trie.levels(np.arange(40)[::-1].copy(), lengths, codes, width)
    bounds = np.cumsum(lengths) - lengths
    seqs = [codes[bounds[i]:bounds[i] + lengths[i]].tolist() for i in order]
    assert seqs == sorted(seqs)
    for depth, (at, starts) in enumerate(found, 1):
        assert at.tolist() == [i for i, s in enumerate(seqs) if len(s) >= depth]
        assert len(starts) == len({tuple(s[:depth]) for s in seqs if len(s) >= depth})


# --- 12 ------------------------------------------------------------------------------------------
def damage(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        out[c] += []
        if code == 0:
            continue
        text = "" if code == 1 else "".join(x for x in text if x not in ".!?") if code == 2 else text
        out[c] += [((t is not None, t or 0), "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return {c: sorted(v) for c, v in out.items()}


def cheapest(kinds):
    """Least (cost, audit) by trying every edit; at most two insertions stand in a row."""
    steps = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}
    best = [(10**9, "")]

    def go(i, state, cost, audit, inserted):
        if cost > best[0][0]:
            return
        if i == len(kinds) and state in (0, 3):
            best[0] = min(best[0], (cost, audit))
        moves = [(p, q, x) for x in "ua" for p, q in steps[x] if p == state]
        if inserted < 2:
            for _, q, _ in moves:
                go(i, q, cost + 2, audit + "I", inserted + 1)
        if i < len(kinds):
            initial, must, cut = kinds[i]
            go(i + 1, state, cost + 3, audit + "D", 0)
            if not must:
                for _, q, _ in moves:
                    go(i + 1, q, cost + 2 + cut, audit + "R", 0)
                for p, q in steps.get(initial, []):
                    if p == state:
                        go(i + 1, q, cost + cut, audit + "K", 0)

    go(0, 0, 0, "", 0)
    return best[0]


def plain_repair(turns):
    seen, kinds, faults = set(), [], Counter()
    for _, role, text in turns:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    numbers = {t for (known, t), _, _ in turns if known}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    cost, audit = cheapest(kinds)
    out, i = [], 0
    for e in audit:
        if e != "D":
            due = ["user", "assistant"][(len(out) - (bool(out) and out[0][0] == "s")) % 2]
            out.append(f"{turns[i][1] if e == 'K' else due}:{'' if e == 'I' else turns[i][2]}")
        i += e != "I"
    return (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_repair(spark, rows):
    some = [r for r in rows if r[0] < 100 or r[0] >= 300] + [(None, 0, "user", "nobody's."), (None, 1, "assistant", "Yes.")]
    got = turn_repair.digest(turn_repair.repaired(turn_repair.damaged(frame(spark, some)))).collect()
    want = {c: plain_repair(v) for c, v in damage(some).items()}
    assert len(got) == len(want) and {r.conv_id: tuple(r)[1:] for r in got} == want
    assert turn_repair.repaired(turn_repair.damaged(frame(spark, rows).limit(0))).count() == 0


def test_a_split_conversation_of_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in (1, 2, 3) for t in range(40)]
        got = {r.conv_id: r for r in turn_repair.repaired(frame(spark, turns).withColumn("gone", F.lit(False))).collect()}
        assert set(got) == {1, 2, 3} and all(r.audit == "K" * 40 and [t.text for t in r.turns] == [f"{c} {t}." for t in range(40)] for c, r in got.items())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_split_of_a_span_is_as_good_as_all():
    r = random.Random(5)
    for size in range(1, 9):
        for _ in range(25):
            kinds = "".join(r.choice("suaSUA-=x") for _ in range(size))
            cells = {(i, i + 1): turn_repair.row_cell(k) for i, k in enumerate(kinds)}
            for n in range(2, size + 1):
                for i in range(size - n + 1):
                    ways = [turn_repair.joined(cells[i, k], cells[k, i + n]) for k in range(i + 1, i + n)]
                    assert all(w == ways[0] for w in ways)
                    cells[i, i + n] = ways[0]
            assert turn_repair.parse(kinds) == min(cells[0, size][0, q] for q in (0, 3))


# --- 13 ------------------------------------------------------------------------------------------
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def check_shards(got, count):
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) <= set(range(count))
    for members in by.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    return by


@pytest.mark.parametrize("part_bytes", [1 << 30, 3000])
def test_shards(spark, part_bytes):
    r = random.Random(8)
    texts = ["copy of one text " * 3] * 500 + ["".join(r.choice("abcd é") for _ in range(r.randrange(0, 80))) for _ in range(1000)] + [None, "", "", None]
    rows = [(i if i % 7 else None, t, None, "s", 1) for i, t in enumerate(texts)] + [(None, "copy of one text " * 3, None, "s", 1)] * 200
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in CLASHES}).repartition(5)
    got = sharding.sharded(docs, 8, part_bytes=part_bytes).collect()
    want = Counter((i, t, len((t or "").encode()) + 8) for i, t, *_ in rows)
    assert Counter((r.doc.doc_id, r.doc.text, r.size) for r in got) == want and all(r.doc.key == "key" for r in got)
    by = check_shards(got, 8)
    share = sum(r.size for r in got) / 8
    assert all(abs(sum(r.size for r in m) - share) <= 0.03 * share + 60 for m in by.values())
    # the group of a third of all rows is cut, the others stay whole
    where = defaultdict(set)
    for r in got:
        where[r.doc.text or ""].add(r.shard)
    cut = [t for t, s in where.items() if len(s) > 1]
    assert len(cut) <= 2 and any(t.startswith("copy") for t in cut)


def test_shards_of_few_rows(spark):
    none = spark.createDataFrame([], DOCS)
    assert sharding.sharded(none).count() == 0
    few = spark.createDataFrame([(1, "x" * 100_000, None, "s", 1), (2, "y", None, "s", 1), (2, "y", None, "s", 1)], DOCS)
    got = sharding.sharded(few, 4).collect()
    check_shards(got, 4)
    assert sorted(r.size for r in got) == [9, 9, 100_008]


def test_written_shards_are_what_was_dealt(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}" * (i % 9), None, "s", 1) for i in range(300)], DOCS)
    back = sharding.write_shards(docs, str(tmp_path / "shards"), 6).collect()
    check_shards(back, 6)
    assert sorted((r.doc.doc_id, r.doc.text) for r in back) == sorted((r.doc_id, r.text) for r in docs.collect())


def test_cells_are_found_in_order_of_whole_keys():
    r = random.Random(4)
    keys = sorted((r.randrange(4), r.randrange(-2, 3), r.randrange(3)) for _ in range(300))
    low = sharding.LOWEST
    probes = sorted({(r.randrange(4), *r.choice([(low, low), (r.randrange(-2, 3), low), (r.randrange(-2, 3), r.randrange(3))])) for _ in range(25)})
    found = sharding.cell_of(np.array(probes, np.int64), [np.array(c, np.int64) for c in zip(*keys)])
    assert found.tolist() == [sum(p <= k for p in probes) for k in keys]


def test_the_query_keeps_the_contract(spark):
    got = op13_sharding(spark, "/root/testdata/sf0.001")
    rows = got.collect()
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts.items()}
    check_shards(rows, 24)
