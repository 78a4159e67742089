"""Repair of damaged conversations by weighted interval parsing (operator 12).

A conversation is in order if its role initials read `(s?(ua)+)?`. Its grammar has one nonterminal X(p, q) for every
pair of states of that pattern: X(p, q) derives the spans of rows that lead from p to q. In Chomsky normal form

    X(p, q) -> X(p, r) X(r, q)      X(p, q) -> one edited row      X(p, q) -> nothing, or inserted turns only

with a weight per edit. A span's cell holds, for every nonterminal, the least (cost, audit): the cheapest edits and
among those the ASCII-least string of their initials. Cells are closed under insertion, and spans are combined bottom
up by length: 1, 2, 4, 8, ... Audits of one cost over one span are never prefixes of one another (a longer one has one
insertion more), so the least of a joined span is the join of the leasts; and as every row of a parse stands between
two states, each way to split a span gives the same cell, so one split a span is enough.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# The pattern's states (start, after s, after u, after a), its steps by role initial, and costs of edits.
STATES = 4
STEPS = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}
ACCEPTING = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
ROLE = {"u": "user", "a": "assistant"}

Best = tuple[int, str]
#: (p, q) -> the least (cost, audit)
Cell = dict[tuple[int, int], Best]


def joined(left: Cell, right: Cell) -> Cell:
    out: Cell = {}
    for ((p, r), (c1, a1)), ((r2, q), (c2, a2)) in product(left.items(), right.items()):
        if r == r2:
            found = (c1 + c2, a1 + a2)
            if (p, q) not in out or found < out[p, q]:
                out[p, q] = found
    return out


def _closure() -> Cell:
    """The cell of an empty span: inserted user and assistant turns, as many as pay."""
    one: Cell = {(p, p): (0, "") for p in range(STATES)}
    one |= {step: (INSERT, "I") for initial in "ua" for step in STEPS[initial]}
    while (more := joined(one, one)) != one:
        one = more
    return one


NOTHING = _closure()


@lru_cache(None)
def row_cell(kind: str) -> Cell:
    """The cell of one row: its role initial (`-` for any other), upper case if truncated; `x` must be deleted."""
    out: Cell = {(p, p): (DELETE, "D") for p in range(STATES)}
    if kind != "x":
        extra = TRUNCATED if kind.isupper() or kind == "=" else 0
        for initial in "ua":
            out |= {step: (REROLE + extra, "R") for step in STEPS[initial]}
        out |= {step: (extra, "K") for step in STEPS.get(kind.lower(), [])}
    return joined(joined(NOTHING, out), NOTHING)


def parse(kinds: str) -> Best:
    """The least (cost, audit) that brings rows of these kinds in order."""
    cells = [row_cell(k) for k in kinds] or [NOTHING]
    while len(cells) > 1:  # spans of doubled length from neighbouring ones
        cells = [joined(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return min(cells[0][0, q] for q in ACCEPTING if (0, q) in cells[0])


@lru_cache(50_000)
def _known_parse(kinds: str) -> Best:
    return parse(kinds)


def applied(audit: str, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """The turns that the edits leave. Past an optional system turn, users and assistants alternate."""
    out_roles, out_texts, row = [], [], 0
    for edit in audit:
        if edit != "D":
            opened = bool(out_roles) and out_roles[0][:1] == "s"
            due = ROLE["ua"[(len(out_roles) - opened) % 2]]
            out_roles.append(roles[row] if edit == "K" else due)
            out_texts.append("" if edit == "I" else texts[row])
        row += edit != "I"
    return out_roles, out_texts


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) after the damage of crc32(`conv_id:turn`) % 20: 0 drops the row (kept here,
    marked gone), 1 empties its text, 2 takes its `.!?`, 3 repeats it, 4 makes it a user's. Nulls read as one space."""
    spelt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    text, code = spelt("text"), F.col("code")
    coded = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spelt("role").alias("role"), text.alias("text"),
        F.pmod(F.crc32(F.concat(spelt("conv_id"), F.lit(":"), spelt("turn")).cast("binary")), F.lit(20)).alias("code"))
    new_text = F.when(code == 1, "").when(code == 2, F.translate("text", ".!?", "")).when(code != 0, F.col("text"))
    out = coded.select("conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"), new_text.alias("text"), (code == 0).alias("gone"),
                       F.explode(F.array_repeat(F.lit(0), F.when(code == 3, 2).otherwise(1))).alias("copy"))
    return out.drop("copy")


def _last(text: Column) -> Column:
    """The last character that is not blank; empty where there is none."""
    return F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))


def _one(key: int | None, turns: list, roles: list, texts: list, lasts: list, gone: list) -> tuple:
    rows = [i for i, g in enumerate(gone) if not g]
    kinds, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for i in rows:
        initial = roles[i][:1] if roles[i][:1] in STEPS else "-"
        if not lasts[i]:
            fault = "blank"
        elif (roles[i], texts[i]) in seen:
            fault = "duplicate"
        else:
            fault = "" if lasts[i] in ".!?" else "truncated"
        seen.add((roles[i], texts[i]))
        if fault:
            counts[fault] += 1
        kinds.append("x" if fault in ("blank", "duplicate") else (initial.upper() if initial != "-" else "=") if fault else initial)
    illegal = sum(roles[a][:1] + roles[b][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    numbers = {turns[i] for i in rows} - {None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    shape = "".join(kinds)
    cost, audit = _known_parse(shape) if len(shape) <= 24 else parse(shape)
    return key, gaps, *counts.values(), illegal, cost, audit, *applied(audit, [roles[i] for i in rows], [texts[i] for i in rows])


NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and the repaired
    `turns` (role, text).

    `rows` holds (conv_id, turn, role, text, gone); rows marked gone only name their conversation. Rows stand by turn,
    nulls first, then by role and text. A null conv_id is a conversation of its own; a role initial other than s, u, a
    fits nowhere. A conversation without rows has zeros and an empty audit. Conversations are read one after another
    from sorted partitions: a task holds the rows of a single one beside its Arrow batch.
    """
    ready = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), "text", _last(F.coalesce("text", F.lit(""))).alias("last"), "gone")
    ordered = ready.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    shape = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in NUMBERS], ("audit", pa.string()), ("turns", pa.list_(turn))])

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        *plain, roles, texts = zip(*done)
        bounds = [0]
        for x in roles:
            bounds.append(bounds[-1] + len(x))
        flat = pa.StructArray.from_arrays([pa.array([v for x in c for v in x], pa.string()) for c in (roles, texts)], fields=list(turn))
        columns = [pa.array(c, f.type) for c, f in zip(plain, shape)] + [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat, type=shape.field("turns").type)]
        return pa.RecordBatch.from_arrays(columns, schema=shape)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(5)]
        key, begun = None, False
        for batch in batches:
            ids, *columns = (c.to_pylist() for c in batch.columns)
            done, at = [], 0
            for i, k in enumerate([*ids, ids[-1]] if ids else []):
                ends = i == len(ids)
                if begun and not ends and k == key:
                    continue
                for h, c in zip(held, columns):
                    h += c[at:i]
                at = i
                if ends:
                    break
                if begun:
                    done.append(_one(key, *held))
                    held = [[] for _ in range(5)]
                key, begun = k, True
            if done:
                yield batch_of(done)
        if begun:
            yield batch_of([_one(key, *held)])

    kinds = ", ".join(f"{c} long" for c in ["conv_id", *NUMBERS])
    return ordered.mapInArrow(walk, f"{kinds}, audit string, turns array<struct<role:string,text:string>>")


def digest(repairs: DataFrame) -> DataFrame:
    """The repairs with the SHA-256 of their turns, `role:text` joined by newlines, instead of the turns."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repairs.select("conv_id", *NUMBERS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))


__all__ = ["applied", "damaged", "digest", "joined", "parse", "repaired"]
