"""License scans (operator 6): base phrases, and an exact set-similarity join of text blocks with license templates.

Two kinds of blocks are met. One is a line, or a stretch of a longer line (BLOCK words, half of them shared with the
next); a template matches it if it holds at least `threshold` of the template's distinct tokens. The other is cut from
the words of the whole text, whatever its lines: a template of m words also matches where some stretch of REACH * m
words of the text, from one of its tokens on, holds that many of them, so that wrapped notices and full license texts
are found. Licenses that differ in a word are told apart by it: a template names tokens that must be there and tokens
that forbid it ("affero" forbids the plain GPL), in the matched line or stretch.

A text is cut into words once. What is kept of it are its counts, its base places and the template tokens it holds at
all; these give the tokens' order (rarest first, by the number of texts that hold them) and the texts that could match
a template: of a template with n tokens that needs k of them, a block must hold one of the first n - k + 1 (prefix
filter) and at least k template tokens (length filter), and from the first common token on enough must be left on both
sides (positional filter). As a text holds what its blocks hold, the same join over whole texts leaves few, and only
those are cut into blocks, joined again and verified on the whole sets. Only expressions of the engine run; what is
broadcast or sent to the driver has the size of the templates, or is counted before.
"""
from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import text_of
from tidemark.llm.words import words
from tidemark.staging import staged

# Phrases and labels of the base scan.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


# Opening words of public licenses, and usual notices.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the terms of the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under bsd license"),
    ("bsd", "released under the terms of the bsd license"),
    ("bsd", "use of this source code is governed by a bsd style license that can be found in the license file"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "released under the terms of the gpl license"),
    ("lgpl", "gnu lesser general public"),
    ("lgpl", "gnu library general public"),
    ("agpl", "gnu affero general public"),
    ("mpl-2", "mozilla public license 2"),
    ("mpl-2", "licensed under the mozilla license version 2 0"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "creative commons attribution noderivatives"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "cc0 1 0 universal"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
]
# What tells a license from its neighbours: its label's rivals are named by a word, which the matched line or stretch
# must hold (first) or must not hold (second).
_OTHER_GPL, _OTHER_CC = "lesser library affero", "noncommercial sharealike noderivatives nc sa nd"
TELLING = {
    "released under the terms of the mit license": ("mit license", ""), "licensed under the mit license": ("mit license", ""),
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": ("apache 2", ""),
    "licensed under the apache license version 2 0": ("apache license 2", ""),
    "licensed under bsd license": ("bsd license", ""), "released under the terms of the bsd license": ("bsd license", ""),
    "use of this source code is governed by a bsd style license that can be found in the license file": ("bsd", ""),
    "gnu general public license version 3": ("gnu general public 3", _OTHER_GPL), "gnu general public license version 2": ("gnu general public 2", _OTHER_GPL),
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": ("gnu general public", _OTHER_GPL),
    "released under the terms of the gpl license": ("gpl license", ""),
    "gnu lesser general public": ("gnu lesser general public", ""), "gnu library general public": ("gnu library general public", ""), "gnu affero general public": ("gnu affero general public", ""),
    "mozilla public license 2": ("mozilla public license 2", ""), "licensed under the mozilla license version 2 0": ("mozilla license 2", ""),
    "creative commons attribution 4 0 international license": ("creative commons attribution", _OTHER_CC), "licensed under cc by 4 0": ("cc by", _OTHER_CC),
    "creative commons attribution sharealike": ("creative commons sharealike", "noncommercial"), "licensed under cc by sa 4 0": ("cc by sa", "nc"),
    "creative commons attribution noderivatives": ("creative commons noderivatives", "noncommercial"), "licensed under cc by nd 4 0": ("cc by nd", "nc"),
    "creative commons attribution noncommercial": ("creative commons noncommercial", ""),
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": ("commons noncommercial", ""),
    "licensed under cc by nc 4 0": ("cc by nc", ""), "cc0 1 0 universal": ("cc0", ""),
}
BLOCK = 64
#: a stretch of the whole text has so many times the words of the template
REACH = 2
#: texts that may match, up to which their keys are broadcast to fetch them
SMALL = 500_000


def _key(column="text"):
    return F.xxhash64(text_of(column)).alias("mark")


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, block, w): the words of every block of every line."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(), F.posexplode(F.split(text_of(), "\n")).alias("line", "t")).select("doc_id", "mark", "line", words(F.col("t")).alias("w"))
    cut = F.when(F.size("w") <= BLOCK, F.array("w")).otherwise(F.transform(F.sequence(F.lit(0), F.size("w") - BLOCK // 2, F.lit(BLOCK // 2)), lambda i: F.slice("w", i + 1, BLOCK)))
    long_ = lines.select("doc_id", "mark", "line", F.posexplode(cut).alias("part", "w"))
    return long_.where(F.size("w") > 0).select("doc_id", "mark", F.struct("line", "part").alias("block"), "w")


def passages(docs: DataFrame, reach: int) -> DataFrame:
    """(doc_id, mark, block, w): blocks of 2 * reach words of the whole text, one from every multiple of `reach` on, so
    that the `reach` words from any place on lie within the block that holds the place in its first half."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(), words(F.col("text")).alias("all"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("all") - 1), F.lit(reach))
    cut = F.transform(starts, lambda i: F.struct(i.alias("block"), F.slice("all", i + 1, 2 * reach).alias("w")))
    return texts.where(F.size("all") > 0).select("doc_id", "mark", F.explode(cut).alias("s")).select("doc_id", "mark", "s.*")


class _Index(NamedTuple):
    """The templates' tokens, ordered by the number of texts that hold them."""

    place: dict[str, int]
    rows: list[tuple]
    index: list[tuple]


def _vocabulary(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({t for _, text in templates for t in text.split()})


def telling(text: str) -> tuple[list[str], list[str]]:
    """The words that a match of this template must hold, and those it must not hold."""
    must, never = TELLING.get(text, ("", ""))
    return sorted(set(must.split())), sorted(set(never.split()))


def _indexed(held: DataFrame, templates: list[tuple[str, str]], threshold: float) -> _Index:
    """From (tokens): the template tokens of every text."""
    often = {r["token"]: r["count"] for r in held.select(F.explode("tokens").alias("token")).groupBy("token").count().collect()}  # a row per template token
    place = {t: i for i, t in enumerate(sorted(_vocabulary(templates), key=lambda t: (often.get(t, 0), t)))}
    rows, index = [], []
    for i, (label, text) in enumerate(templates):
        ordered = sorted(set(text.split()), key=place.__getitem__)
        need = math.ceil(threshold * len(ordered) - 1e-9)
        rows.append((i, label, ordered, len(ordered), need, REACH * len(text.split()), *telling(text)))
        index += [(token, i, at) for at, token in enumerate(ordered[:len(ordered) - need + 1])]
    return _Index(place, rows, index)


TEXTS = "template int, label string, whole array<string>, n int, need int, reach int, must array<string>, never array<string>"


def _met(spark: SparkSession, cut: DataFrame, known: _Index, carry: list[str]) -> DataFrame:
    """(carry, template, whole, n, need, reach, must, never, label, common): rows of `cut`, which holds the distinct
    template tokens of each (`tokens`), with enough of a template."""
    prefix = sorted({t for t, _, _ in known.index})
    ranks = F.create_map(*[x for t, r in known.place.items() for x in (F.lit(t), F.lit(r))])
    candidates = cut.where(F.exists("tokens", lambda x: x.isin(prefix)))
    # a row's template tokens in global order
    held = F.array_sort(F.transform("tokens", lambda x: F.struct(F.element_at(ranks, x).alias("rank"), x.alias("token"))))
    entries = candidates.select(*carry, "tokens", held.alias("held")).select(*carry, "tokens", F.posexplode("held").alias("at", "entry"))
    index = F.broadcast(spark.createDataFrame(known.index, "token string, template int, place int"))
    texts = F.broadcast(spark.createDataFrame(known.rows, TEXTS))
    met = entries.withColumn("token", F.col("entry.token")).join(index, "token").join(texts, "template")
    length = F.size("tokens") >= F.col("need")
    position = 1 + F.least(F.col("n") - F.col("place") - 1, F.size("tokens") - F.col("at") - 1) >= F.col("need")
    first = met.where(length & position).withColumn("common", F.size(F.array_intersect("tokens", "whole"))).where("common >= need")
    # one row per (block, template), however many prefix tokens they share: the one of the first shared token
    own = F.expr("element_at(filter(whole, x -> array_contains(tokens, x)), 1)")
    return first.where(F.col("token") == own).select(*carry, "template", "label", "whole", "n", "need", "reach", "must", "never", "common")


def _with_tokens(cut: DataFrame, vocabulary: list[str]) -> DataFrame:
    return cut.withColumn("tokens", F.array_distinct(F.filter("w", lambda x: x.isin(vocabulary))))


def _by_block(docs: DataFrame, known: _Index) -> DataFrame:
    cut = _with_tokens(blocks(docs), list(known.place))
    met = _met(docs.sparkSession, cut, known, ["doc_id", "mark", "block", "w"])
    told = (F.size(F.array_intersect("w", "must")) == F.size("must")) & ~F.arrays_overlap("w", "never")
    return met.where(told).select("doc_id", "mark", "block", "label", (F.col("common") / F.col("n")).alias("containment"))


def _by_stretch(docs: DataFrame, known: _Index) -> DataFrame:
    # a block of the whole text is a candidate; what counts is the best stretch that starts in its first half
    longest = max((row[5] for row in known.rows), default=REACH)
    cut = _with_tokens(passages(docs, longest), list(known.place))
    met = _met(docs.sparkSession, cut, known, ["doc_id", "mark", "block", "w"])
    looked = F.array_union("whole", F.array_union("must", "never"))
    places = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("at"), x.alias("token"))), lambda p: F.array_contains("looked", p["token"]))
    within = lambda p: F.array_distinct(F.transform(F.filter("places", lambda q: (q["at"] >= p["at"]) & (q["at"] < p["at"] + F.col("reach"))), lambda q: q["token"]))
    starts = F.filter("places", lambda p: (p["at"] < longest) & F.array_contains("whole", p["token"]))
    told = lambda t: (F.size(F.array_intersect(t, F.col("must"))) == F.size("must")) & ~F.arrays_overlap(t, F.col("never"))
    best = F.array_max(F.transform(F.filter(F.transform(starts, within), told), lambda t: F.size(F.array_intersect(t, F.col("whole")))))
    scored = met.withColumn("looked", looked).withColumn("places", places).withColumn("best", best).where("best >= need")
    return scored.groupBy("doc_id", "mark", "template", "label").agg(F.max(F.col("best") / F.col("n")).alias("containment")).drop("template")


def _token_sets(docs: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    w = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(), words(F.col("text")).alias("w"))
    return _with_tokens(w, _vocabulary(templates)).drop("w")


def template_matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(doc_id, mark, block, label, containment): every (block of a line, template) pair at or above the threshold."""
    return _by_block(docs, _indexed(_token_sets(docs, templates), templates, threshold))


def stretch_matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(doc_id, mark, label, containment): every (text, template) pair with a stretch at or above the threshold."""
    return _by_stretch(docs, _indexed(_token_sets(docs, templates), templates, threshold))


def _fetched(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows with the given (doc_id, mark)."""
    keys = keys.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark").distinct()
    keys = staged(keys, "license-keys")
    wanted = F.broadcast(keys) if keys.count() <= SMALL else keys
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.withColumns({"none": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)), "mark": F.xxhash64(text_of())})
    return keyed.join(wanted, ["none", "id", "mark"], "left_semi").select("doc_id", "text")


def _places(tokens: list[str], label: str, stands: Column) -> Column:
    """Where the tokens stand in a row in `w`; looked for one by one only where the phrase stands in the text."""
    def here(i):
        return reduce(Column.__and__, [F.get("w", i + k) == F.lit(t) for k, t in enumerate(tokens)])

    def place(i):
        return F.struct(i.cast("int").alias("at"), F.lit(label).alias("label"))

    return F.when(stands, F.transform(F.filter(F.sequence(F.lit(0), F.size("w") - 1), here), place))


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    Base places are where a phrase's words stand in a row; the score is 1 with any of them, else the best containment
    of a template that matches a line or a stretch of the whole text, else 0. Null texts have no words. Rows with null or repeated ids are told apart by their
    text, and equal rows get equal results.
    """
    text = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    cut = _with_tokens(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(), words(F.col("text")).alias("w")), _vocabulary(templates))
    none = F.array().cast("array<struct<at:int,label:string>>")
    found = F.concat(none, *[F.coalesce(_places(phrase.split(), label, F.contains(text, F.lit(f" {phrase} "))), none) for phrase, label in phrases.items()])
    # texts are cut once: whatever else is asked reads this table, or the few texts that may match
    scanned = staged(cut.select("doc_id", "mark", F.size("w").cast("long").alias("n_words"), found.alias("found"), "tokens"), "license-tokens")
    index = _indexed(scanned, templates, threshold)
    likely = _fetched(docs, _met(docs.sparkSession, scanned, index, ["doc_id", "mark"]))
    matches = _by_block(likely, index).drop("block").unionByName(_by_stretch(likely, index))
    extra = matches.groupBy("doc_id", "mark").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    extra = extra.select(F.col("doc_id").alias("x_id"), F.col("mark").alias("x_mark"), "more", "best")
    joined = scanned.join(extra, F.col("doc_id").eqNullSafe(F.col("x_id")) & (F.col("mark") == F.col("x_mark")), "left")
    own = F.array_distinct(F.col("found.label"))
    at = F.col("found.at")
    return joined.select(
        "doc_id", "n_words", F.size("found").cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("found") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


__all__ = ["PHRASES", "TELLING", "TEMPLATES", "blocks", "license_scan", "passages", "stretch_matches", "template_matches"]
