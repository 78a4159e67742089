"""The corpus operators on tables with nulls, empty and very long texts, ties, repeated rows and clashing names."""
import random
import re
import struct
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from brute import contamination as brute_contamination, near_components, personal, repeats, shingles
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, dedup_exact, licenses, near_dedup, packing, pii, quality, suffix_dedup, token_files, toxicity
from tidemark.llm.queries import tokenizer_file
from tidemark.llm.shingles import mixed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use themselves
CLASHES = ["node", "mark", "doc", "key", "row", "_text", "gap", "length", "sequence_id", "component", "d", "m", "h_id", "spans", "name"]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    return df.withColumns({c: F.lit(c) for c in CLASHES}) if extra else df


def some_texts(seed=1, n=40):
    r = random.Random(seed)
    vocabulary = ["alpha", "beta", "Gamma", "delta", "über", "naïve", "x1", "y-2", "zeta.", "eta", "theta", "iota", "kappa"]
    texts = [" ".join(r.choice(vocabulary) + str(r.randrange(30)) for _ in range(r.randrange(1, 120))) for _ in range(n)]
    rows = list(enumerate(texts))
    for i in range(0, n, 4):  # near copies, one word changed
        w = texts[i].split()
        w[len(w) // 2] = "changed"
        rows.append((n + i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, texts[0]), (204, texts[0].replace(" ", "  ")), (205, "one"), (206, "ONE"), (207, "only three words"), (208, "lone word"),
             (209, " ".join(r.choice(vocabulary) for _ in range(20_000)))]
    return rows


@pytest.fixture(scope="module")
def rows():
    return some_texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Null ids and repeated rows besides."""
    return frame(spark, rows + [(None, "stray text here now"), (None, None), (205, "one"), (3, rows[3][1])])


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


# --- 1 -------------------------------------------------------------------------------------------
def test_packing(docs, odd, none, rows, encode):
    out = packing.packed(docs, tokenizer_file(), capacity=64).collect()
    ids = {i: encode(t) + [1] for i, t in rows}
    assert sorted((r.doc_id, r.piece) for r in out) == sorted((i, k) for i, x in ids.items() for k in range(-(-len(x) // 64)))
    for r in out:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.start == 64 * r.piece and len(part) == r.length and crc(part) == r.ids_crc32
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_sequence) <= 1.03 * sum(map(len, ids.values())) / 64 + 2
    assert packing.packed(odd, tokenizer_file(), 64).count() == len(out) + 3 + -(-len(ids[3]) // 64) + (len(encode("stray text here now")) + 1 > 64)
    assert packing.packed(none, tokenizer_file(), 64).count() == 0


def test_packing_fills_like_sequential_best_fit(spark):
    r = random.Random(4)
    sizes = [r.choice([3, 3, 3, 50, 50, r.randrange(1, 101)]) for _ in range(3000)]  # one size holds half of all rows
    parts = spark.createDataFrame([(n, s) for n, s in enumerate(sizes)], "gap long, length long")
    got = packing.pack(parts, 100)
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= s]
        if fit:
            b = min(fit, key=lambda b: bins[b])
            bins[b] -= s
        else:
            bins.append(100 - s)
    assert got.select("gap").distinct().count() == 3000 and got.select("sequence_id").distinct().count() <= len(bins) + 1
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).where("n <> m or n > 100").count() == 0


def test_sweep_serves_the_smallest_gap_first():

    waiting, gaps = np.zeros(11, int), np.zeros(11, int)
    waiting[4], gaps[4], gaps[5], gaps[9] = 4, 1, 1, 1
    moves, runs = packing.sweep(waiting, gaps)
    assert [(m[0], m[2], m[3]) for m in moves] == [(4, 1, 4), (4, 1, 5), (4, 2, 9)]
    assert sorted((r[0], r[3]) for r in runs) == [(4, 0), (5, 1), (9, 1)]


# --- 4 -------------------------------------------------------------------------------------------
def test_token_files(spark, docs, odd, none, rows, encode):
    got = {r.doc_id: r for r in token_files.token_round_trip(docs, tokenizer_file()).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = encode(t) + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    again = token_files.token_round_trip(odd, tokenizer_file()).orderBy("start").collect()
    assert [r.doc_id for r in again][:2] == [None, None] and len(again) == len(rows) + 4
    assert token_files.token_round_trip(none, tokenizer_file()).count() == 0


def test_wide_ids_come_back(spark, rows, encode):
    """An end id beyond 16 bits makes files of 4-byte ids; a second writing of a part leaves the first."""
    some = frame(spark, rows[:20])
    got = {r.doc_id: r for r in token_files.token_round_trip(some, tokenizer_file(), end_id=70_000).collect()}
    assert all((got[i].n_tokens, got[i].ids_crc32) == (len(encode(t)) + 1, crc(encode(t) + [70_000])) for i, t in rows[:20])


def test_a_part_that_is_there_stays(tmp_path):
    from pyarrow import fs

    (tmp_path / "a").write_bytes(b"12345")
    (tmp_path / "b").write_bytes(b"12345")
    (tmp_path / "c").write_bytes(b"1")
    for attempt, kept in (("a", b"12345"), ("c", b"1")):
        token_files._settle(fs.LocalFileSystem(), str(tmp_path / attempt), str(tmp_path / "b"))
        assert (tmp_path / "b").read_bytes() == kept and not (tmp_path / attempt).exists()



def test_encoder_cuts_chunks_as_the_library_does():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tidemark.llm.tokens import WordEncoder

    letters = [chr(i) for i in range(1, 0x250)]
    texts = ["".join(letters), " ".join(f"a{c}B{c}{c}1" for c in letters), "don't 'Ve \"'s we'll12 x''re", "Éa²½9-_-<|b <|endoftext|> \u0130x日本 naïve\u0301", "", None]
    whole = Tokenizer.from_file(tokenizer_file())
    counts, ids = WordEncoder(tokenizer_file()).batch(pa.array(texts))
    wanted = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in wanted] and ids.tolist() == [i for w in wanted for i in w]


def test_encoder_asks_the_model_once_for_a_word(monkeypatch):
    """Whatever its case and the marks around it, and however many new words come in between."""
    import pyarrow as pa

    from tidemark.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", 50, raising=False)
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 50, raising=False)
    encoder, asked = tokens.WordEncoder(tokenizer_file()), []

    class Counting:
        def __init__(self, model):
            self.model = model

        def tokenize(self, piece):
            asked.append(piece)
            return self.model.tokenize(piece)

    encoder.model = Counting(encoder.model)
    for k in range(8):
        new = " ".join(f"new{'abcdefgh'[k]}{a}{b}" for a in "abcdefgh" for b in "abcdefgh")
        encoder.batch(pa.array([f"word Word, WORD. (word) {new}"]))
    assert asked.count("word") == 1


@pytest.mark.parametrize("text", ["Don't STOP 42!!", "İstanbul ΣΑΣ ǅ ﬁ", "a<|endoftext|>b", "été 가", "tab\tnew blank x", "日本語 テスト", "I'll we've O'Re 's"])
def test_word_encoder_equals_the_library(encode, text):
    import pyarrow as pa

    from tidemark.llm.tokens import WordEncoder

    counts, ids = WordEncoder(tokenizer_file()).batch(pa.array([text, None, text + " end"]))
    assert ids.tolist() == encode(text) + encode(text + " end") and counts.tolist() == [len(encode(text)), 0, len(encode(text + " end"))]


# --- 5 -------------------------------------------------------------------------------------------
def test_near_groups(odd, rows):
    """Null ids and repeated rows included."""
    got = near_dedup.near_groups(odd, shingle=4).collect()
    want = near_components(rows, 4)
    assert len(got) == len(rows) + 4
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert all(r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(shingles(dict(rows)[r.doc_id], 4)) for r in got if r.doc_id is not None)


def test_one_of_each_group_stays(docs, none, rows):
    kept = near_dedup.keep_representatives(docs, shingle=5)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in near_components(rows, 5).items() if i == c)
    assert near_dedup.keep_representatives(none).count() == 0


@pytest.mark.parametrize("blocks", [False, True])
def test_chains_of_copies_meet(spark, monkeypatch, blocks):
    """A ladder of texts, each close to the next only, and many texts that share one passage: nothing is lost, whether
    buckets are compared as pairs or in blocks."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    ladder = [(i, " ".join(f"v{j}" if j < 4 * i else base[j] for j in range(100))) for i in range(20)]
    passage = " ".join(f"p{i}" for i in range(40))
    shared = [(100 + i, passage + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(12))) for i in range(30)]
    rows = ladder + shared
    want = near_components(rows, 4)
    df = frame(spark, rows, extra=False)
    if blocks:
        monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 1)
        monkeypatch.setattr(near_dedup, "BLOCK_HASHES", 500)
    assert {x.doc_id: x.component_id for x in near_dedup.near_groups(df, 4).collect()} == want


def test_links_of_rows_with_odd_ids(spark):
    """Rows that share an id, ids from 2**62 on and null ids keep the links of their own texts."""
    words_ = [f"w{i}" for i in range(60)]
    near = " ".join(words_[:-1] + ["other"])
    big = 2**62 + 5
    rows = [(7, "nothing like it here at all"), (7, " ".join(words_)), (big, near), (big + 1, "quite another text of its own"), (None, near + " more"), (None, "a stray text with a null id"), (3, "the same words twice over"), (9, "the same words twice over")]
    got = sorted((r.doc_id is None, r.doc_id, r.component_id, r.kept, r.n_shingles) for r in near_dedup.near_groups(frame(spark, rows), 4).collect() if r.doc_id is not None)
    assert [g[1:4] for g in got] == [(3, 3, True), (7, 7, True), (7, 7, True), (9, 3, False), (big, 7, False), (big + 1, big + 1, True)]
    nulls = sorted((r.component_id is None, r.kept) for r in near_dedup.near_groups(frame(spark, rows), 4).collect() if r.doc_id is None)
    assert nulls == [(False, False), (True, True)]
    kept = sorted((r.doc_id or -1, r.text) for r in near_dedup.keep_representatives(frame(spark, rows), 4).collect())
    assert len(kept) == 5 and (7, " ".join(words_)) in kept and (big, near) not in kept


def test_a_bucket_of_a_third_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 8)
    monkeypatch.setattr(near_dedup, "BLOCK_HASHES", 2000)
    r = random.Random(12)
    base = [f"w{i}" for i in range(80)]
    hot = [(i, " ".join(base[:70] + [f"x{r.randrange(4)}" for _ in range(10)])) for i in range(100)]
    rest = [(1000 + i, " ".join(f"u{r.randrange(10**6)}" for _ in range(40))) for i in range(200)]
    got = {x.doc_id: x.component_id for x in near_dedup.near_groups(frame(spark, hot + rest, extra=False), 4).collect()}
    assert got == near_components(hot + rest, 4)


def test_components_of_long_chains(spark):
    from tidemark.llm.graph import components

    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.range(100, 103).select(F.lit(99).cast("long").alias("a"), F.col("id").alias("b")))
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 99 for i in (99, 100, 101, 102)}
    assert components(edges.limit(0)).count() == 0


# --- 6 -------------------------------------------------------------------------------------------
def test_licenses(spark, none):
    notice = licenses.TEMPLATES[0][1]
    rows = [(1, "Some text.\nReleased under the MIT License, see."), (2, "apache license version 2 apache LICENSE, version 2"), (3, "nothing"), (4, None), (5, ""),
            (6, "Header\n" + notice.replace(" charge", "").upper() + "\nfooter"), (7, "CC-BY-NC under the mit license"), (8, "under the mit" + "K license")]
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, rows)).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].score) == (8, 1, 3, 3, "mit", 1.0)
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (2, 0, 4, "apache-2")
    assert (got[3].n_base, got[3].first_word, got[3].labels, got[3].score) == (0, None, "", 0.0) and got[4].n_words == got[5].n_words == 0
    assert got[6].base_labels == "" and got[6].labels == "mit" and 0.9 < got[6].score < 1
    assert got[7].base_labels == "cc-by-nc,mit" and got[7].first_word == 0 and got[7].last_word == 3
    assert got[8].n_base == 0  # the Kelvin sign is no k
    assert licenses.license_scan(none).count() == 0


def test_containment_join_is_exact(spark):
    r = random.Random(3)
    templates = [("a", "t1 t2 t3 t4 t5"), ("b", "t4 t5 t6 t7 t8 t9 t10"), ("a", "t1 t9 t11")]
    texts = [(i, "\n".join(" ".join(f"t{r.randrange(1, 14)}" for _ in range(r.randrange(0, 12))) for _ in range(3))) for i in range(60)]
    got = {(x.doc_id, x.block.line, x.label, round(x.containment, 9)) for x in licenses.template_matches(frame(spark, texts), templates, 0.6).collect()}
    want = set()
    for i, t in texts:
        for n, line in enumerate(t.split("\n")):
            for label, template in templates:
                whole = set(template.split())
                share = len(whole & set(line.split())) / len(whole)
                if share >= 0.6 - 1e-9:
                    want.add((i, n, label, round(share, 9)))
    assert got == want


def test_templates_match_across_lines(spark):
    r = random.Random(8)
    mit, gpl = licenses.TEMPLATES[0][1].split(), next(t for label, t in licenses.TEMPLATES if label == "gpl-3").split()
    wrap = lambda w, n: "\n".join(" ".join(w[i:i + n]) for i in range(0, len(w), n))
    long = [f"l{i}" for i in range(150)]  # more than a block of words
    filler = " ".join(f"f{i}" for i in range(300))
    rows = [(1, "# " + wrap(mit, 10).replace("\n", "\n# ")), (2, wrap(gpl, 9)), (3, filler + "\n" + wrap(gpl, 4) + "\n" + filler), (4, wrap([x for w in gpl for x in [w] + ["x"] * 3], 5)),
            (5, filler + " " + " ".join(long[:130]) + " " + filler), (6, " ".join(long[:100]))]
    got = {x.doc_id: x for x in licenses.license_scan(frame(spark, rows), templates=licenses.TEMPLATES + [("long", " ".join(long))]).collect()}
    assert [got[i].labels for i, _ in rows] == ["mit", "gpl-3", "gpl-3", "", "long", ""]
    assert [got[i].score for i, _ in rows] == [1.0, 1.0, 1.0, 0.0, 130 / 150, 0.0]
    # against all stretches, one by one
    templates = [("a", "t1 t2 t3 t4 t5"), ("b", "t4 t5 t6 t7 t8 t9 t10"), ("c", "t1 t9 t11")]
    texts = [(i, wrap([f"t{r.randrange(1, 30)}" for _ in range(r.randrange(0, 90))], 4)) for i in range(60)]
    want = set()
    for i, t in texts:
        w = t.split()
        for label, template in templates:
            whole, reach = set(template.split()), licenses.REACH * len(template.split())
            share = max((len(whole & set(w[k:k + reach])) / len(whole) for k in range(len(w))), default=0)
            if share >= 0.6 - 1e-9:
                want.add((i, label, round(share, 9)))
    assert {(x.doc_id, x.label, round(x.containment, 9)) for x in licenses.stretch_matches(frame(spark, texts), templates, 0.6).collect()} == want and want


def test_usual_notices_are_labelled(spark):
    notices = [
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007", "gpl-3"),
        ("Licensed under the GNU General Public License, version 2.", "gpl-2"),
        ("GNU LESSER GENERAL PUBLIC LICENSE", "lgpl"),
        ("under the GNU Affero General Public License", "agpl"),
        ("Licensed under the BSD License.", "bsd"),
        ("Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.", "bsd"),
        ("Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.", "bsd-3"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl-2"),
        ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa"),
        ("CC0 1.0 Universal", "cc0"),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "isc"),
        ("public licence of the general, version 3", ""),
    ]
    got = {x.doc_id: x for x in licenses.license_scan(frame(spark, [(i, t) for i, (t, _) in enumerate(notices)])).collect()}
    assert [got[i].labels for i in range(len(notices))] == [label for _, label in notices]
    assert all(got[i].score == (1.0 if label else 0.0) for i, (_, label) in enumerate(notices))


def test_neighbouring_licenses_are_told_apart(spark):
    """One notice of each license beside those that differ from it in a word or two."""
    notices = [
        ("Released under the terms of the MIT license.", "mit"), ("Released under the terms of the BSD license.", "bsd"), ("Released under the terms of the GPL license.", "gpl"), ("Released under the terms of the license.", ""),
        ("Licensed under the Apache License, Version 2.0", "apache-2"), ("Licensed under the Mozilla License, Version 2.0", "mpl-2"), ("Licensed under the Other License, Version 2.0", ""),
        ("Licensed under CC BY-SA 4.0", "cc-by-sa"), ("Licensed under CC BY-NC 4.0", "cc-by-nc"), ("Licensed under CC BY-ND 4.0", "cc-by-nd"), ("Licensed under CC BY 4.0", "cc-by"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
        ("Creative Commons Attribution-NoDerivatives 4.0 International License", "cc-by-nd"), ("Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
        ("GNU General Public License, version 3", "gpl-3"), ("GNU General Public License, version 2", "gpl-2"), ("GNU Lesser General Public License, version 3", "lgpl"),
        ("GNU Affero General Public License, version 3", "agpl"), ("GNU Library General Public License, version 2", "lgpl"),
        ("The GNU make manual: our public tool is now at version 3", ""), ("Mozilla Public License, version 2.0", "mpl-2"), ("a public license, version 2", ""),
    ]
    got = {x.doc_id: x for x in licenses.license_scan(frame(spark, [(i, t) for i, (t, _) in enumerate(notices)])).collect()}
    assert [(t, got[i].labels) for i, (t, _) in enumerate(notices)] == notices


def test_licenses_of_odd_rows_and_very_long_texts(odd, spark):
    got = licenses.license_scan(odd).collect()
    assert len(got) == odd.count() and all(r.labels == "" and r.score == 0 for r in got) and sum(r.doc_id is None for r in got) == 2
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [(None, f"{long} licensed under the mit license {long}"), (None, long), (5, "Licensed under the\nBSD License"), (5, "Licensed under the\nBSD License"), (5, "GNU Affero General\nPublic License")]
    got = sorted((r.doc_id or 0, r.labels, r.n_words) for r in licenses.license_scan(frame(spark, rows)).collect())
    assert got == [(0, "", 30_000), (0, "mit", 60_005), (5, "agpl", 5), (5, "bsd", 5), (5, "bsd", 5)]


# --- 7 -------------------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [64, 4096])
def test_exact_groups(docs, rows, block):
    import hashlib
    import re

    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    for r in dedup_exact.exact_groups(docs, block).collect():
        g = groups[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(g), len(g), r.doc_id == min(g), hashlib.sha256(norm[r.doc_id].encode()).hexdigest())
    kept = dedup_exact.keep_first_copies(docs, block)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())


def test_exact_groups_with_odd_rows(odd, none, rows):
    got = dedup_exact.exact_groups(odd).collect()
    assert len(got) == len(rows) + 4
    assert sum(r.kept for r in got if r.doc_id == 205) == 1 and sum(r.kept for r in got if r.doc_id is None) == 1
    assert next(r for r in got if r.doc_id is None and not r.kept).keep_id == 200
    assert dedup_exact.keep_first_copies(odd).where("doc_id = 205").count() == 1
    assert dedup_exact.exact_groups(none).count() == 0 and dedup_exact.keep_first_copies(none).count() == 0


# --- 8 -------------------------------------------------------------------------------------------
def test_blocks_are_cut_from_pieces_of_bounded_size(monkeypatch):
    texts = ["x" * n for n in (10, 0, 700, 300, 1500, 5, 5)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "text": texts, "text_sha256": ["-"] * 7})
    pieces = [p.column(1).to_pylist() for p in dedup_exact._pieces(iter([batch, batch.slice(0, 0)]), 1000)]
    assert pieces == [texts[:3], texts[3:4], texts[4:5], texts[5:]]  # a longer text is a piece of its own
    monkeypatch.setattr(dedup_exact.TaskContext, "get", staticmethod(lambda: SimpleNamespace(partitionId=lambda: 0)))
    out = list(dedup_exact._blocks(100, 1000)(iter([batch])))
    assert max(sum(len(b) for b in o.column("block").to_pylist() if b) for o in out) <= 1500
    kept = {}  # put together again, block by block
    for blocks, places in zip(out[::2], out[1::2]):
        names = blocks.column("block").to_pylist()
        for slot, row, doc in zip(places.column("slot").to_pylist(), places.column("row").to_pylist(), places.column("doc_id").to_pylist()):
            kept[row, doc] = kept.get((row, doc), b"") + names[slot]
    assert kept == {(i, i): t.encode() for i, t in enumerate(texts)}


def test_window_starts_equal_brute_force():
    for seed in range(15):
        r = random.Random(seed)
        base = [bytes(r.choice(b"abc") for _ in range(60)) for _ in range(3)]
        slices = [b"".join(r.choice(base)[r.randrange(20):r.randrange(30, 60)] for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 12))]
        length, seen = r.choice([8, 12, 20]), {}
        for s in slices:
            for i in range(len(s) - length + 1):
                seen[s[i:i + length]] = seen.get(s[i:i + length], 0) + 1
        want = [[i for i in range(len(s) - length + 1) if seen[s[i:i + length]] > 1] for s in slices]
        assert [x.tolist() for x in suffix_dedup.repeated_starts(slices, length)] == want


@pytest.mark.parametrize("limit", [4096, 1])
def test_repeats_removed(spark, docs, odd, none, rows, limit, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_SLICES", limit)
    more = rows[:30] + [(300, "aaaa" * 100), (301, "x" + rows[1][1] * 2), (302, "é" * 150), (303, "y" + "é" * 120), (304, None)]
    want = repeats(more, 40)
    got = suffix_dedup.repeats_removed(frame(spark, more), length=40, gram=12).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in got} == want
    if limit > 1:
        assert suffix_dedup.repeats_removed(odd).count() == len(rows) + 4 and suffix_dedup.repeats_removed(none).count() == 0


# --- 9 -------------------------------------------------------------------------------------------
def test_contamination(spark, docs, odd, none, rows):
    long = max((t for _, t in rows[:40]), key=len).split()
    items = [(1, " ".join(long[5:30])), (2, " ".join(long[10:22])), (3, "only three"), (4, ""), (5, None), (6, " ".join(long[5:30])), (7, "absent " * 20), (8, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(docs, bench).collect()}
    want = brute_contamination(rows, items)
    assert got == want and any(w[-1] for w in want.values())
    kept = decontaminate.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, w in want.items() if not w[-1])
    assert decontaminate.contamination(odd, bench).count() == len(rows) + 4 and decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0
    rest = {r.doc_id: r.text for r in decontaminate.without_spans(docs, bench).collect()}
    assert rest[205] == "" and rest[207] == "only three words"[len("only three"):]
    again = {i: tuple(r) for i, r in want.items() if r[1] == 0}
    assert all(rest[i] == (dict(rows)[i] or "") for i in again)


def test_contamination_of_null_ids(spark):
    item = " ".join(f"b{i}" for i in range(20))
    df = frame(spark, [(None, item), (None, "clean words"), (1, item), (2, "more clean words")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(df, bench).collect()}
    assert got == {(None, 20, 20, 1, True), (1, 20, 20, 1, True), (None, 2, 0, 0, False), (2, 3, 0, 0, False)}
    kept = decontaminate.without_contaminated(df, bench)
    assert sorted(r.text for r in kept.collect()) == ["clean words", "more clean words"]


# --- 10 ------------------------------------------------------------------------------------------
def test_personal_data(spark, odd, none):
    import hashlib

    texts = ["mail a.b@c.de, d@e.f_g@h.i x@y", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 or 001.002.003.255", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 5500005555555559", "+1 (555) 123-4567. +12 +1-2-3-4-5-6-7-8-9",
             "é 10.0.0.1é é@b.cd", "", None, "7 " * 12_000, "9" * 30_000, "a" * 30_000 + "@", "1.2.3", "@@ ++ 1@2.3"]
    rows = list(enumerate(texts))
    for r in pii.personal_data(frame(spark, rows)).collect():
        base = personal(texts[r.doc_id])
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest() and set(shown.split(",")) <= set(r.spans.split(","))
    assert pii.personal_data(none).count() == 0 and pii.personal_data(odd).count() > 0


def test_patterns_discover_unseen_identifiers(spark):
    seeds = [(i, f"the host address 10.0.0.{i} reached ok") for i in range(20)]
    new = [(100, "the host address 300.0.0.1, reached ok"), (101, "quite other words 300.0.0.2 stand around")]
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, seeds + new)).collect()}
    assert got[0].spans == "ip:17:25"
    assert got[100].n_ip == 0 and got[100].spans == "ip:17:26"  # no address by the base rule, found by its context
    assert got[101].spans == ""  # no pattern speaks for it


def test_patterns_discover_forms_that_no_seed_has(spark):
    seeds = [(i, f"please mail to u{i}@host.de about it") for i in range(20)] + [(100 + i, f"please call number +1 (555) 123-45{i} before noon") for i in range(10, 30)]
    new = [(200, "please mail to admin@intranet about it"), (201, "please call number 9 (555) 123-4567 before noon"), (202, "please call number x1234 before noon"), (203, "other words admin@elsewhere stand"),
           (204, "please mail to a@b about it"), (205, "other words a@b stand")]
    got = {r.doc_id: r.spans for r in pii.personal_data(frame(spark, seeds + new)).collect()}
    assert got[200] == "email:15:29" and got[201] == "phone:19:35" and got[202] == "phone:19:24" and got[203] == "" and got[204] == "email:15:18" and got[205] == ""


# --- 2 and 3 -------------------------------------------------------------------------------------
def test_quality_is_learned_from_lines(spark, none):
    r = random.Random(0)
    good = lambda: "\n".join(" ".join(r.choice(["the", "house", "stands", "by", "water", "and", "trees"]) for _ in range(12)).capitalize() + "." for _ in range(4))
    bad = lambda: "\n".join(" | ".join(r.choice(["HOME", "ABOUT", "LOGIN!!", "***"]) for _ in range(9)) for _ in range(4))
    rows = [(i, good() if i % 3 else bad()) for i in range(240)] + [(500, None), (501, ""), (502, "\n\n")]
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)] + [(None, 1, 0), (3, None, None), (900, 1, 0)], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in quality.quality(df, labels).collect()}
    assert len(out) == 243 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in out.values())
    held = [x for i, x in out.items() if i < 240 and x.held_out]
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, x in out.items())
    assert sum(x.predicted == (x.doc_id % 3 > 0) for x in held) >= 0.97 * len(held)
    assert quality.quality(none, labels).count() == 0 and quality.quality(df, labels.limit(0)).where("score <> 0.5").count() == 0


def test_field_gradient_and_marginals():
    import itertools


    rng = np.random.default_rng(1)
    lines, score, trans = np.array([3, 1, 4]), rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs, norm = quality._marginals(score, lines, trans)
    first = 0
    for n, length in enumerate(lines):
        weight = {y: np.exp(sum(score[first + t] * y[t] for t in range(length)) + sum(trans[y[t - 1], y[t]] for t in range(1, length))) for y in itertools.product((0, 1), repeat=int(length))}
        z = sum(weight.values())
        assert np.isclose(np.log(z), norm[n])
        for t in range(length):
            assert np.isclose(good[first + t], sum(w for y, w in weight.items() if y[t]) / z)
        first += length
    assert np.isclose(pairs.sum(), (lines - 1).sum())


def test_toxicity_chain(spark, none):
    r = random.Random(5)
    plain = lambda: " ".join(r.choice("the house stands by water and trees over there".split()) + str(r.randrange(40)) for _ in range(30))
    rows = [(i, plain() + (f" vile{r.randrange(9)}x awful " if i % 4 == 0 else "") + plain()) for i in range(300)] + [(500, None), (501, "")]
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x.rejected for x in toxicity.toxicity(df, df, labels).collect()}
    assert all(out[i] == (i % 4 == 0) for i in range(300)) and not out[500] and not out[501]
    kept = toxicity.without_toxic(df, df, labels)
    assert kept.columns == df.columns and kept.count() == 302 - 75
    assert toxicity.toxicity(df, df, labels.limit(0)).where("rejected").count() == 0 and toxicity.toxicity(none, df, labels).count() == 0


def _brute_chain(rows, marks):
    """{doc_id: probabilities of the chain}, from sets of words and stems and dense matrices."""
    def features(text):
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode().lower())
        return {(0, w) for w in words} | {(k, w[:k]) for w in words for k in toxicity.STEMS if len(w) >= k}

    found = {i: features(t) for i, t in rows}
    ids = sorted(marks)
    y = np.array([[1 - q, t, (1 - q) * t] for q, t in (marks[i] for i in ids)], float)
    share, score = y.mean(0), {}
    for f in set().union(*[found[i] for i in ids]):
        holds = np.array([f in found[i] for i in ids])
        n = holds.sum()
        if 5 <= n <= toxicity.COMMON * len(ids):
            score[f] = max(abs(y[holds, c].sum() - n * share[c]) / np.sqrt(n * (y[:, c].sum() + 1) / (len(ids) + 2)) for c in range(3))
    assert len(score) <= toxicity.FEATURES
    kept = sorted(score)
    every = [i for i, _ in rows]
    x = np.array([[f in found[i] for f in kept] for i in every], float)
    train = [every.index(i) for i in ids]
    fold = np.array([int(mixed(np.array([i], np.uint64))[0]) % toxicity.FOLDS for i in ids])
    logit = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
    at = lambda m, w: 1 / (1 + np.exp(-(m @ w)))

    def fit(m, y):
        w, one, two = np.zeros(m.shape[1]), 0.0, 0.0
        w[-1] = logit((y.sum() + 1) / (len(y) + 2))
        for t in range(1, 201):
            g = m.T @ ((at(m, w) - y) / len(y)) + 1e-3 * w * (np.arange(len(w)) < len(w) - 1)
            one, two = 0.9 * one + 0.1 * g, 0.99 * two + 0.01 * g * g
            w = w - 0.1 * one / (1 - 0.9**t) / (np.sqrt(two / (1 - 0.99**t)) + 1e-8)
        return w

    seen, shown, out = np.zeros((len(ids), 0)), np.zeros((len(every), 0)), []
    for c in range(3):
        m = np.column_stack([x[train], seen, np.ones(len(ids))])
        p = at(np.column_stack([x, shown, np.ones(len(every))]), fit(m, y[:, c]))
        unseen = np.zeros(len(ids))
        for f in range(toxicity.FOLDS):
            unseen[fold == f] = at(m[fold == f], fit(m[fold != f], y[fold != f, c]))
        seen, shown = np.column_stack([seen, logit(unseen)]), np.column_stack([shown, logit(p)])
        out.append(p)
    return dict(zip(every, np.column_stack(out)))


def test_toxicity_chain_equals_a_dense_one(spark):
    r = random.Random(11)
    words = [f"{a}{b}" for a in "mild plain vile harsh kind été".split() for b in ("", "er", "ly", "ness", "z" * 40 + "a", "z" * 40 + "b")]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 14)))) for i in range(160)]
    marks = {i: (int(r.random() < 0.6), int("vile" in t)) for i, t in rows[:110]}
    labels = spark.createDataFrame([(i, q, t) for i, (q, t) in marks.items()], "doc_id long, quality int, toxic int")
    df = frame(spark, rows)
    want = _brute_chain(rows, marks)
    got = {x.doc_id: (x.p_low_quality, x.p_toxic, x.p_toxic_low_quality) for x in toxicity.toxicity(df, df, labels).collect()}
    assert set(got) == set(want) and all(np.allclose(got[i], want[i], atol=1e-5) for i in want)


def test_long_words_that_start_alike_are_different_features():
    ends = ["a", "b", "ab", "ba", "a" * 70, "a" * 69 + "b"]
    texts = ["x" * 32 + e for e in ends]
    text, feature = toxicity.word_features(texts + texts)
    whole = feature[-2 * len(ends):]
    assert list(text[-2 * len(ends):]) == list(range(2 * len(ends))) and list(whole[:len(ends)]) == list(whole[len(ends):]) and len(set(whole)) == len(ends)
