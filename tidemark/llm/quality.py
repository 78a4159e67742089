"""Document quality from line labels (operator 2).

A linear-chain conditional random field labels every line good or bad. A line's features are shares of character
classes, word shape and repetition, of the line itself and of the lines before and after it. Forward-backward
marginals, weighted by line length, give the good share of a text; a logistic curve fitted on the training documents
turns it into the score.

The fit uses at most TRAIN_ROWS labelled documents outside the held-out fold, with a line labelled as its document.
Language, source, id and labels are no inputs of a score. Every whole text is scored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import text_of
from tidemark.llm.labelled import fold_of, sample
from tidemark.llm.shingles import BLANK, powers

#: bound of the fit in labelled documents
TRAIN_ROWS = 6_000
_CLASSES = {
    "upper": [range(0x41, 0x5B)], "lower": [range(0x61, 0x7B)], "digit": [range(0x30, 0x3A)], "beyond": [range(0x80, 0x100)], "stop": [b".,;:?"], "bar": [b"|"], "bang": [b"!"],
    "odd": [b"*$#%&^~=<>{}[]\\@_+"], "other": [b"\"'()-/`"],
}
_TABLES = np.zeros((len(_CLASSES), 256), np.uint8)
for _i, _parts in enumerate(_CLASSES.values()):
    for _p in _parts:
        _TABLES[_i, list(_p)] = 1
_BYTE = np.random.default_rng(0x11E5).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features per line with those of its neighbours, bytes per line, lines per text); blank lines are passed over.

    A text without other lines has one empty line.
    """
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    bounds = np.cumsum([0] + [len(c) + 1 for c in coded])
    ends = np.flatnonzero(raw == 0x0A)
    starts = np.concatenate([[0], ends[:-1] + 1])
    text = np.searchsorted(bounds, starts, side="right") - 1
    count = lambda flags: np.add.reduceat(flags, starts, dtype=np.int64)
    shares = [count(t[raw]) for t in _TABLES]
    word = ~BLANK[raw]
    filled = count(word)
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    w_start, w_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    line = np.searchsorted(starts, w_start, side="right") - 1
    n_words = np.bincount(line, minlength=len(starts))
    again, twice = np.zeros(len(starts)), np.zeros(len(starts))
    if len(w_start):
        inside, sizes = np.flatnonzero(word), w_end - w_start
        first = np.cumsum(sizes) - sizes
        hashed = np.add.reduceat(_BYTE[raw[inside]] * powers(int(sizes.max()))[np.arange(len(inside)) - np.repeat(first, sizes)], first)
        same = (hashed[1:] == hashed[:-1]) & (line[1:] == line[:-1])
        again = np.bincount(line[1:][same], minlength=len(starts))
        # words seen before in the line, beyond the short common ones
        key = hashed + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        long_ = np.flatnonzero(sizes >= 5)
        order = long_[np.argsort(key[long_], kind="stable")]
        repeat = order[1:][key[order][1:] == key[order][:-1]]
        twice = np.bincount(line[repeat], minlength=len(starts))
    size, words = np.maximum(filled, 1), np.maximum(n_words, 1)
    last = raw[np.maximum(ends - 1, 0)]
    own = np.column_stack([np.log1p(filled) / 5, *[s / size for s in shares], *[np.sqrt(s / size) for s in shares[5:8]], filled / words / 10, again / words, twice / words,
                           np.isin(last, np.frombuffer(b".!?", np.uint8)) & (filled > 0), n_words <= 2])
    keep = filled > 0
    some = np.bincount(text[keep], minlength=len(texts)) > 0
    head = np.concatenate([[True], text[1:] != text[:-1]])
    keep |= head & ~some[text]
    own, text, filled = own[keep], text[keep], filled[keep]
    before, after = np.zeros_like(own), np.zeros_like(own)
    joined = text[1:] == text[:-1]
    before[1:][joined] = own[:-1][joined]
    after[:-1][joined] = own[1:][joined]
    at_start, at_end = np.ones(len(own)), np.ones(len(own))
    at_start[1:][joined] = 0
    at_end[:-1][joined] = 0
    return np.column_stack([own, before, after, at_start, at_end, np.ones(len(own))]), filled, np.bincount(text, minlength=len(texts))


def _marginals(score: np.ndarray, lines: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) per line, pair marginals summed over all texts, and log Z per text.

    `score` is a line's log-odds for good; texts step through their lines together, the longest first.
    """
    order = np.argsort(-lines, kind="stable")
    sizes = lines[order]
    first = (np.cumsum(lines) - lines)[order]
    deepest = int(sizes[0]) if len(sizes) else 0
    live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(deepest)]
    forward, backward = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    emit = np.column_stack([np.zeros(len(score)), score])
    for t in range(deepest):
        at = first[:live[t]] + t
        if t:
            prior = forward[at - 1][:, :, None] + trans[None]
            forward[at] = np.logaddexp(prior[:, 0], prior[:, 1]) + emit[at]
        else:
            forward[at] = emit[at]
    for t in range(deepest - 2, -1, -1):
        at = first[:live[t + 1]] + t
        later = (backward[at + 1] + emit[at + 1])[:, None, :] + trans[None]
        backward[at] = np.logaddexp(later[:, :, 0], later[:, :, 1])
    tail = first + sizes - 1
    z = np.logaddexp(forward[tail, 0], forward[tail, 1])
    norm = np.zeros(len(lines))
    norm[order] = z
    per_line = np.repeat(norm, lines)
    good = np.exp(np.minimum(0, forward[:, 1] + backward[:, 1] - per_line))
    inner = np.ones(len(score), bool)
    inner[np.cumsum(lines) - lines] = False
    at = np.flatnonzero(inner)
    pairs = np.exp(np.minimum(0, forward[at - 1][:, :, None] + trans[None] + (emit[at] + backward[at])[:, None, :] - per_line[at][:, None, None])).sum(axis=0)
    return good, pairs, norm


def fit_field(x: np.ndarray, lines: np.ndarray, quality: np.ndarray, steps: int = 250, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights, transitions) of the field that makes the line labels likeliest; Adam over all lines."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1], scale = 0, np.where(scale > 1e-9, scale, 1)
    x = (x - mean) / scale
    y = np.repeat(quality, lines).astype(float)
    n = len(lines)
    links = np.maximum(lines - 1, 0)
    want = np.zeros((2, 2))
    want[0, 0], want[1, 1] = links[quality == 0].sum(), links[quality == 1].sum()
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    state = [np.zeros(x.shape[1] + 4) for _ in range(2)]
    for t in range(1, steps + 1):
        good, pairs, _ = _marginals(x @ w, lines, trans)
        grad = np.concatenate([x.T @ (good - y), (pairs - want).ravel()]) / n
        grad += ridge * np.concatenate([w, trans.ravel()])
        state = [0.9 * state[0] + 0.1 * grad, 0.99 * state[1] + 0.01 * grad**2]
        move = 0.05 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
        w, trans = w - move[:-4], np.clip(trans - move[-4:].reshape(2, 2), -4, 4)
    return mean, scale, w, trans


def good_share(texts: list[str], field: tuple) -> np.ndarray:
    """The length-weighted mean of the lines' good marginals, per text."""
    mean, scale, w, trans = field
    x, size, lines = line_features(texts)
    good, _, _ = _marginals(((x - mean) / scale) @ w, lines, trans)
    weight = size + 1.0
    text = np.repeat(np.arange(len(lines)), lines)
    return np.bincount(text, good * weight, minlength=len(lines)) / np.bincount(text, weight, minlength=len(lines))


def _curve(share: np.ndarray, quality: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from the share's log-odds to the label."""
    z = np.log((share + 1e-3) / (1 - share + 1e-3))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-(a * z + b)))
        r, g = p - quality, p * (1 - p) + 1e-9
        h = np.array([[(g * z * z).sum() + 1, (g * z).sum()], [(g * z).sum(), g.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(r * z).sum() + (a - 1), r.sum()]))
        a, b = a - step[0], b - step[1]
    return float(max(a, 1e-3)), float(b)


def trained(docs: DataFrame, labels: DataFrame, held_out: int = 2) -> tuple | None:
    """The field and the curve, from labelled rows outside the held-out fold; None where there is none."""
    rows = sample(docs, labels.select("doc_id", "quality"), ["quality"], TRAIN_ROWS, fold_of(F.col("doc_id")) % 4 != held_out)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, size, lines = line_features(batch.column(1).to_pylist())
            cut = np.concatenate([[0], np.cumsum(lines)])
            flat = [x[a:b].astype("<f4").tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(flat, pa.binary()), pa.array([s.astype("<i4").tobytes() for s in np.split(size, cut[1:-1])], pa.binary())], names=["doc_id", "quality", "x", "size"])

    got = sorted(rows.select("doc_id", "text", "quality").mapInArrow(features, "doc_id long, quality int, x binary, size binary").collect(), key=lambda r: r.doc_id)
    if not got:
        return None
    size = [np.frombuffer(r.size, "<i4") for r in got]
    lines = np.array([len(s) for s in size])
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), "<f4").reshape(int(lines.sum()), -1).astype(float)
    quality = np.array([r.quality for r in got])
    field = fit_field(x, lines, quality)
    mean, scale, w, trans = field
    good, _, _ = _marginals(((x - mean) / scale) @ w, lines, trans)
    weight, text = np.concatenate(size) + 1.0, np.repeat(np.arange(len(lines)), lines)
    share = np.bincount(text, good * weight) / np.bincount(text, weight)
    return field, _curve(share, quality)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 from the threshold on) and good_share.

    Null and empty texts are one empty line and are scored like any other. A null id is not held out. Repeated rows
    get equal scores. Without labels every score is 0.5.
    """
    model = trained(docs, labels, held_out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                if model is None:
                    share = found = np.full(batch.num_rows, 0.5)
                else:
                    field, (slope, offset) = model
                    share = good_share(batch.column(2).to_pylist(), field)
                    found = 1 / (1 + np.exp(-(slope * np.log((share + 1e-3) / (1 - share + 1e-3)) + offset)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32)), pa.array(share)], names=["doc_id", "held_out", "score", "predicted", "good_share"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of(F.col("doc_id")) % 4 == held_out).alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, good_share double")
