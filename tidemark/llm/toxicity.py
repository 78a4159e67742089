"""Toxicity by a classifier chain (operator 3).

Every category has a linear model over the words of a text and their first letters (stems that take many endings),
plus the probabilities of the categories before it in the chain. Later models are trained on out-of-fold predictions
of earlier ones, so what they see in training is as good as what they see afterwards. The labels hold one toxic mark
and one quality mark; the chain runs low_quality -> toxic -> toxic_low_quality (both at once). A document is rejected
at P(toxic) >= `bar`.

The fit uses at most TRAIN_ROWS labelled documents. Words are counted per category by Spark, the FEATURES most telling
ones are kept, and only their indices per training document reach the driver. Every whole text is scored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import text_of
from tidemark.llm.labelled import sample
from tidemark.llm.shingles import FOLD, mixed

#: bounds of the fit: labelled documents, kept features, folds, and the share of documents a feature may stand in
TRAIN_ROWS, FEATURES, FOLDS, COMMON = 8_000, 2_000, 4, 0.5
CATEGORIES = ["low_quality", "toxic", "toxic_low_quality"]
#: lengths of the leading letters (bytes) that are features besides the whole word
STEMS = (4, 5, 6)

_RANDOM = np.random.default_rng(0x70C5)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RANDOM.integers(0, 2**64, 32, dtype=np.uint64) | np.uint64(1)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature hash) for every word and stem; a feature may repeat."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
    bounds = np.cumsum([0] + [len(c) + 1 for c in coded])
    word = _LETTER[raw]
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sizes = ends - starts
    text = np.searchsorted(bounds, starts, side="right") - 1
    value = _BYTE[FOLD[raw]]
    total, out = np.zeros(len(starts), np.uint64), []
    for j in range(min(len(_PLACE), int(sizes.max()))):
        live = np.flatnonzero(sizes > j)
        total[live] += value[starts[live] + j] * _PLACE[j]
        if j + 1 in STEMS:
            out.append((text[live], mixed(total[live] + np.uint64(j + 1))))
    # the rest of longer words, all their bytes at once, each with a factor of its place
    long = np.flatnonzero(sizes > len(_PLACE))
    if len(long):
        rest = sizes[long] - len(_PLACE)
        first = np.cumsum(rest) - rest
        place = np.arange(int(rest.sum())) - np.repeat(first, rest)
        at = np.repeat(starts[long] + len(_PLACE), rest) + place
        total[long] += np.add.reduceat(value[at] * (mixed(place.astype(np.uint64)) | np.uint64(1)), first)
    out.append((text, mixed(total + sizes.astype(np.uint64) * np.uint64(0x1_0000_0001))))
    return np.concatenate([t for t, _ in out]), np.concatenate([h for _, h in out])


class Lookup:
    """Indices of kept feature hashes; a small bit table turns most words away before the search."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.seen = np.zeros(1 << 18, bool)
        self.seen[(hashes >> np.uint64(46)).astype(np.int64)] = True

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature index) pairs."""
        text, feature = word_features(texts)
        near = np.flatnonzero(self.seen[(feature >> np.uint64(46)).astype(np.int64)])
        text, feature = text[near], feature[near]
        at = np.minimum(np.searchsorted(self.sorted, feature), max(0, len(self.sorted) - 1))
        hit = self.sorted[at] == feature if len(self.sorted) else np.zeros(0, bool)
        n = max(1, len(self.sorted))
        pairs = np.unique(text[hit] * n + self.order[at[hit]])
        return pairs // n, pairs % n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fit(row: np.ndarray, col: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int, ridge: float = 1e-2, steps: int = 200) -> np.ndarray:
    """Weights [features, extra columns, bias] of a ridge logistic regression by Adam over all rows."""
    n, m = len(y), width + extra.shape[1] + 1
    w, first, second = np.zeros(m), np.zeros(m), np.zeros(m)
    w[-1] = _logit(np.array([(y.sum() + 1) / (n + 2)]))[0]
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], minlength=n) + extra @ w[width:-1] + w[-1]
        miss = (_sigmoid(z) - y) / n
        grad = np.concatenate([np.bincount(col, miss[row], minlength=width), extra.T @ miss, [miss.sum()]])
        grad[:-1] += ridge * w[:-1] / 10
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return w


def _predict(row: np.ndarray, col: np.ndarray, extra: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    width = len(w) - 1 - extra.shape[1]
    return _sigmoid(np.bincount(row, w[col], minlength=n) + extra @ w[width:-1] + w[-1])


def fit_chain(row: np.ndarray, col: np.ndarray, labels: np.ndarray, width: int, fold: np.ndarray) -> list[np.ndarray]:
    """One weight vector per category; category k also sees the out-of-fold logits of categories 0 .. k - 1."""
    n, models = len(labels), []
    extra = np.zeros((n, 0))
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        models.append(_fit(row, col, extra, y, width))
        unseen = np.zeros(n)
        for f in range(FOLDS):
            inside = fold == f
            number = np.cumsum(~inside) - 1
            use = ~inside[row]
            w = _fit(number[row[use]], col[use], extra[~inside], y[~inside], width)
            unseen[inside] = _predict(row, col, extra, w, n)[inside]
        extra = np.column_stack([extra, _logit(unseen)])
    return models


def trained(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, list[np.ndarray]] | None:
    """(feature hashes, models), or None where no document is labelled."""
    marked = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic", ((1 - F.col("quality")) * F.col("toxic")).alias("toxic_low_quality"))
    chosen = sample(docs, marked, CATEGORIES, TRAIN_ROWS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text, feature = word_features(part.column(0).to_pylist())
                both = np.unique(np.stack([text.astype(np.uint64), feature]), axis=1) if len(text) else np.zeros((2, 0), np.uint64)
                row = pa.array(both[0].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(both[1].view(np.int64)), *[part.column(i).take(row) for i in range(1, 4)]], names=["feature", *CATEGORIES])

    totals = chosen.agg(F.count("*"), *[F.sum(c) for c in CATEGORIES]).first()
    if not totals[0]:
        return None
    seen = chosen.select("text", *CATEGORIES).mapInArrow(count, "feature long, " + ", ".join(f"{c} int" for c in CATEGORIES))
    seen = seen.groupBy("feature").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in CATEGORIES]).where((F.col("n") >= 5) & (F.col("n") <= COMMON * totals[0]))
    # how far a category's share among the documents with the feature is from its share overall, in deviations
    telling = F.greatest(*[F.abs(F.col(c) - F.col("n") * ((totals[i + 1] or 0) / totals[0])) / F.sqrt(F.col("n") * (((totals[i + 1] or 0) + 1) / (totals[0] + 2))) for i, c in enumerate(CATEGORIES)])
    kept = np.array(sorted(r.feature for r in seen.select("feature", telling.alias("score")).orderBy(F.desc("score"), "feature").limit(FEATURES).collect()), np.int64).view(np.uint64)
    lookup = Lookup(kept)

    def indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, index = lookup.of(batch.column(1).to_pylist())
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cut), pa.array(index, pa.int32())), *[batch.column(i) for i in range(2, 5)]], names=["doc_id", "at", *CATEGORIES])

    rows = chosen.select("doc_id", "text", *CATEGORIES).mapInArrow(indices, "doc_id long, at array<int>, " + ", ".join(f"{c} int" for c in CATEGORIES)).toArrow().combine_chunks()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    rows = rows.take(pa.array(order))
    at = rows["at"].combine_chunks()
    row = np.repeat(np.arange(len(rows)), np.diff(at.offsets.to_numpy()))
    marks = np.column_stack([rows[c].to_numpy() for c in CATEGORIES])
    fold = (mixed(rows["doc_id"].to_numpy().view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
    return kept, fit_chain(row, at.flatten().to_numpy().astype(np.int64), marks, len(kept), fold)


def scored(docs: DataFrame, model: tuple[np.ndarray, list[np.ndarray]] | None, columns: list[str]) -> DataFrame:
    """`columns` of every row and p_<category> for each category; all 0 without a model."""
    kept, chain = model or (np.zeros(0, np.uint64), [np.array([-40.0] + [0.0] * k)[::-1] for k in range(len(CATEGORIES))])
    lookup = Lookup(kept)
    picked = docs.select(*columns, text_of().alias("_text"))
    names = [f"p_{c}" for c in CATEGORIES]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                row, col = lookup.of(batch.column(batch.num_columns - 1).to_pylist())
                extra, found = np.zeros((batch.num_rows, 0)), []
                for w in chain:
                    found.append(_predict(row, col, extra, w, batch.num_rows))
                    extra = np.column_stack([extra, _logit(found[-1])])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, found)], names=[*columns, *names])

    kinds = dict(picked.dtypes)
    return picked.mapInArrow(score, ", ".join([f"`{c}` {kinds[c]}" for c in columns] + [f"{n} double" for n in names]))


def toxicity(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, bar: float = 0.3) -> DataFrame:
    """Per row: doc_id, the chain's probabilities and `rejected` (P(toxic) >= bar).

    Null and empty texts have no words and are scored by the models' constants. Without labels nothing is rejected.
    Repeated rows get equal scores.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(base, trained(train_docs, labels), ["doc_id"]).withColumn("rejected", F.col("p_toxic") >= bar)


def without_toxic(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, bar: float = 0.3) -> DataFrame:
    """`docs` without rejected documents; the columns stay as they came, whatever their names."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text"))
    return scored(whole, trained(train_docs, labels), ["doc"]).where(F.col("p_toxic") < bar).select("doc.*")
