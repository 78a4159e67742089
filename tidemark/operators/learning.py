"""Training panels, model inputs, and models on MLlib. `walk_forward` and `walk_forward_years` fit fold by fold, a chain
of jobs each; `operators/walkforward.py` fits all folds from one pass and is what the queries use."""
from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.functions.scalar import clipped, log_cap, not_nan
from tidemark.operators.metrics import ranking_quality
from tidemark.operators.portfolio import forward_returns
from tidemark.operators.ranks import percentiles, quantiles
from tidemark.operators.spells import members_only
from tidemark.operators.walkforward import COMPARED, Bins, Boosting, data_bins, one_split
from tidemark.staging import staged

HORIZON, MIN_TRAIN_DATES = 12, 12
MISSING = -1.0  # below every percentile, so trees can split the missing off


def excess_labels(panel: DataFrame, prices: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """(symbol, as_of, target): forward return over `horizon` grid steps minus the median of that date's
    rows. `panel` holds members only, so the median is over members that have an outcome."""
    fwd = forward_returns(prices, panel, horizon)
    known = panel.select("symbol", "as_of").join(fwd, ["symbol", "as_of"]).where("fwd is not null")
    known = staged(known, "outcomes")
    median = quantiles(known, ["as_of"], "fwd", {"median": 0.5})
    return known.join(median, "as_of").select("symbol", "as_of", (F.col("fwd") - F.col("median")).alias("target"))


def training_panel(metrics: DataFrame, prices: DataFrame, spells: DataFrame | None, horizon: int = HORIZON) -> DataFrame:
    """Members' factors as percentiles within their date, with the excess label (NULL where unknown)."""
    members = staged(members_only(metrics, spells), "members")
    features = [c for c in members.columns if c not in ("symbol", "as_of")]
    ranked = percentiles(members, ["symbol"], ["as_of"], {f: True for f in features}, "")
    labels = excess_labels(members.select("symbol", "as_of"), prices, horizon)
    return members.select("symbol", "as_of").join(ranked, ["symbol", "as_of"], "left").join(labels, ["symbol", "as_of"], "left")


def fold_dates(data: DataFrame, horizon: int = HORIZON, min_train: int = MIN_TRAIN_DATES, every: int = 1) -> list[tuple]:
    """(last training date, prediction dates) per fold: a fold that predicts date i trains on dates up to
    i - horizon, whose outcomes are known by then. `every` > 1 refits less often, never later data."""
    dates = [row[0] for row in data.select("as_of").distinct().orderBy("as_of").collect()]  # one row per date
    return [(dates[i - horizon], dates[i : i + every]) for i in range(horizon + min_train, len(dates), every)]


def walk_forward(data: DataFrame, *, every: int = 1, trees: int = 200, depth: int = 4, rate: float = 0.05, leaf: int = 100, horizon: int = HORIZON, min_train: int = MIN_TRAIN_DATES, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Predictions (symbol, as_of, ml_score) and importances (feature, importance) summed over the folds."""
    spark = data.sparkSession
    features = [c for c in data.columns if c not in ("symbol", "as_of", "target")]
    vector = VectorAssembler(inputCols=features, outputCol="features")
    ready = staged(vector.transform(data.fillna(MISSING, subset=features)).select("symbol", "as_of", "target", "features"), "vectors")
    model = GBTRegressor(featuresCol="features", labelCol="target", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, minInstancesPerNode=leaf, seed=seed)
    parts, weights = [], [0.0] * len(features)
    for last, ahead in fold_dates(data, horizon, min_train, every):
        fitted = model.fit(ready.where((F.col("as_of") <= F.lit(last)) & F.col("target").isNotNull()))
        scored = fitted.transform(ready.where(F.col("as_of").isin(ahead))).select("symbol", "as_of", F.col("prediction").alias("ml_score"))
        parts.append(staged(scored, "fold"))
        weights = [a + b for a, b in zip(weights, fitted.featureImportances.toArray())]
    total = sum(weights) or 1.0
    none = spark.createDataFrame([], StructType([data.schema["symbol"], data.schema["as_of"], StructField("ml_score", DoubleType())]))
    predictions = reduce(DataFrame.unionByName, parts, none)
    return predictions, spark.createDataFrame([(f, float(w / total)) for f, w in zip(features, weights)], "feature string, importance double")


def model_inputs(df: DataFrame, features: Sequence[str]) -> list[Column]:
    """Feature columns as the models read them: log market cap, clipped valuations, no infinities."""
    out = []
    for f in features:
        c = F.col(f).cast("double")
        if f == "market_cap":
            c = log_cap(c)
        elif f in ("pe", "ps", "pb"):
            c = clipped(c, -200.0, 200.0)
        out.append(not_nan(c).alias(f))
    return out


def _trees(features: Sequence[str], label: str, trees: int, seed: int, leaf: int) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features"),
        GBTClassifier(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=3, stepSize=0.03, subsamplingRate=0.8, minInstancesPerNode=leaf, seed=seed),
    ])


def _logistic(features: Sequence[str], label: str, rows: int, strength: float = 0.1) -> Pipeline:
    filled = [f"_f_{f}" for f in features]
    return Pipeline(stages=[
        Imputer(inputCols=list(features), outputCols=filled, strategy="median", relativeError=1e-4),
        VectorAssembler(inputCols=filled, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="features", labelCol=label, regParam=1 / (strength * max(rows, 1)), maxIter=2000, standardization=False),
    ])


def _probability() -> Column:
    return vector_to_array("probability")[1].alias("p")


def walk_forward_years(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], *, first_year: int, embargo_days: int = 0, trees: int = 200, seed: int = 7, min_test: int = 10, min_train: int = 100, leaf: int = 20) -> DataFrame:
    """Expanding window, one fold per year: train on rows before January 1 less the embargo. Folds that are
    too small or hold one class only are skipped. (keys, year, y, p)"""
    ready = df.where(F.col(target).isNotNull()).select(*keys, "rec_date", "year", F.col(target).cast("double").alias("y"), *model_inputs(df, features))
    ready = staged(ready.fillna(-1e6, subset=list(features)), "rows")
    last = ready.agg(F.max("year")).first()[0]
    parts = []
    for year in range(first_year, (last or first_year - 1) + 1):
        cut = F.date_sub(F.make_date(F.lit(year), F.lit(1), F.lit(1)), embargo_days)
        train, test = ready.where(F.col("rec_date") < cut), ready.where(F.col("year") == year)
        sizes = [t.agg(F.count(F.lit(1)), F.min("y"), F.max("y")).first() for t in (train, test)]
        if sizes[0][0] < min_train or sizes[1][0] < min_test or any(s[1] == s[2] for s in sizes):
            continue
        fitted = _trees(features, "y", trees, seed, leaf).fit(train)
        parts.append(staged(fitted.transform(test).select(*keys, "year", "y", _probability()), "fold"))
    none = ready.select(*keys, "year", "y", F.col("y").alias("p")).limit(0)
    return reduce(DataFrame.unionByName, parts, none)


def compare_models(sets: dict[str, tuple[DataFrame, Sequence[str]]], keys: Sequence[str], *, train_end: int, val_end: int, label: str = "is_pick", cohort: str = "rec_date", boosting: Boosting = COMPARED) -> DataFrame:
    """Time split, never random: logistic (median fill, standardised) and boosted trees on each named feature set and its
    rows, scored on validation and test years. (features, model, split, n, base_rate, roc_auc, pr_auc, recall)"""
    distinct = {id(df): df for df, _ in sets.values()}  # sets of the same rows share a table and the bins of its features

    def write(key: int) -> tuple[DataFrame, Bins]:
        df = distinct[key]
        every = list(dict.fromkeys(f for d, fs in sets.values() if d is df for f in fs))
        rows = staged(df.select(*keys, cohort, "year", F.col(label).cast("double").alias("y"), *model_inputs(df, every)), "rows")
        return rows, data_bins(rows.where(F.col("year") <= train_end), every)

    def fit(name: str) -> list[DataFrame]:
        (df, features), (rows, bins) = sets[name], written[id(sets[name][0])]
        rows = rows.select(*keys, cohort, "year", "y", *features)
        train = rows.where(F.col("year") <= train_end)
        split = F.when(F.col("year") <= val_end, "val").otherwise("test")
        held = rows.where(F.col("year") > train_end).withColumn("split", split)
        known = train.agg(F.count(F.lit(1)).alias("_n"), *[F.count(f).alias(f) for f in features]).first()
        filled = [f for f in features if known[f]]  # a median needs a value
        logistic = _logistic(filled, "y", known["_n"]).fit(train).transform(held).select(*keys, cohort, "split", "y", _probability())
        trees = one_split(train, held, features, [*keys, cohort, "split"], boosting, bins.only(features))
        return [staged(scores, "scored") for scores in (logistic, trees)]

    # a fit is a chain of short jobs, so the sets run beside one another
    own = inheritable_thread_target(next(iter(distinct.values())).sparkSession)
    with ThreadPoolExecutor(len(sets)) as pool:
        written = dict(zip(distinct, pool.map(own(write), distinct)))
        fitted = list(pool.map(own(fit), sets))
    runs = [(name, model) for name in sets for model in ("logistic", "trees")]
    parts = [scores.select(F.lit(i).alias("_run"), *keys, cohort, "split", "y", "p") for i, scores in enumerate(s for both in fitted for s in both)]
    by = ["_run", "split"]  # names stay behind while rows travel
    ranked = reduce(DataFrame.unionByName, parts).withColumn("_id", F.pmod(F.xxhash64(*keys), F.lit(1 << 52)))
    out = ranking_quality(ranked, by, cohort, "y", "p", "_id")
    named = [F.element_at(F.array(*[F.lit(r[i]) for r in runs]), F.col("_run") + 1).alias(c) for i, c in enumerate(("features", "model"))]
    return out.select(*named, "split", *[c for c in out.columns if c not in by])
