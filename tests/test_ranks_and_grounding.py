"""Bins that follow the data, plans without sorts, and questions ranked by the model's score."""
import random
import re

import pytest
from helpers import d, rows
from pyspark.sql import functions as F

from tidemark.operators import grounding, ranks
from tidemark.operators.scoring import SCORE_COLUMNS, score
from tidemark.plans.standins import Lake


def test_close_values_spread_over_many_bins(spark):
    df = spark.range(200_000).select((F.lit(1_000_000.0) + F.col("id") / 1000).alias("v"), F.lit(1).alias("g"))
    cells = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    bins = ranks.binned(cells, ["g"], "v").groupBy("_bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("_bin").collect()
    assert len(bins) > 12 and max(b.n for b in bins) < 60_000 and all(a.high < b.low for a, b in zip(bins, bins[1:]))
    totals = ranks.running_totals(df, ["g"], "v", {"n": F.count(F.lit(1))})
    assert totals.where("n_before <> round((v - 1000000) * 1000) or n_total <> 200000").count() == 0


@pytest.mark.parametrize("values", [5, 40, 10_000])
def test_totals_do_not_depend_on_bins(spark, monkeypatch, values):
    monkeypatch.setattr(ranks, "BIN_VALUES", values)
    r = random.Random(4)
    data = [(g, r.choice([r.gauss(0, 1), float(r.randrange(5)), -0.0, 1e300, -1e300])) for g in "ab" for _ in range(700)] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {(x.g, x.v): (x.n, x.n_before, x.n_total) for x in ranks.running_totals(df, ["g"], "v", {"n": F.count(F.lit(1))}).collect()}
    for g in "abc":
        own = [v + 0.0 for k, v in data if k == g]
        for v in set(own):
            assert got[g, v] == (own.count(v), sum(x < v for x in own), len(own))
    assert not any(g == "d" for g, _ in got)
    whole = ranks.running_totals(df, [], "v", {"n": F.count(F.lit(1))})
    assert whole.columns == ["v", "n", "n_before", "n_total"] and whole.agg(F.max(F.col("n_before") + F.col("n"))).first()[0] == 1401


@pytest.mark.parametrize("values", [1, 4, 40, 10_000])
def test_percentiles_do_not_depend_on_cuts(spark, monkeypatch, values):
    import pandas as pd

    monkeypatch.setattr(ranks, "BIN_VALUES", values)
    r = random.Random(9)
    data = [(f"s{i}", g, r.choice([r.gauss(0, 1), 2.0, 2.0, float(r.randrange(4)), -0.0, None]), r.choice([1.0, 1e300, float("inf"), -1e300])) for g in "ab" for i in range(400)]
    df = spark.createDataFrame(data, "symbol string, as_of string, x double, y double")
    got = {(x.symbol, x.as_of): (x.x_pct, x.y_pct) for x in ranks.percentiles(df, ["symbol"], ["as_of"], {"x": True, "y": False}).collect()}
    table = pd.DataFrame(data, columns=["symbol", "as_of", "x", "y"])
    x, y = table.groupby("as_of")["x"].rank(pct=True), table.groupby("as_of")["y"].rank(pct=True, ascending=False)
    for s, g, a, b in zip(table["symbol"], table["as_of"], x, y):
        assert got[s, g] == (pytest.approx(a) if a == a else None, pytest.approx(b))


def test_ranked_rows_move_to_their_bin_only(spark, tmp_path):
    """No shuffle by value and no wide rows before the shuffle that puts measures side by side."""
    spark.range(1000).select(F.concat(F.lit("S"), "id").alias("symbol"), F.lit("d").alias("as_of"), F.rand(1).alias("ret_3m"), F.rand(2).alias("vol_60d")).write.parquet(str(tmp_path / "t"))
    plan = score(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*value#", plan) and "REPARTITION_BY_COL" in plan


def test_compressed_tables_count_as_rows(spark, tmp_path):
    """A side whose file is small but whose rows are not stays out of the driver."""
    spark.range(0, 3_000_000, 1, 2).select((F.col("id") % 1000).alias("k"), "id").write.parquet(str(tmp_path / "t"))
    big = spark.read.parquet(str(tmp_path / "t")).select("k")
    plan = spark.range(0, 10**9).withColumnRenamed("id", "k").join(big, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_bars_are_hashed_not_sorted(spark):
    plan = Lake(spark, "/root/testdata/sf0.001").bars._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and not re.search(r"SortAggregate|\bSort\b", plan)


def test_questions_about_the_model_are_ranked_by_it(spark):
    day, old = d("2024-06-30"), d("2023-01-31")
    scores = spark.createDataFrame([(s, day, *[float(i + k) for k in range(6)]) for i, s in enumerate(("AAA", "BBB", "CCC"))] + [("OLD", old, *[99.0] * 6)], "symbol string, as_of date, " + ", ".join(f"{c} double" for c in SCORE_COLUMNS))
    metrics = spark.createDataFrame([("AAA", day, 0.5)], "symbol string, as_of date, ret_3m double")
    chunks = spark.createDataFrame([("AAA", 1, "sales rose strongly"), ("AAA", 2, "other matters")], "symbol string, chunk_id int, text string")
    news = spark.createDataFrame([("AAA", "2024-06-01T00:00:00Z", 1, "AAA upgraded", 0.1)], "symbol string, published_at string, item_id int, headline string, sentiment double")
    asked = spark.createDataFrame([(1, "which are the best by the model?"), (2, "best stocks?"), (3, "How is AAA doing, did sales rise?")], "question_id int, question string")
    ml = spark.createDataFrame([("AAA", day, 0.9), ("BBB", day, 0.1), ("OLD", old, 5.0), ("CCC", old, 7.0)], "symbol string, as_of date, ml_score double")

    def answers(ml_scores):
        out = grounding.ground(asked, scores, metrics, chunks, news, F.to_timestamp(F.lit("2024-07-01 00:00:00")), ml_scores=ml_scores)
        return {r.question_id: r for r in out.collect()}

    got = answers(ml)
    assert got[1].category == "ml_score" and [(x.rank, x.symbol, x.value) for x in got[1].ranking] == [(1, "AAA", 0.9), (2, "BBB", 0.1)]
    assert got[2].category == "total" and [x.symbol for x in got[2].ranking] == ["CCC", "BBB", "AAA"]
    assert got[3].route == "symbol" and got[3].scores.ml_score == 0.9 and [x.text for x in got[3].excerpt_texts] == ["sales rose strongly"]
    assert answers(ml.limit(0))[1].category == "total" and answers(None)[1].category == "total"
    assert rows(grounding.score_lines(scores, ml_scores=ml), "symbol", "ml_score") == [("AAA", 0.9), ("BBB", 0.1), ("CCC", None), ("OLD", 5.0)]
