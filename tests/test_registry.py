"""Registered queries against their SQL twins, and the shape of key plans."""
import glob
import os
import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare

SF = "/root/testdata/sf0.001"
# a cross-section of subjects; `python check.py` runs every query
NAMES = ["momentum_ranks", "member_counts", "financials", "derived_quarters", "merged_recommendations", "forward_grid", "keyed_upsert", "clean_news", "filing_chunks", "page_lines",
         "hourly_bars", "supertrend", "headline_actions", "symbol_mentions", "company_ids", "average_precision", "stream_bars", "data_dictionary", "full_index_rows", "full_backtest_returns", "full_rank_position"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_twin(spark, con, name):
    assert compare(queries()[name](spark, SF).toPandas(), con.execute(oracle_sql()[name]).fetchdf()) == "ok"


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", ["price_factors", "financials", "member_counts", "members_only", "raw_close", "daily_indicators", "filing_chunks", "word_counts"])
def test_plans_stay_in_the_jvm(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas", plan)


def test_only_needed_columns_are_read(spark):
    plan = queries()["member_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice:" not in plan.split("ReadSchema")[0] and "l_comment" not in plan
