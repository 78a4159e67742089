"""Readers on a path: what the scan is told, and odd datasets."""
import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

from tidemark.sources import datasets as ds

BARS = StructType([StructField("symbol", StringType()), StructField("date", DateType()), StructField("close", DoubleType())])


@pytest.fixture
def lake(spark, tmp_path):
    days = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=i), float("nan") if i == 3 else float(i)) for s in ("A", "B", "1E5") for i in range(10)]
    spark.createDataFrame(days, BARS).write.partitionBy("symbol").parquet(str(tmp_path / "bars"))
    return str(tmp_path / "bars")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_symbols_prune_folders_and_dates_are_pushed(spark, lake):
    got = ds.read_dataset(spark, lake, BARS, symbols=["A", "1E5"], start=dt.date(2024, 1, 3), end=dt.date(2024, 1, 5))
    assert rows(got, "symbol", "date") == sorted((s, dt.date(2024, 1, n)) for s in ("A", "1E5") for n in (3, 4, 5))
    assert got.where("date = date'2024-01-04'").where("close is null").count() == 2  # NaN is no value
    plan = plan_of(got)
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [symbol" in scan and "1E5" in scan and "GreaterThanOrEqual(date" in scan and "LessThanOrEqual(date" in scan
    assert rows(ds.dataset_symbols(spark, lake, BARS)) == [("1E5",), ("A",), ("B",)]


def test_newest_dates_prune_while_the_scan_runs(spark, tmp_path):
    news = [(f"S{i % 3}", f"2024-01-{d:02d}T00:00:00Z", 100 * d + i, f"headline {i}", dt.date(2024, 1, d)) for d in (1, 2, 5, 9, 11) for i in range(4)]
    spark.createDataFrame(news, ds.NEWS).write.partitionBy("date").parquet(str(tmp_path / "news"))
    got = ds.read_news(spark, str(tmp_path / "news"), "S0", 2, dt.date(2024, 1, 10))
    assert rows(got, "item_id") == [(500,), (503,), (900,), (903,)]
    assert "dynamicpruning" in plan_of(got) and "PartitionFilters: [isnotnull(date" in plan_of(got)
    ordered = [r.published_at for r in ds.read_all_news(spark, str(tmp_path / "news")).collect()]
    assert ordered == sorted(ordered) and len(ordered) == 20
    assert rows(ds.read_news(spark, str(tmp_path / "news"), None, 1), "item_id") == [(1100 + i,) for i in range(4)]


def test_missing_empty_and_wrong_datasets(spark, lake, tmp_path):
    none = ds.read_dataset(spark, str(tmp_path / "nothing"), BARS, symbols=["A"])
    assert none.schema == BARS and none.count() == 0
    (tmp_path / "empty").mkdir()
    assert ds.read_news(spark, str(tmp_path / "empty"), "A").count() == 0 and "sentiment" in ds.read_all_news(spark, str(tmp_path / "empty")).columns
    for wrong in ("symbol string, date date, close long", "symbol string, date date, close double, volume long"):
        with pytest.raises(ds.SchemaMismatch):
            ds.read_dataset(spark, lake, StructType.fromDDL(wrong))
    assert ds.read_dataset(spark, lake, StructType.fromDDL("symbol string, close double")).agg(F.count("close")).first()[0] == 27
