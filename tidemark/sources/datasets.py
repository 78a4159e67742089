"""Datasets on a path: folders per symbol or per date, read with pruning and a checked schema.

A dataset is a folder of parquet files with `symbol=...` or `date=...` folders below it. Filters are put on the scan, so
folders that cannot match are not listed into tasks; a missing or empty dataset is an empty table of the given schema.
"""
from __future__ import annotations

from collections.abc import Sequence
from datetime import date as Date

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, LongType, StringType, StructField, StructType

from tidemark.sources.text_files import clean_news


class SchemaMismatch(ValueError):
    """The files hold other columns or types than the reader was told."""


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def _holds_files(spark: SparkSession, path: str) -> bool:
    """Whether any file that a reader would see lies below the path; stops at the first."""
    files, target = _files(spark, path)
    if not files.exists(target):
        return False
    found = files.listFiles(target, True)
    while found.hasNext():
        name = found.next().getPath().getName()
        if not name.startswith(("_", ".")):
            return True
    return False


def _checked(spark: SparkSession, path: str, schema: StructType, partition: str | None) -> None:
    there = {f.name: f.dataType for f in spark.read.parquet(path).schema.fields}  # footers, and folder names
    wanted = [f for f in schema.fields if f.name != partition]
    wrong = [f"{f.name}: {there[f.name].simpleString() if f.name in there else 'absent'}, not {f.dataType.simpleString()}" for f in wanted if there.get(f.name) != f.dataType]
    if wrong:
        raise SchemaMismatch(f"{path}: " + "; ".join(wrong))


def read_dataset(spark: SparkSession, path: str, schema: StructType, *, partition: str | None = "symbol", symbols: Sequence[str] | None = None, start: Date | None = None, end: Date | None = None, date: str = "date") -> DataFrame:
    """The dataset's rows of the given symbols and dates (both ends included), NaN as NULL.

    Symbols and dates become partition or pushed filters of the scan, whichever the layout allows. Columns that are
    absent or of another type raise SchemaMismatch; a dataset without files has no rows.
    """
    if not _holds_files(spark, path):
        return spark.createDataFrame([], schema)
    _checked(spark, path, schema, partition)
    rows = spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    if symbols is not None:
        rows = rows.where(F.col("symbol").isin(list(symbols)))
    if start is not None:
        rows = rows.where(F.col(date) >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col(date) <= F.lit(end))
    doubles = {f.name for f in schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    return rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(c) for c in schema.fieldNames()])


def dataset_symbols(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The symbols of a dataset; from folder names where it has them."""
    return read_dataset(spark, path, schema).select("symbol").distinct()


def newest_dates(spark: SparkSession, path: str, schema: StructType, n: int, until: Date, symbols: Sequence[str] | None = None, date: str = "date") -> DataFrame:
    """Rows of the newest n distinct dates up to `until`, which need not be consecutive days. The dates are a table of n
    rows, so a dataset foldered by date opens only those folders: they prune the scan while it runs."""
    rows = read_dataset(spark, path, schema, partition=date, symbols=symbols, date=date)
    dates = read_dataset(spark, path, schema, partition=date, date=date).select(date).where(F.col(date) <= F.lit(until)).distinct()
    newest = dates.orderBy(F.col(date).desc()).limit(n).where(F.col(date) <= F.lit(until))
    return rows.join(F.broadcast(newest), date, "left_semi")  # n dates


NEWS = StructType([StructField("symbol", StringType()), StructField("published_at", StringType()), StructField("item_id", LongType()), StructField("headline", StringType()), StructField("date", DateType())])


def read_news(spark: SparkSession, path: str, symbol: str | None = None, days: int = 30, until: Date = Date(9999, 12, 31)) -> DataFrame:
    """Cleaned headlines of the newest `days` date folders, of one symbol or all."""
    return clean_news(newest_dates(spark, path, NEWS, days, until, [symbol] if symbol else None))


def read_all_news(spark: SparkSession, path: str) -> DataFrame:
    """Every cleaned headline in order of publication (then item); one that says no time comes first."""
    return clean_news(read_dataset(spark, path, NEWS, partition="date")).orderBy(F.col("published_at").asc_nulls_first(), "item_id")


__all__ = ["NEWS", "SchemaMismatch", "dataset_symbols", "newest_dates", "read_all_news", "read_dataset", "read_news"]
