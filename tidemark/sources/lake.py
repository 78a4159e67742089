"""Keyed tables: reads, listings, the newest date partitions, and last-wins upserts."""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.staging import discard, staged


def read_symbol(table: DataFrame, symbol: str) -> DataFrame:
    """Rows of one key; the equality reaches the scan (partition pruning or row-group filter)."""
    return table.where(F.col("symbol") == symbol)


def list_symbols(table: DataFrame) -> DataFrame:
    return table.select("symbol").distinct()


def latest_partitions(table: DataFrame, n: int, date: str = "date") -> DataFrame:
    """Rows of the newest n *distinct* dates, which need not be consecutive days. The n dates are a small
    side whose semi-join prunes the partitions at run time."""
    newest = table.select(date).distinct().orderBy(F.col(date).desc()).limit(n)
    return table.join(newest, date, "left_semi")


def upserted(existing: DataFrame, new: DataFrame, keys: Sequence[str], seq: str | None = None, newest: bool = False) -> DataFrame:
    """Existing and new rows with one row per key. New beats existing; with `newest` the highest `seq` wins wherever
    it stands, so neither a late older row nor the order of batches changes anything. Within one side the highest `seq` wins, then the largest row, so
    the result never depends on row order. The planner sorts by key before and after the one shuffle; rows of a key
    collapse before it."""
    both = existing.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "_v"]
    rest = [c for c in columns if c not in keys]
    row = F.struct(*rest)
    first = [seq] if seq and newest else ["_v", *([seq] if seq else [])]
    best = both.groupBy(*keys).agg(F.max_by(row, F.struct(*first, row)).alias("_r"))
    return best.select(*keys, "_r.*").select(*columns)


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence, last: bool = True) -> DataFrame:
    """One row per key: the last (or first) in a total order."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


BUCKET = "bucket"


def _rename(files, source, target) -> bool:
    return files.rename(source, target)


def _swap(files, fresh, target, old) -> None:
    """`fresh` takes the place of `target`. If it cannot, the old folder is put back; it is deleted last."""
    had = files.exists(target)
    if had and not _rename(files, target, old):
        raise OSError(f"{target} could not be moved away; it is unchanged")
    if not _rename(files, fresh, target):
        if had and not _rename(files, old, target):
            raise OSError(f"{target} could not be replaced nor put back; its rows are in {old}")
        raise OSError(f"{target} could not be replaced; it is unchanged")
    if had:
        files.delete(old, True)


def _recover(files, hadoop, path: str) -> None:
    """Puts back a folder that a run ended between moving it away and replacing it."""
    target = hadoop(path)
    if files.exists(target) or not files.exists(target.getParent()):
        return
    kept = [s.getPath() for s in files.listStatus(target.getParent()) if s.getPath().getName().startswith(f".{target.getName()}.old-")]
    if kept:
        _rename(files, kept[0], target)


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table written by `upsert_table`, without the buckets' own column."""
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def upsert_table(
    spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], schema: StructType, partition_by: str | None = None, seq: str | None = None, newest: bool = False, buckets: int = 0
) -> None:
    """Upsert into a parquet table by the rule of `upserted`, the first write included.

    With `partition_by`, or with `buckets` (folders by a hash of the keys), only folders that the new rows touch are read
    and rewritten. Merged rows are written beside the table, under a name that readers skip, and each folder takes the
    place of the old one by renaming: the old one is moved away, put back if the new one cannot be moved in, and deleted
    last. Between the two renames a reader may miss that folder; a run that ends there is repaired by the next.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target = hadoop(path)
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    _recover(files, hadoop, path)
    by = partition_by or (BUCKET if buckets else None)
    new = new.select(*schema.fieldNames())
    whole = StructType([*schema.fields, StructField(BUCKET, IntegerType())]) if buckets else schema
    there = files.exists(target)
    if buckets:
        new = new.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    existing = spark.read.schema(whole).parquet(path) if there else new.limit(0)
    touched: list[str] = []
    if by:
        new = staged(new, "new-rows")
        touched = [r[0] for r in new.select(by).distinct().collect()]  # folders that the batch touches
        existing = existing.where(F.col(by).isin([t for t in touched if t is not None]) | (F.col(by).isNull() & F.lit(None in touched)))
    mark = uuid.uuid4().hex
    parent, name = target.getParent().toString(), target.getName()
    fresh = f"{parent}/.{name}.new-{mark}"
    merged = upserted(existing, new, [*keys, *([by] if by and by not in keys else [])], seq, newest)
    if not by:
        merged.write.parquet(fresh)
        _swap(files, hadoop(fresh), target, hadoop(f"{parent}/.{name}.old-{mark}"))
        return
    merged.repartition(by).write.partitionBy(by).parquet(fresh)
    files.mkdirs(target)
    for folder in files.listStatus(hadoop(fresh)):
        if folder.isDirectory():
            moved = folder.getPath()
            _recover(files, hadoop, f"{path}/{moved.getName()}")
            _swap(files, moved, hadoop(f"{path}/{moved.getName()}"), hadoop(f"{path}/.{moved.getName()}.old-{mark}"))
    files.delete(hadoop(fresh), True)
    discard(new)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_documents(df: DataFrame, path: str, partition_by: str | None = "symbol") -> None:
    """One JSON document per row, foldered by symbol. Rows are clustered first, so a folder is one file."""
    if partition_by:
        df.repartition(partition_by).write.mode("overwrite").partitionBy(partition_by).option("ignoreNullFields", "false").json(path)
    else:
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


__all__ = ["read_symbol", "list_symbols", "latest_partitions", "upserted", "keep_one", "read_table", "upsert_table", "write_table", "write_documents", "Window"]
