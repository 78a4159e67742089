"""Written intermediate tables.

A result that a plan reads more than once is written once as parquet to the shared scratch folder and
read back: the lineage is cut, an executor loss costs a re-read, later uses prune columns, and the
planner knows the table's real size when it picks a join.
"""
from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame

from tidemark.session import scratch_root


#: a write that took as many seconds leaves shuffle files worth deleting at once
LONG_WRITE_S = 4


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/staged/{name}-{uuid.uuid4().hex}"
    began = time.monotonic()
    df.write.mode("error").parquet(path)
    if time.monotonic() - began >= LONG_WRITE_S:
        spark._jvm.System.gc()  # shuffle files of a finished plan stay until the driver collects its garbage, which a small plan seldom makes it do
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads, so that rounds do not pile up in the scratch folder."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
