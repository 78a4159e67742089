"""Session settings and the shared scratch folder."""
from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a hot join key is split even when that costs one more exchange downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # parquet holds a fraction of what rows take in memory: a side's size counts as rows, before it is sent through the driver
    "spark.sql.sources.fileCompressionFactor": "10",
    # recording a Python stack for every column expression costs more than planning
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # symbols such as "1E5" must stay text when read from partition folders
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def build_session(app: str = "tidemark", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# what results depend on; set in sessions this package did not build as well
_NEEDED = ["spark.sql.session.timeZone", "spark.sql.sources.partitionColumnTypeInference.enabled"]
# how joins run; left alone where the session's builder chose a value
_TUNING = ["spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled", "spark.sql.adaptive.forceOptimizeSkewedJoin", "spark.sql.sources.fileCompressionFactor"]


def tune(spark: SparkSession) -> None:
    chosen = spark.sparkContext.getConf()
    for key in _NEEDED + [k for k in _TUNING if not chosen.contains(k)]:
        spark.conf.set(key, SETTINGS[key])


def scratch_root(spark: SparkSession) -> str:
    """The folder for checkpoints and staged tables: the shared one named by the cluster in
    `spark.checkpoint.dir`. Only a single-process session (`local[n]`, as in tests), whose executor is the
    driver, gets a folder of its own; on a cluster a missing setting is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder
