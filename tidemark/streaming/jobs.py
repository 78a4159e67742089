"""Structured Streaming forms of the batch operators: same definitions, incremental state.

State is keyed by (symbol, bar) or (symbol) and bounded by watermarks; ticks are combined map-side before
they reach the state store, so a hot symbol costs one row per task and bar.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidemark.operators.indicators import OPEN_MINUTE, intraday_window
from tidemark.operators.intervals import BUCKET, MONTHS, Buckets, cut
from tidemark.session import scratch_root
from tidemark.sources.lake import read_table, upsert_table


def read_stream(spark: SparkSession, folder: str, pattern: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _ohlcv(prices: bool) -> list:
    first, high, low, last = ("price",) * 4 if prices else ("open", "high", "low", "close")
    at = "ts"
    return [F.min_by(first, at).alias("open"), F.max(high).alias("high"), F.min(low).alias("low"), F.max_by(last, at).alias("close"), F.sum("volume").alias("volume")]


def tick_bars(ticks: DataFrame, minutes: int, lateness: str = "30 minutes") -> DataFrame:
    """Closed tumbling bars of a tick stream, anchored at the open; later ticks than `lateness` are dropped."""
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy("symbol", intraday_window(minutes).alias("w")).agg(*_ohlcv(True)).select("symbol", "w", "open", "high", "low", "close", "volume")


def coarser_bars(bars: DataFrame, minutes: int) -> DataFrame:
    """Coarser bars from closed finer ones in the same query: the window's own event time carries on."""
    offset = f"{OPEN_MINUTE % minutes} minutes"
    timed = bars.withColumn("ts", F.window_time("w"))
    wider = F.window("ts", f"{minutes} minutes", f"{minutes} minutes", offset)
    return timed.groupBy("symbol", wider.alias("w")).agg(*_ohlcv(False)).select("symbol", "w", "open", "high", "low", "close", "volume")


def smoothing(bars: DataFrame, n: int, value: str = "close") -> DataFrame:
    """Exponential smoothing per symbol with weight 1/n, kept in state between batches. `bars` must reach
    each symbol in time order across batches; inside a batch they are sorted here."""
    schema = "symbol string, ts timestamp, smoothed double"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, level = state.get if state.exists else (0, 0.0)
        batch = pd.concat(list(frames)).sort_values("ts")  # closed bars of one symbol in one micro-batch
        out = []
        for ts, x in zip(batch["ts"], batch[value]):
            level = x if count == 0 else level * (1 - 1 / n) + x / n
            count += 1
            out.append((key[0], ts, level if count >= n else None))
        state.update((count, float(level)))
        yield pd.DataFrame(out, columns=["symbol", "ts", "smoothed"])

    return bars.groupBy("symbol").applyInPandasWithState(step, schema, "count long, level double", "append", GroupStateTimeout.NoTimeout)


def upsert_stream(stream: DataFrame, path: str, keys: Sequence[str], seq: str, schema: StructType, buckets: int = 0) -> Callable[[DataFrame, int], None]:
    """Batch function for `foreachBatch`: per key the row with the highest `seq` stays, of the batch or of the table, so
    late rows and replayed batches change nothing and any split into batches gives the same table. With `buckets` a batch
    rewrites only the buckets of its own keys."""

    def merge(batch: DataFrame, _: int) -> None:
        upsert_table(batch.sparkSession, path, batch, keys, schema, seq=seq, newest=True, buckets=buckets)

    return merge


def daily_counts(news: DataFrame, words: dict[str, str], lateness: str = "2 days") -> DataFrame:
    """Action words per symbol and day; the trailing sum runs over the small daily table afterwards."""
    timed = news.withWatermark("at", lateness)
    hits = [F.count_if(F.contains(F.lower("headline"), F.lit(w))).alias(n) for w, n in words.items()]
    return timed.groupBy("symbol", F.window("at", "1 day").alias("w")).agg(*hits).select("symbol", F.to_date("w.start").alias("day"), *words.values())


def trailing_counts(daily: DataFrame, names: Sequence[str], days: int = 180) -> DataFrame:
    from pyspark.sql import Window

    number = F.datediff("day", F.to_date(F.lit("1970-01-01")))
    w = Window.partitionBy("symbol").orderBy("_n").rangeBetween(1 - days, 0)  # one row per symbol and day
    return daily.withColumn("_n", number).select("symbol", "day", *[F.sum(c).over(w).alias(c) for c in names])


def _valid(by: str, event_time: str, valid_from: str, valid_to: str, buckets: Buckets) -> Column:
    """An event meets the facts of its key and bucket that hold strictly after `valid_from`, up to `valid_to`."""
    inside = (F.col(valid_from) < F.col(event_time)) & (F.col(valid_to).isNull() | (F.col(event_time) <= F.col(valid_to)))
    return (F.col(by) == F.col("_by")) & (buckets.of(F.col(event_time)) == F.col(BUCKET)) & inside


def enrich(events: DataFrame, facts: DataFrame, by: str, event_time: str, valid_from: str, valid_to: str, buckets: Buckets = MONTHS) -> DataFrame:
    """Stream-static join on validity intervals: the fact known strictly before the event. `facts` are
    intervals (from, to], so each event meets one row; they are cut at time buckets, so a hot key is spread."""
    f = cut(facts.withColumnRenamed(by, "_by"), valid_from, valid_to, buckets)
    return events.join(f, _valid(by, event_time, valid_from, valid_to, buckets), "left").drop("_by", BUCKET)


def enrich_streams(
    events: DataFrame, facts: DataFrame, by: str, event_time: str, valid_from: str, valid_to: str, *, lateness: str, facts_lateness: str, longest: str, buckets: Buckets = MONTHS
) -> DataFrame:
    """Stream-stream form of `enrich`: both sides move, and a fact may arrive after the events that it holds for.

    A fact holds for `longest` at most (an interval such as "10 days"), so either side's state ends: an event is
    dropped from it, with NULLs if it met no fact, once the watermark has passed it, a fact `longest` after it began.
    Events later than `lateness` and facts later than `facts_lateness` are dropped."""
    e = events.withWatermark(event_time, lateness)
    f = cut(facts.withColumnRenamed(by, "_by").withWatermark(valid_from, facts_lateness), valid_from, valid_to, buckets)
    bounded = F.col(event_time) <= F.col(valid_from) + F.expr(f"INTERVAL {longest}")
    return e.join(f, _valid(by, event_time, valid_from, valid_to, buckets) & bounded, "left").drop("_by", BUCKET)


def run_to_table(stream: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """Drain what is available into a parquet table in the scratch folder and read it back."""
    spark = stream.sparkSession
    root = f"{scratch_root(spark)}/stream-{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{root}/table").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema or stream.schema).parquet(f"{root}/table")


def written_in_order(df: DataFrame, name: str, slice_of: str, slices: int) -> str:
    """The folder of a table whose files appear slice by slice (column `slice_of`, 0 .. slices - 1), as a stream's would."""
    path = f"{scratch_root(df.sparkSession)}/stream-{name}-{uuid.uuid4().hex}"
    for i in range(slices):
        df.where(F.col(slice_of) == i).drop(slice_of).coalesce(1).write.mode("append").parquet(path)
    return path


def run_upserts(stream: DataFrame, name: str, keys: Sequence[str], seq: str, buckets: int = 16) -> DataFrame:
    spark, schema = stream.sparkSession, stream.schema
    root = f"{scratch_root(spark)}/stream-{name}-{uuid.uuid4().hex}"
    merge = upsert_stream(stream, f"{root}/table", keys, seq, schema, buckets)
    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return read_table(spark, f"{root}/table", schema)
