import json
import os

import pytest
from helpers import d, rows
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources import lake as lk, text_files as tf
from tidemark.streaming import jobs


def test_upsert_last_wins(spark, tmp_path):
    schema = StructType.fromDDL("k int, v int")
    path = str(tmp_path / "t")
    lk.upsert_table(spark, path, spark.createDataFrame([(1, 10), (2, 20)], schema), ["k"], schema)
    lk.upsert_table(spark, path, spark.createDataFrame([(2, 21), (3, 30)], schema), ["k"], schema)
    assert rows(spark.read.parquet(path)) == [(1, 10), (2, 21), (3, 30)]


def test_partitioned_upsert_touches_only_its_partitions(spark, tmp_path):
    schema = StructType.fromDDL("symbol string, k int, v int")
    path = str(tmp_path / "t")
    lk.upsert_table(spark, path, spark.createDataFrame([("A", 1, 10), ("1E5", 1, 5)], schema), ["symbol", "k"], schema, "symbol")
    before = {f: os.path.getmtime(tmp_path / "t" / "symbol=1E5" / f) for f in os.listdir(tmp_path / "t" / "symbol=1E5")}
    lk.upsert_table(spark, path, spark.createDataFrame([("A", 1, 11), ("A", 2, 20)], schema), ["symbol", "k"], schema, "symbol")
    after = {f: os.path.getmtime(tmp_path / "t" / "symbol=1E5" / f) for f in os.listdir(tmp_path / "t" / "symbol=1E5")}
    assert before == after
    table = spark.read.schema(schema).parquet(path)
    assert rows(table.select("symbol", "k", "v")) == [("1E5", 1, 5), ("A", 1, 11), ("A", 2, 20)]
    assert rows(lk.list_symbols(table)) == [("1E5",), ("A",)] and lk.read_symbol(table, "1E5").count() == 1


@pytest.mark.parametrize("buckets", [0, 4])
@pytest.mark.parametrize("broken", [(1,), (2,), (2, 3)])
def test_a_failed_swap_loses_nothing(spark, tmp_path, monkeypatch, buckets, broken):
    """Renames of one upsert: away, in, and back. Whichever fails, the old rows are there or come back with the next run."""
    schema = StructType.fromDDL("k int, v int")
    path = str(tmp_path / "t")
    lk.upsert_table(spark, path, spark.createDataFrame([(1, 10), (2, 20), (3, 30)], schema), ["k"], schema, buckets=buckets)
    real, calls = lk._rename, []

    def fail(files, source, target):
        calls.append(1)
        return len(calls) not in broken and real(files, source, target)

    monkeypatch.setattr(lk, "_rename", fail)
    with pytest.raises(OSError):
        lk.upsert_table(spark, path, spark.createDataFrame([(2, 21)], schema), ["k"], schema, buckets=buckets)
    monkeypatch.setattr(lk, "_rename", real)
    if broken != (2, 3):
        assert rows(lk.read_table(spark, path, schema)) == [(1, 10), (2, 20), (3, 30)]
    lk.upsert_table(spark, path, spark.createDataFrame([(2, 22)], schema), ["k"], schema, buckets=buckets)
    assert rows(lk.read_table(spark, path, schema)) == [(1, 10), (2, 22), (3, 30)]


def test_a_batch_of_one_key_rewrites_one_bucket(spark, tmp_path):
    schema = StructType.fromDDL("k int, v int")
    path = tmp_path / "t"
    lk.upsert_table(spark, str(path), spark.createDataFrame([(i, i) for i in range(100)], schema), ["k"], schema, buckets=8)
    files = lambda: {f: os.path.getmtime(f) for f in path.glob("bucket=*/*.parquet")}
    before = files()
    lk.upsert_table(spark, str(path), spark.createDataFrame([(7, -7)], schema), ["k"], schema, buckets=8)
    after = files()
    assert len({f.parent for f in before}) == 8 and len({f.parent for f in set(before) - set(after)}) == 1
    assert all(after[f] == t for f, t in before.items() if f in after)
    assert rows(lk.read_table(spark, str(path), schema)) == sorted((i, -7 if i == 7 else i) for i in range(100))


def test_newest_partitions_not_days(spark):
    df = spark.createDataFrame([(d("2024-01-01"), 1), (d("2024-01-02"), 2), (d("2024-03-01"), 3), (d("2024-03-01"), 4)], "date date, i int")
    assert rows(lk.latest_partitions(df, 2), "i") == [(2,), (3,), (4,)]


def test_documents(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.0, None), ("B", 2.0, "x")], "symbol string, total double, note string")
    lk.write_documents(df, str(tmp_path / "docs"))
    files = [p for p in (tmp_path / "docs" / "symbol=A").iterdir() if p.name.endswith(".json")]
    assert json.loads(files[0].read_text()) == {"total": 1.0, "note": None}


def test_csv_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text("ticker,start_date,end_date\nA,2020-01-01,\nB,2010-01-01,2021-01-01\n")
    assert rows(tf.read_membership_csv(spark, str(tmp_path / "m.csv"))) == [("A", d("2020-01-01"), None), ("B", d("2010-01-01"), d("2021-01-01"))]
    (tmp_path / "r.csv").write_text("date,symbol,name,recommendation\n02/20/15, lions , Lions Gate ,buy \n02/20/15,LIONS,Lions Gate,BUY\n")
    assert rows(tf.read_list_csv(spark, str(tmp_path / "r.csv"))) == [(d("2015-02-20"), "LGF.A", "Lions Gate", "BUY")]


def test_sheet(spark):
    raw = spark.createDataFrame([(d("2010-01-01"), "Old Co (Closed: 03/04/2015)", " OLD.DL1 ", "$2B", "Tom", 1.0, "n/a", 0.1, 0.0, 0.1), (d("2010-01-01"), "New Co Corporate Action Details", "NEW", "?", "David", None, "12.5", None, None, None)],
                                "rec_date date, company string, ticker string, market_cap string, team string, risk_rating double, rec_price string, return double, spx_return double, excess_return double")
    a, b = sorted(tf.clean_sheet(raw).collect(), key=lambda r: r["ticker"])[::-1]
    assert (a["company"], a["ticker"], a["delisted"], a["closed_date"], a["market_cap"], a["price_unavailable"]) == ("Old Co", "OLD", True, d("2015-03-04"), 2e9, True)
    assert (b["company"], b["ticker"], b["delisted"], b["closed_date"], b["market_cap"], b["rec_price"]) == ("New Co", "NEW", False, None, None, 12.5)


TICKS = "symbol string, ts timestamp, price double, volume long"


def tick_files(spark, tmp_path, batches):
    for i, batch in enumerate(batches):
        df = spark.createDataFrame([(s, t, p) for s, t, p in batch], "symbol string, t string, price double").select("symbol", F.to_timestamp("t").alias("ts"), "price", F.lit(1).cast("long").alias("volume"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
    return spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ticks"))


def test_bars_close_only_past_the_watermark(spark, tmp_path):
    s = tick_files(spark, tmp_path, [[("A", "2024-01-01 09:31:00", 1.0), ("A", "2024-01-01 09:40:00", 2.0)], [("A", "2024-01-01 11:00:00", 3.0)]])
    out = jobs.run_to_table(jobs.tick_bars(s, 60, "10 minutes"), "t")
    assert [(str(r["w"]["start"]), r["open"], r["close"], r["volume"]) for r in out.collect()] == [("2024-01-01 09:30:00", 1.0, 2.0, 2)]


def test_smoothing_state_survives_batches(spark, tmp_path):
    s = tick_files(spark, tmp_path, [[("A", f"2024-01-01 0{i}:00:00", float(i))] for i in range(1, 6)])
    out = jobs.run_to_table(jobs.smoothing(s.select("symbol", "ts", F.col("price").alias("close")), 2), "s")
    level, want = 1.0, [None]
    for x in (2.0, 3.0, 4.0, 5.0):
        level = level / 2 + x / 2
        want.append(level)
    assert [r["smoothed"] for r in out.orderBy("ts").collect()] == want


def test_stream_upsert_is_replayable(spark, tmp_path):
    schema = StructType.fromDDL("k string, v double, seq timestamp")
    path = str(tmp_path / "out")
    merge = jobs.upsert_stream(None, path, ["k"], "seq", schema)
    batch = spark.createDataFrame([("a", 1.0, "2024-01-01 00:00:00"), ("a", 2.0, "2024-01-02 00:00:00")], "k string, v double, s string").select("k", "v", F.to_timestamp("s").alias("seq"))
    merge(batch, 0)
    merge(batch, 0)
    assert rows(spark.read.parquet(path), "k", "v") == [("a", 2.0)]


def test_upserts_do_not_depend_on_row_order_or_batches(spark, tmp_path):
    schema = StructType.fromDDL("k int, at int, v string")
    events = [(1, 5, "new"), (1, 3, "old"), (2, 1, "a"), (1, 5, "newer"), (2, 4, "b"), (2, 2, "late"), (1, 1, "oldest")]
    seen = set()
    for n, split in enumerate(([events], [events[:1], events[1:]], [[e] for e in events], [[e] for e in reversed(events)])):
        path = str(tmp_path / f"t{n}")
        merge = jobs.upsert_stream(None, path, ["k"], "at", schema)
        for i, batch in enumerate(split):
            merge(spark.createDataFrame(batch, schema), i)
        merge(spark.createDataFrame(split[-1], schema), len(split))  # a replay changes nothing
        seen.add(tuple(rows(spark.read.parquet(path))))
        assert os.listdir(tmp_path) and not [f for f in os.listdir(tmp_path) if ".new-" in f or ".old-" in f]
    assert seen == {((1, 5, "newer"), (2, 4, "b"))}
