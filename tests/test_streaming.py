"""Streams give what batches give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.observer import bar_alerts
from tidemark.streaming import windows


@pytest.fixture
def bars(spark, tmp_path):
    at = datetime(2025, 1, 27, 14, 30)
    rows = [("A", at + timedelta(minutes=i), 100 * (1 + 0.001 * (-1) ** i), 1000.0) for i in range(20)] + [("A", at + timedelta(minutes=20), 92.0, 10_000.0), ("B", at, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, volume double")
    for i, (a, b) in enumerate(((0, 8), (8, 16), (16, 99))):
        m = (F.col("ts") - F.lit(at)).cast("interval day to second")
        part = df.where((m >= F.expr(f"interval {a} minutes")) & (m < F.expr(f"interval {b} minutes")))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p{i}"))
    return df, tmp_path


def test_bar_alerts(spark, bars):
    df, tmp = bars
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp / "in/*"))
    q = windows.bar_alerts(stream, "symbol", "ts", "close", "volume").writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted((r.symbol, r.ts, round(r.return_z, 6), round(r.vol_ratio, 6), r.is_anomaly) for r in d.collect())
    got = key(spark.table("alerts"))
    assert got == key(bar_alerts(df, "symbol", ["ts"], "close", "volume"))
    assert [x[4] for x in got].count(True) == 1


def test_window_counts_and_steps(spark, bars):
    df, tmp = bars
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp / "in/*"))
    q = windows.window_counts(read()).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.n for r in spark.table("counts").collect()) == 22
    seen = []
    steps = [lambda d, i: seen.append(("a", d.count())), lambda d, i: seen.append(("b", d.count()))]
    for _ in range(2):
        windows.each_window(read(), steps, str(tmp / "ck")).awaitTermination()
    assert seen == [("a", 22), ("b", 22)]  # the second run finds nothing new


def test_first_seen_once(spark, bars):
    df, tmp = bars
    q = windows.first_seen(spark.readStream.schema(df.schema).parquet(str(tmp / "in/*")), "symbol", "ts").writeStream.format("memory").queryName("firsts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 2


def test_past_outputs_do_not_see_the_future(spark):
    rows = spark.createDataFrame([(i, i * i) for i in range(10)], "win long, y long")
    changed = rows.where("win <= 5").unionByName(spark.createDataFrame([(7, -1)], "win long, y long"))
    from pyspark.sql import Window as W

    run = lambda d: d.select("win", F.sum("y").over(W.orderBy("win")).alias("s"))
    ahead = lambda d: d.select("win", F.sum("y").over(W.orderBy("win").rowsBetween(0, 1)).alias("s"))
    assert windows.same_before(run, rows, changed, 5) and not windows.same_before(ahead, rows, changed, 5)
