import time

import pytest
from table_rows import rows
from pyspark.sql import functions as F

from larkspur.streaming import windows

DDL = "id long, user long, ts timestamp, v double"


def sample(spark):
    data = [(1, 1, "2024-01-01 00:10:00", 1.0), (2, 1, "2024-01-01 00:50:00", 2.0), (3, 1, "2024-01-01 09:00:00", 4.0), (4, 2, "2024-01-01 01:00:00", 8.0), (4, 2, "2024-01-01 01:00:00", 8.0)]
    return spark.createDataFrame(data, "id long, user long, t string, v double").select("id", "user", F.col("t").cast("timestamp").alias("ts"), "v")


def test_batch_windows(spark):
    df = sample(spark)
    t = windows.tumbling(df, "ts", "1 hour", ["user"], [F.sum("v").alias("s")])
    assert sorted(r.s for r in t.collect()) == [3.0, 4.0, 16.0]
    w = windows.session_windows(df, "ts", "2 hours", ["user"], [F.count(F.lit(1)).alias("n")])
    assert sorted((r.user, r.n) for r in w.collect()) == [(1, 1), (1, 2), (2, 2)]
    assert windows.sliding(df, "ts", "2 hours", "1 hour", [], [F.count(F.lit(1)).alias("n")]).agg(F.sum("n")).first()[0] == 10
    assert windows.deduplicated(df, "ts", ["id"], "1 hour").count() == 4


def test_stream_equals_batch(spark, tmp_path):
    df = sample(spark)
    df.write.parquet(str(tmp_path / "in"))
    stream = windows.event_stream(spark, str(tmp_path / "in"), df.schema)
    windows.buffered_append(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(df)
    got = []
    windows.fan_out(windows.deduplicated(stream, "ts", ["id"], "1 day"), lambda b, i: got.extend(rows(b)), str(tmp_path / "c2")).awaitTermination(60)
    assert sorted(got) == rows(df.distinct())
    q = windows.running_totals(stream, "ts", "user", "v").writeStream.outputMode("update").format("memory").queryName("totals").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.awaitTermination(60)
    assert rows(spark.table("totals")) == [(1, 3, 7.0), (2, 2, 16.0)]


def test_idle_state_is_dropped(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    days = [("2024-01-01", 1), ("2024-01-02", 1), ("2024-02-01", 2), ("2024-03-01", 1)]
    for k, (day, user) in enumerate(days):
        df = spark.createDataFrame([(k, user, f"{day} 00:00:00", 1.0)], "id long, user long, t string, v double").select("id", "user", F.col("t").cast("timestamp").alias("ts"), "v")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = windows.event_stream(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    out = windows.running_totals(stream, "ts", "user", "v", "1 hour", idle_seconds=7 * 86_400)
    q = out.writeStream.outputMode("update").format("memory").queryName("idle").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert rows(spark.table("idle")) == [(1, 1, 1.0), (1, 1, 1.0), (1, 2, 2.0), (2, 1, 1.0)]
