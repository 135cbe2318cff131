"""Streams that stop and go on, count, and expire."""

import pytest
from pyspark.sql import functions as F

from alertmill.streaming import incremental

SCHEMA = "alert_id string, run string, verdict string, ts timestamp"


@pytest.fixture
def folder(spark, tmp_path):
    def add(name, *rows):
        df = spark.createDataFrame([(i, r, v, s) for i, r, v, s in rows], "alert_id string, run string, verdict string, s string").withColumn("ts", F.col("s").cast("timestamp")).drop("s")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / name))

    add("a", ("1", "r", "tp", "2024-01-01 00:00:00"), ("2", "r", "fp", "2024-01-01 00:00:30"), ("1", "r", "tp", "2024-01-01 00:00:40"))
    return tmp_path, add


def read(spark, tmp):
    return incremental.read(spark, str(tmp / "in" / "*"), SCHEMA)


def test_resume_does_each_alert_once(spark, folder):
    tmp, add = folder
    out, ck = str(tmp / "out"), str(tmp / "ck")
    go = lambda: incremental.resume(incremental.once(read(spark, tmp), "alert_id", "ts"), out, ck, lambda df: df.withColumn("done", F.lit(True)))
    go()
    assert sorted(r.alert_id for r in spark.read.parquet(out).collect()) == ["1", "2"]
    add("b", ("2", "r", "fp", "2024-01-01 00:10:00"), ("3", "r", "tp", "2024-01-01 00:10:00"))
    go()
    go()
    got = spark.read.parquet(out)
    assert sorted(r.alert_id for r in got.collect()) == ["1", "2", "3"] and got.where("done").count() == 3


def drain(spark, df, name, tmp, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_running_numbers(spark, folder):
    tmp, _ = folder
    got = drain(spark, incremental.numbered(read(spark, tmp), "run"), "numbers", tmp, "append")
    assert sorted((r.number, r.alert_id) for r in got.collect()) == [(1, "1"), (2, "1"), (3, "2")]


def test_progress_windows(spark, folder):
    tmp, add = folder
    add("late", ("9", "r", "tp", "2024-01-01 02:00:00"))
    got = drain(spark, incremental.progress(read(spark, tmp), "ts"), "windows", tmp, "update")
    assert sum(r.done for r in got.where("window.start < '2024-01-01 01:00:00'").collect()) == 3


def test_expiry(spark, folder):
    tmp, add = folder
    add("late", ("9", "r", "tp", "2024-01-01 02:00:00"))
    got = drain(spark, incremental.expired(read(spark, tmp), "alert_id", "ts", 60), "expiry", tmp, "update")
    assert {r.alert_id for r in got.where("not expired").collect()} == {"1", "2", "9"}
    assert "9" not in {r.alert_id for r in got.where("expired").collect()}


def test_sink_sends_in_order(spark, folder):
    tmp, _ = folder
    sent = []
    incremental.sink(read(spark, tmp).select("alert_id", "verdict"), sent.extend, str(tmp / "s")).awaitTermination()
    assert [x["alert_id"] for x in sent] == ["1", "1", "2"]
