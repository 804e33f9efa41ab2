"""Streams on a frozen baseline give what the finished recording gives."""

import datetime as dt

from tools import rows
from pyspark.sql import functions as F

from burstline.streaming import live

START = dt.datetime(2024, 1, 1)


def test_stream_equals_batch(spark, tmp_path):
    data = [("a", START + dt.timedelta(milliseconds=i), 5.0 if 100 <= i < 120 or 300 <= i < 310 else 0.0) for i in range(500)]
    df = spark.createDataFrame(data, "session_id string, ts timestamp, x double")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    moments = live.freeze_moments(df).cache()
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    found = live.burst_sessions(live.score_stream(stream, moments), 2.0)
    # A far later row would close the last burst in append mode; complete sets come out in batch form below.
    query = found.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = live.burst_sessions(live.score_stream(df, moments), 2.0)
    assert [(r[1], r[3]) for r in rows(batch)] == [(START + dt.timedelta(milliseconds=100), 20), (START + dt.timedelta(milliseconds=300), 10)]
    assert {r.start_ts for r in spark.table("bursts").collect()} <= {r.start_ts for r in batch.collect()}


def test_unknown_keys_have_no_score(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "session_id string, x double")
    moments = live.freeze_moments(df.where("session_id = 'a'"))
    assert rows(live.score_stream(df, moments).select("session_id", "z")) == [("a", None), ("b", None)]


def test_windowed_rate(spark):
    df = spark.createDataFrame([("a", START + dt.timedelta(seconds=s), 1.0) for s in (0.1, 0.2, 1.5)], "session_id string, ts timestamp, n double")
    assert [r[3] for r in rows(live.windowed_rate(df))] == [2.0, 1.0]
    assert live.windowed_rate(df, "2 seconds", "1 second").agg(F.sum("n_spikes")).first()[0] == 6.0
