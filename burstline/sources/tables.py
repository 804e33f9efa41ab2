"""Where signals come from: tables, arrays, .npy files, made-up time; and canonical forms of other tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLES = "session_id string, channel_id int, sample_idx long, t double, x double"
POSITION = "session_id string, sample_idx long, t double, speed double"
SPIKES = "session_id string, unit_id int, sample_idx long, n double"


def time_grid(spark: SparkSession, n_samples: int, sampling_frequency: float, session_id: str = "0") -> DataFrame:
    """session_id, sample_idx and t = index / frequency."""
    return spark.range(n_samples).select(F.lit(session_id).alias("session_id"), F.col("id").alias("sample_idx"), (F.col("id") / F.lit(float(sampling_frequency))).alias("t"))


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp with or without a zone."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def samples_from_arrays(spark: SparkSession, time, data, session_id: str = "0") -> DataFrame:
    """Samples of a matrix (instants, channels) or a single channel; NaN becomes null. Both lengths must agree."""
    time, data = np.asarray(time, float), np.asarray(data, float)
    if data.ndim not in (1, 2):
        raise ValueError(f"data must have one or two dimensions, not {data.ndim}")
    data = data.reshape(len(data), -1)
    if len(time) != len(data):
        raise ValueError(f"{len(time)} times for {len(data)} samples")
    n, channels = data.shape
    return _frame(spark, {"session_id": [session_id] * (n * channels), "channel_id": np.tile(np.arange(channels, dtype=np.int32), n), "sample_idx": np.repeat(np.arange(n), channels), "t": np.repeat(time, channels), "x": data.reshape(-1)}, SAMPLES)


def position_from_arrays(spark: SparkSession, time, speed, session_id: str = "0") -> DataFrame:
    time, speed = np.asarray(time, float), np.asarray(speed, float)
    if len(time) != len(speed):
        raise ValueError(f"{len(time)} times for {len(speed)} speeds")
    return _frame(spark, {"session_id": [session_id] * len(time), "sample_idx": np.arange(len(time)), "t": time, "speed": speed}, POSITION)


def spikes_from_arrays(spark: SparkSession, counts, session_id: str = "0") -> DataFrame:
    """Spikes of a matrix (instants, units) of counts; zeros are left out."""
    counts = np.asarray(counts, float).reshape(len(counts), -1)
    at, unit = np.nonzero(counts)
    return _frame(spark, {"session_id": [session_id] * len(at), "unit_id": unit.astype(np.int32), "sample_idx": at, "n": counts[at, unit]}, SPIKES)


def _frame(spark: SparkSession, columns: dict, schema: str) -> DataFrame:
    import pyarrow as pa

    arrays = [pa.array(v, mask=np.isnan(v)) if isinstance(v, np.ndarray) and v.dtype.kind == "f" else pa.array(v) for v in columns.values()]
    table = pa.table(dict(zip(columns, arrays, strict=True)))
    made = spark.createDataFrame(table)
    wanted = spark.createDataFrame([], schema).schema
    return made.select(*(F.col(f.name).cast(f.dataType) for f in wanted))


def load_npy(spark: SparkSession, path: str, sampling_frequency: float, session_id: str = "0") -> DataFrame:
    """Samples of a .npy matrix (instants, channels); a file of one session, read on the driver."""
    data = np.load(path, allow_pickle=False)
    return samples_from_arrays(spark, np.arange(len(data)) / sampling_frequency, data, session_id)


def wide_to_samples(df: DataFrame, values: str, keys=("session_id", "sample_idx", "t")) -> DataFrame:
    """Long form of a column of arrays, one element a channel."""
    return df.select(*keys, F.posexplode(values).alias("channel_id", "x")).select("session_id", "channel_id", "sample_idx", "t", F.col("x").cast("double").alias("x"))


def samples_to_wide(samples: DataFrame) -> DataFrame:
    """One row an instant with the array of its channels in order."""
    rows = samples.groupBy("session_id", "sample_idx").agg(F.first("t").alias("t"), F.sort_array(F.collect_list(F.struct("channel_id", "x"))).alias("__c"))
    return rows.select("session_id", "sample_idx", "t", F.transform("__c", lambda c: c["x"]).alias("x"))


def grid_of_events(events: DataFrame, session: Column, channel: Column, value: Column, sampling_frequency: float = 1500.0) -> DataFrame:
    """Samples of a table of events: each (session, channel) in order of (ts, event_id) on an even grid."""
    rows = events.select(session.alias("session_id"), channel.alias("channel_id"), "ts", "event_id", value.cast("double").alias("x"))
    index = F.row_number().over(Window.partitionBy("session_id", "channel_id").orderBy("ts", "event_id")).cast("long") - 1
    return rows.withColumn("sample_idx", index).select("session_id", "channel_id", "sample_idx", (F.col("sample_idx") / F.lit(float(sampling_frequency))).alias("t"), "x")
