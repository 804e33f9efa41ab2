"""Structured Streaming forms of the operators that need no look ahead: scores on a frozen baseline, and events merged as they come.

Filters, envelopes and moments of a whole signal look ahead; streams use moments frozen from a finished recording instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def freeze_moments(samples: DataFrame, value: str = "x", keys=("session_id",)) -> DataFrame:
    """keys, centre and spread of a finished recording, to score a stream with."""
    return samples.groupBy(*keys).agg(F.avg(value).alias("centre"), F.stddev_pop(value).alias("spread"))


def score_stream(stream: DataFrame, moments: DataFrame, value: str = "x", keys=("session_id",)) -> DataFrame:
    """stream with z; a stream-static join that keeps no state. Rows of unknown keys or without spread have a null z."""
    return stream.join(moments, list(keys), "left").withColumn("z", (F.col(value) - F.col("centre")) / F.when(F.col("spread") > 0, F.col("spread"))).drop("centre", "spread")


def burst_sessions(scored: DataFrame, threshold: float = 2.0, gap: str = "15 milliseconds", late: str = "10 seconds", keys=("session_id",)) -> DataFrame:
    """Bursts of a stream (with a TIMESTAMP column ts): samples over the threshold whose distance is under the gap, with count, peak and mean."""
    over = scored.withWatermark("ts", late).where(F.col("z") >= F.lit(float(threshold)))
    grouped = over.groupBy(*keys, F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n_samples"), F.max("z").alias("max_zscore"), F.avg("z").alias("mean_zscore"), F.max("ts").alias("last_ts")).select(*keys, F.col("w.start").alias("start_ts"), "last_ts", "n_samples", "max_zscore", "mean_zscore")


def windowed_rate(spikes: DataFrame, width: str = "1 second", step: str | None = None, late: str = "10 seconds", keys=("session_id",)) -> DataFrame:
    """Spikes a window of a stream (ts, n), tumbling or sliding."""
    at = F.window("ts", width, step) if step else F.window("ts", width)
    return spikes.withWatermark("ts", late).groupBy(*keys, at.alias("w")).agg(F.sum("n").alias("n_spikes")).select(*keys, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n_spikes")
