"""Checks of inputs. Those of schemas are made at plan time; those of values run a job each; detectors make them unless told otherwise."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def check_samples(samples: DataFrame) -> None:
    """Session, channel, order, time and a numeric value: the table form of a matrix of instants and channels."""
    _require(samples, ("session_id", "channel_id", "sample_idx", "t", "x"), "samples")
    if not isinstance(samples.schema["x"].dataType, NumericType):
        raise ValueError("x must be numeric")


def check_position(position: DataFrame) -> None:
    _require(position, ("session_id", "sample_idx", "speed"), "position")


def _require(df: DataFrame, names, what: str) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"{what} has no column {', '.join(missing)}")


def check_aligned(samples: DataFrame, position: DataFrame) -> None:
    """Every instant of the samples has a position and the other way round."""
    a, b = (d.select("session_id", "sample_idx").distinct() for d in (samples, position))
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError("samples and position cover different instants")


def time_steps(samples: DataFrame) -> DataFrame:
    """session_id and the median step of its times."""
    instants = samples.select("session_id", "sample_idx", "t").distinct()
    step = F.col("t") - F.lag("t").over(Window.partitionBy("session_id").orderBy("sample_idx"))
    return instants.withColumn("step", step).groupBy("session_id").agg(F.percentile("step", F.lit(0.5)).alias("median_step"))


def check_time_units(samples: DataFrame, sampling_frequency: float) -> None:
    """An error where the median step is over ten sampling intervals, a warning where it is not within a fifth of one."""
    for row in time_steps(samples).agg(F.min("median_step").alias("a"), F.max("median_step").alias("b")).collect():
        if row.b is not None and row.b > 10 / sampling_frequency:
            raise ValueError(f"times step by {row.b:g}; at {sampling_frequency:g} Hz seconds step by {1 / sampling_frequency:g}. Are they in other units?")
        for step in (row.a, row.b):
            if step is not None and not np.isclose(step, 1 / sampling_frequency, rtol=0.2):
                warnings.warn(f"times step by {step:g} s, the sampling frequency says {1 / sampling_frequency:g} s", UserWarning, stacklevel=2)
                return


def speed_medians(position: DataFrame) -> DataFrame:
    """session_id and the median of its speeds above zero."""
    return position.groupBy("session_id").agg(F.percentile(F.when(F.col("speed") > 0, F.col("speed")), F.lit(0.5)).alias("median_speed"))


def check_speed_units(position: DataFrame, speed_threshold: float) -> None:
    """A warning where speeds look like metres a second and the threshold like centimetres."""
    low = speed_medians(position).agg(F.min("median_speed")).first()[0]
    if low is not None and low < 0.5 and speed_threshold > 1.0:
        warnings.warn(f"the median speed is {low:g}, the threshold {speed_threshold:g}: are speeds in cm/s?", UserWarning, stacklevel=2)


def check_lengths(samples: DataFrame, taps: int) -> None:
    """Sessions must have more than three kernels' lengths of instants that are complete in all their channels."""
    values = F.count_if(F.col("x").isNotNull() & ~F.isnan(F.col("x").cast("double")))
    instants = samples.groupBy("session_id", "sample_idx").agg(values.alias("n"))
    channels = samples.groupBy("session_id").agg(F.size(F.collect_set("channel_id")).alias("channels"))
    full = instants.join(channels, "session_id").groupBy("session_id").agg(F.count_if(F.col("n") == F.col("channels")).alias("n"))
    short = full.where(F.col("n") <= 3 * taps).limit(1).collect()
    if short:
        raise ValueError(f"session {short[0].session_id}: {short[0].n} samples; a kernel of {taps} taps needs more than {3 * taps}")


def check_baseline(rows: DataFrame, picked: Column | None, keys=("session_id",)) -> None:
    """Every group of keys must have a row that the baseline picks."""
    if picked is not None and not rows.groupBy(*keys).agg(F.count_if(picked).alias("n")).where("n = 0").isEmpty():
        raise ValueError("the normalization range or mask picks no samples")
