"""Made-up signals: coloured noise and bursts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.functions.kernels import coloured_noise
from burstline.operators.signals import by_channel

#: Fixed value: frequency of a simulated burst (Hz).
BURST_FREQUENCY = 200.0
#: Noises by name and the power of frequency that amplitudes fall with.
NOISES = {"white": 0.0, "pink": 0.5, "brown": 1.0}


def mean_squares(df: DataFrame, value: str = "x", keys=("session_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.col(value) * F.col(value)).alias("mean_square"))


def normalize_power(df: DataFrame, value: str = "x", like: str | None = None, keys=("session_id",)) -> DataFrame:
    """df with `value` scaled to the mean square of column `like` (or to one); null where it has no power."""
    target = F.avg(F.col(like) * F.col(like)) if like else F.lit(1.0)
    power = df.groupBy(*keys).agg(F.avg(F.col(value) * F.col(value)).alias("__own"), target.alias("__like"))
    factor = F.sqrt(F.col("__like") / F.when(F.col("__own") > 0, F.col("__own")))
    return df.join(power, list(keys)).withColumn(value, F.col(value) * factor).drop("__own", "__like")


def noise(grid: DataFrame, kind: str = "brown", seed: int | None = None) -> DataFrame:
    """grid (session_id, sample_idx, t) with x, one series of coloured noise a session; equal seeds give equal series."""
    if kind not in NOISES:
        raise KeyError(f"unknown noise {kind!r}: use one of {', '.join(NOISES)}")
    power, base = NOISES[kind], np.random.SeedSequence(seed).entropy
    zeros = grid.withColumn("x", F.xxhash64("session_id").cast("double"))

    def series(x: np.ndarray) -> np.ndarray:
        # The session's own number and the seed give the series, so a task that runs again makes the same.
        own = int(abs(x[0])) if len(x) else 0
        return coloured_noise(len(x), power, np.random.default_rng([base % 2**63, own % 2**63]))

    return by_channel(zeros, series, keys=("session_id",))


def waveform(grid: DataFrame, burst_times, amplitude: float = 2.0, duration: float = 0.100, frequency: float = BURST_FREQUENCY) -> DataFrame:
    """grid with x, the sum of bursts: half the amplitude, a sine in a normal curve whose greatest sampled value is one.

    A burst so far from all samples that its curve is zero there gives null.
    """
    centres = [float(c) for c in np.atleast_1d(np.asarray(burst_times, float))]
    if not centres:
        return grid.withColumn("x", F.lit(0.0))
    spread = float(duration) / 6
    curve = lambda c: F.exp(-0.5 * F.pow((F.col("t") - F.lit(c)) / F.lit(spread), 2))
    peaks = grid.groupBy("session_id").agg(*(F.max(curve(c)).alias(f"__p{i}") for i, c in enumerate(centres)))
    total = sum((curve(c) / F.when(F.col(f"__p{i}") > 0, F.col(f"__p{i}")) for i, c in enumerate(centres)), F.lit(0.0))
    sine = F.sin(F.lit(2 * np.pi * frequency) * F.col("t"))
    return grid.join(peaks, "session_id").withColumn("x", F.lit(amplitude / 2) * sine * total).drop(*(f"__p{i}" for i in range(len(centres))))


def simulate(grid: DataFrame, burst_times, amplitude: float = 2.0, duration: float = 0.100, noise_type: str = "brown", noise_amplitude: float = 1.3, seed: int | None = None) -> DataFrame:
    """grid with x, bursts at the given times (a number or a list; none: noise alone) and half noise_amplitude of noise."""
    bursts = waveform(grid, burst_times, amplitude, duration)
    own = noise(grid.select("session_id", "sample_idx", "t"), noise_type, seed).select("session_id", "sample_idx", F.col("x").alias("__noise"))
    return bursts.join(own, ["session_id", "sample_idx"]).withColumn("x", F.col("x") + F.lit(noise_amplitude / 2) * F.col("__noise")).drop("__noise")
