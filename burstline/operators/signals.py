"""Filters, envelopes, smoothing and rates of sampled signals.

Samples: session_id, channel_id, sample_idx long, t double (seconds), x double (null: missing). Filters and smoothing have kernels of finite
length, so a channel is cut into blocks of `BLOCK` samples, each with a kernel's radius of its neighbours beside it: no task holds a whole
channel, however long. Only the envelope looks at all of it: one task a channel. Sums over channels and sparse smoothing are plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from burstline.functions import kernels
from burstline.operators import validate

CHANNEL = ("session_id", "channel_id")
#: Samples of a block.
BLOCK = 1 << 16


def clean(samples: DataFrame, value: str = "x") -> DataFrame:
    """Values as doubles with null for NaN: null comparisons are not true, while NaN sorts above every number."""
    return samples.withColumn(value, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")))


def _block(order: str, size: int | None = None):
    return F.floor(F.col(order) / F.lit(size or BLOCK)).cast("long")


def numbered(df: DataFrame, keys=("session_id",), order: str = "sample_idx", out: str = "dense_idx", block: int | None = None) -> DataFrame:
    """df with the place (from 0) of each value of `order` among those of its keys: counted within blocks, to which the sums of the blocks before are added."""
    cut = df.withColumn("__block", _block(order, block))
    ranked = cut.withColumn("__rank", F.dense_rank().over(Window.partitionBy(*keys, "__block").orderBy(order)))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranked.groupBy(*keys, "__block").agg(F.max("__rank").alias("__size"))
    starts = sizes.select(*keys, "__block", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    return ranked.join(starts, [*keys, "__block"]).withColumn(out, (F.col("__start") + F.col("__rank") - 1).cast("long")).drop("__block", "__rank", "__start")


def drop_incomplete(samples: DataFrame, position: DataFrame | None = None, mask: str | None = None) -> DataFrame:
    """Instants at which every channel of the session has a value (and, given positions, the speed is known), with speed, the column `mask` of
    the positions and `dense_idx`, the place among what is left. All later operators of order work on dense_idx, so gaps close.

    Samples and positions are laid together and dealt once, by session and block of instants; what is joined has one row a session and block.
    """
    extra = [] if position is None else ["speed", *([mask] if mask else [])]
    own = clean(samples).drop(*extra).withColumn("__own", F.lit(True))
    channels = samples.groupBy("session_id").agg(F.size(F.collect_set("channel_id")).alias("__channels"))
    blocks = samples.select("session_id", _block("sample_idx").alias("__block")).distinct().join(channels, "session_id")
    if position is not None:
        speed = F.nanvl(F.col("speed").cast("double"), F.lit(None).cast("double")).alias("speed")
        own = own.unionByName(position.select("session_id", "sample_idx", speed, *extra[1:]), allowMissingColumns=True)
    dealt = own.withColumn("__block", _block("sample_idx")).join(blocks, ["session_id", "__block"])
    instant = Window.partitionBy("session_id", "__block", "sample_idx")
    counted = dealt.withColumns({"__n": F.count("x").over(instant), **{c: F.max(c).over(instant) for c in extra}})
    known = F.lit(True) if position is None else F.col("speed").isNotNull()
    complete = counted.where(F.col("__own") & F.col("x").isNotNull() & (F.col("__n") == F.col("__channels")) & known)
    return numbered(complete.drop("__own", "__channels", "__n", "__block"))


def by_channel(df: DataFrame, function: Callable[[np.ndarray], np.ndarray], value: str = "x", order: str = "sample_idx", keys=CHANNEL, out: str | None = None) -> DataFrame:
    """df with a function of each channel's whole ordered signal; nulls are left out and stay null."""
    out = out or value
    names = [c for c in df.columns if c != out or out == value]

    def run(table):
        import pyarrow as pa

        table = table.take(pa.array(np.argsort(table.column(order).to_numpy(), kind="stable")))
        x = table.column(value).to_pandas().to_numpy(dtype=float, na_value=np.nan)
        good = ~np.isnan(x)
        y = np.full(len(x), np.nan)
        y[good] = function(x[good])
        column = pa.array(y, pa.float64(), mask=np.isnan(y))
        return table.set_column(names.index(value), value, column) if out == value else table.append_column(out, column)

    picked = df.select(*names)
    fields = [StructField(f.name, DoubleType()) if f.name == out else f for f in picked.schema.fields]
    schema = StructType(fields if out == value else [*fields, StructField(out, DoubleType())])
    return picked.groupBy(*keys).applyInArrow(run, schema)


def by_blocks(df: DataFrame, function: Callable[[np.ndarray, bool, bool], np.ndarray], radius: int, value: str = "x", order: str = "dense_idx", keys=CHANNEL, block: int | None = None) -> DataFrame:
    """df with a function of each sample and `radius` neighbours on both sides; `order` counts the samples of a channel from 0 without gaps.

    The function gets a block with the neighbours of its ends, and whether the channel begins and ends there, and returns as many values.
    """
    block = max(block or BLOCK, 4 * radius + 1)
    here = _block(order, block)
    spread = F.sequence(F.greatest(F.lit(0), F.floor((F.col(order) - radius) / block).cast("long")), F.floor((F.col(order) + radius) / block).cast("long"))
    names = df.columns
    dealt = df.withColumn("__block", F.explode(spread)).withColumn("__inner", F.col("__block") == here)

    def run(table):
        import pyarrow as pa

        place = table.column(order).to_numpy()
        sort = np.argsort(place, kind="stable")
        place, number = place[sort], int(table.column("__block")[0].as_py())
        inner = table.column("__inner").to_numpy(zero_copy_only=False)[sort]
        x = table.column(value).to_numpy()[sort].astype(float)
        begins, ends = place[0] == 0, place[-1] < (number + 1) * block + radius - 1
        y = function(x, bool(begins), bool(ends)) if inner.any() else x
        kept = table.select(names).take(pa.array(sort[inner]))
        return kept.set_column(names.index(value), value, pa.array(y[inner], pa.float64()))

    schema = StructType([StructField(f.name, DoubleType()) if f.name == value else f for f in df.schema.fields])
    return dealt.groupBy(*keys, "__block").applyInArrow(run, schema)


def check_sampling(sampling_frequency: float | None) -> None:
    """The packaged kernel is for 1500 Hz: an error below 1200 Hz, a warning at any other frequency."""
    import warnings

    if sampling_frequency is None or np.isclose(sampling_frequency, kernels.KERNEL_FREQUENCY):
        return
    if sampling_frequency < kernels.KERNEL_LOWEST:
        raise ValueError(f"the packaged kernel is for {kernels.KERNEL_FREQUENCY:.0f} Hz; at {sampling_frequency:g} Hz design one by bandpass_taps()")
    warnings.warn(f"the packaged kernel is for {kernels.KERNEL_FREQUENCY:.0f} Hz, the signal has {sampling_frequency:g} Hz", UserWarning, stacklevel=3)


def band_pass(samples: DataFrame, taps: np.ndarray | None = None, sampling_frequency: float | None = None, checked: bool = True, block: int | None = None) -> DataFrame:
    """Zero-phase band-pass of every channel: forward and backward at once, by the kernel's autocorrelation.

    Instants at which any channel of the session is missing are left out for all and come back as null. A session of at most three kernel
    lengths raises ValueError: at once if checked (a job of its own), else when run.
    """
    if taps is None:
        check_sampling(sampling_frequency)
        taps = kernels.packaged_kernel()
    good = drop_incomplete(samples).select(*CHANNEL, "sample_idx", "dense_idx", "x")
    if checked:
        validate.check_lengths(good, len(taps))
    filtered = by_blocks(good, lambda x, begins, ends: kernels.zero_phase(x, taps, begins, ends), len(taps) - 1, block=max(block or BLOCK, 3 * len(taps) + 1))
    filtered = filtered.select(*CHANNEL, "sample_idx", F.col("x").alias("__y"))
    return samples.join(filtered, [*CHANNEL, "sample_idx"], "left").withColumn("x", F.col("__y")).drop("__y")


def envelope(samples: DataFrame, value: str = "x", order: str = "sample_idx", halo: int | None = None, block: int | None = None) -> DataFrame:
    """Magnitude of the analytic signal of each channel: of the whole channel at once, in one task.

    With a halo (`order` then counts from 0 without gaps) channels are cut into blocks with so many neighbours on both sides, and each is
    transformed alone. What lies beyond the halo weighs with one over its distance: for noise in the band of bursts at 1500 Hz a halo of 4,096 samples
    errs by less than 1e-4 of the greatest envelope. At the two ends of a channel, where the whole transform sees the other end beside them, the two
    differ by about a tenth, and by less than 1e-3 from 500 samples on.
    """
    if halo is None:
        return by_channel(samples, kernels.envelope, value, order)
    return by_blocks(samples, lambda x, begins, ends: kernels.envelope(x), halo, value, order, block=block)


def _smoothed(df: DataFrame, sigma: float, sampling_frequency: float, value: str, order: str, keys, truncate: float = 8.0, block: int | None = None) -> DataFrame:
    weights = kernels.gaussian_kernel(sigma, sampling_frequency, truncate)
    return by_blocks(df, lambda x, begins, ends: kernels.convolve(x, weights), len(weights) // 2, value, order, keys, block)


def gaussian_smooth(samples: DataFrame, sigma: float, sampling_frequency: float, value: str = "x", order: str = "sample_idx", keys=CHANNEL, truncate: float = 8.0, block: int | None = None) -> DataFrame:
    """Each channel smoothed by a normal curve; outside the signal there are zeros. Missing values are left out and stay null."""
    rows = clean(samples, value)
    good = numbered(rows.where(F.col(value).isNotNull()), keys, order, "__place", block)
    smooth = _smoothed(good, sigma, sampling_frequency, value, "__place", keys, truncate, block).drop("__place")
    return smooth.unionByName(rows.where(F.col(value).isNull()))


def smooth_sparse(points: DataFrame, grid: DataFrame, sigma: float, sampling_frequency: float, value: str = "x", keys=("session_id",), truncate: float = 8.0) -> DataFrame:
    """Smoothing in SQL, at a cost in proportion to the points that are not zero: each spreads over the kernel and sums meet on the grid.

    points: keys, sample_idx, value (absent: zero). grid: keys, sample_idx and what else is to stay. The kernel's size depends on sigma alone.
    """
    weights = kernels.gaussian_kernel(sigma, sampling_frequency, truncate)
    radius = len(weights) // 2
    spread = F.posexplode(F.array(*(F.lit(float(w)) for w in weights)))
    parts = points.where(F.col(value) != 0).select(*keys, "sample_idx", value, spread.alias("__o", "__w"))
    sums = parts.groupBy(*keys, (F.col("sample_idx") + F.col("__o") - radius).alias("sample_idx")).agg(F.sum(F.col(value) * F.col("__w")).alias(value))
    return grid.join(sums, [*keys, "sample_idx"], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def population_rate(spikes: DataFrame, grid: DataFrame, sampling_frequency: float, sigma: float = 0.015) -> DataFrame:
    """grid (session_id, sample_idx, ...) with x, the smoothed number of spikes a second of all units together; spikes off the grid don't count."""
    counts = spikes.groupBy("session_id", "sample_idx").agg((F.sum(F.col("n").cast("double")) * F.lit(float(sampling_frequency))).alias("x"))
    inside = counts.join(grid.select("session_id", "sample_idx"), ["session_id", "sample_idx"], "left_semi")
    return smooth_sparse(inside, grid, sigma, sampling_frequency)


def _instants(samples: DataFrame, x, extra=()) -> DataFrame:
    return samples.groupBy("session_id", "dense_idx").agg(F.first("sample_idx").alias("sample_idx"), F.first("t").alias("t"), *(F.first(c).alias(c) for c in extra), x.alias("x"))


def consensus_trace(complete: DataFrame, sampling_frequency: float, sigma: float = 0.004, enveloped: bool = True, extra=(), halo: int | None = None) -> DataFrame:
    """Root of the smoothed sum over channels of squared envelopes (or, without envelopes, of squared signals); halo as in envelope()."""
    source = envelope(complete, order="dense_idx", halo=halo) if enveloped else complete
    summed = _instants(source, F.sum(F.col("x") * F.col("x")), extra)
    smooth = _smoothed(summed, sigma, sampling_frequency, "x", "dense_idx", ("session_id",))
    return smooth.withColumn("x", F.sqrt(F.greatest("x", F.lit(0.0))))


def _of_envelopes(complete: DataFrame, function: Callable[[np.ndarray], np.ndarray], radius: int, halo: int | None) -> DataFrame:
    """A function of each channel's envelope, which looks `radius` samples around; one pass of NumPy a channel, or a block of it."""
    if halo is None:
        return by_channel(complete, lambda x: function(kernels.envelope(x)), order="dense_idx")
    return by_blocks(complete, lambda x, begins, ends: function(kernels.envelope(x)), halo + radius)


def mean_envelope_trace(complete: DataFrame, sampling_frequency: float, sigma: float = 0.004, extra=(), halo: int | None = None) -> DataFrame:
    """Mean over channels of the roots of smoothed squared envelopes."""
    weights = kernels.gaussian_kernel(sigma, sampling_frequency)
    rooted = _of_envelopes(complete, lambda e: np.sqrt(np.maximum(kernels.convolve(e**2, weights), 0)), len(weights) // 2, halo)
    return _instants(rooted, F.avg("x"), extra)


def channel_envelopes(complete: DataFrame, sampling_frequency: float, sigma: float = 0.004, halo: int | None = None) -> DataFrame:
    """Smoothed envelope of each channel."""
    weights = kernels.gaussian_kernel(sigma, sampling_frequency)
    return _of_envelopes(complete, lambda e: kernels.convolve(e, weights), len(weights) // 2, halo)
