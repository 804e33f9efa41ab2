"""The four detectors: traces, scores, events, exclusions, statistics.

Each is one pass: rows are dealt by session once for the trace, and scores, runs, events, exclusions and statistics are windows and aggregates
that keep this. Checks are jobs of their own on the inputs and can be left out.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.operators import normalize as norm
from burstline.operators import segments as seg
from burstline.operators import signals, validate
from burstline.operators.stats import marked_events

TimeRange = tuple[float, float] | None


def _prepared(samples: DataFrame, position: DataFrame, sampling_frequency: float, speed_threshold: float, mask: str | None, time_range: TimeRange, checked: bool) -> DataFrame:
    validate.check_samples(samples)
    validate.check_position(position)
    if checked:
        validate.check_aligned(samples, position)
        validate.check_time_units(samples, sampling_frequency)
        validate.check_speed_units(position, speed_threshold)
    complete = signals.drop_incomplete(samples, position, mask)
    if checked:
        validate.check_baseline(complete, norm.baseline(mask, time_range))
    return complete


def _by_dense(trace: DataFrame) -> DataFrame:
    """Order by the place among complete instants; indices of events are those."""
    return trace.drop("sample_idx").withColumnRenamed("dense_idx", "sample_idx")


def _single(trace: DataFrame, minimum_duration, zscore_threshold, method, mask, time_range) -> DataFrame:
    """Marked rows of a trace that is dealt by session."""
    return seg.mark_events(norm.normalize(trace, "x", method, mask, time_range, dealt=True), "z", minimum_duration, zscore_threshold)


def consensus_detector(
    samples: DataFrame, position: DataFrame, sampling_frequency: float, speed_threshold: float = 4.0, minimum_duration: float = 0.015,
    zscore_threshold: float = 2.0, smoothing_sigma: float = 0.004, close_event_threshold: float = 0.0, normalization_method: str = "zscore",
    normalization_mask: str | None = None, normalization_time_range: TimeRange = None, checked: bool = True, enveloped: bool = True, envelope_halo: int | None = None,
) -> DataFrame:
    """Events of the consensus of all channels (band-passed samples). normalization_mask names a BOOLEAN column of position; checked=False leaves
    the checks of values out (a job each: ValueError for other instants, units of time or an empty baseline, warnings); enveloped=False leaves the envelope out;
    envelope_halo cuts channels into blocks for it (see signals.envelope), for recordings too long for a task a channel."""
    norm.check_arguments(normalization_method, normalization_mask, normalization_time_range)
    complete = _prepared(samples, position, sampling_frequency, speed_threshold, normalization_mask, normalization_time_range, checked)
    extra = ("speed", *filter(None, [normalization_mask]))
    trace = signals.consensus_trace(complete, sampling_frequency, smoothing_sigma, enveloped, extra=extra, halo=envelope_halo)
    marked = _single(_by_dense(trace), minimum_duration, zscore_threshold, normalization_method, normalization_mask, normalization_time_range)
    return marked_events(marked, speed_threshold, close_event_threshold, minimum_duration)


def mean_envelope_detector(
    samples: DataFrame, position: DataFrame, sampling_frequency: float, speed_threshold: float = 4.0, minimum_duration: float = 0.015,
    zscore_threshold: float = 2.0, smoothing_sigma: float = 0.004, close_event_threshold: float = 0.0, normalization_method: str = "zscore",
    normalization_mask: str | None = None, normalization_time_range: TimeRange = None, checked: bool = True, envelope_halo: int | None = None,
) -> DataFrame:
    """Events of the mean over channels of smoothed envelopes; arguments as in consensus_detector()."""
    norm.check_arguments(normalization_method, normalization_mask, normalization_time_range)
    complete = _prepared(samples, position, sampling_frequency, speed_threshold, normalization_mask, normalization_time_range, checked)
    extra = ("speed", *filter(None, [normalization_mask]))
    trace = signals.mean_envelope_trace(complete, sampling_frequency, smoothing_sigma, extra=extra, halo=envelope_halo)
    marked = _single(_by_dense(trace), minimum_duration, zscore_threshold, normalization_method, normalization_mask, normalization_time_range)
    return marked_events(marked, speed_threshold, close_event_threshold, minimum_duration)


def channel_detector(
    samples: DataFrame, position: DataFrame, sampling_frequency: float, speed_threshold: float = 4.0, minimum_duration: float = 0.015,
    zscore_threshold: float = 3.0, smoothing_sigma: float = 0.004, close_event_threshold: float = 0.0, normalization_method: str = "zscore",
    normalization_mask: str | None = None, normalization_time_range: TimeRange = None, checked: bool = True, envelope_halo: int | None = None,
) -> DataFrame:
    """Events of single channels, merged where they overlap. Scores are means over channels, so a mean score may lie under the threshold;
    max_thresh is taken at 0.015 s whatever the minimum duration. Arguments as in consensus_detector()."""
    norm.check_arguments(normalization_method, normalization_mask, normalization_time_range)
    complete = _prepared(samples, position, sampling_frequency, speed_threshold, normalization_mask, normalization_time_range, checked)
    smooth = _by_dense(signals.channel_envelopes(complete, sampling_frequency, smoothing_sigma, halo=envelope_halo))
    scored = norm.normalize(smooth, "x", normalization_method, normalization_mask, normalization_time_range, keys=signals.CHANNEL, per_channel=True, dealt=True)
    marked = seg.mark_events(scored, "z", minimum_duration, zscore_threshold, keys=signals.CHANNEL)
    mean = marked.groupBy("session_id", "sample_idx").agg(F.first("t").alias("t"), F.first("speed").alias("speed"), F.avg("z").alias("z"), F.max("ends").alias("ends"))
    return marked_events(mean, speed_threshold, close_event_threshold, 0.015)


def synchrony_detector(
    spikes: DataFrame, position: DataFrame, sampling_frequency: float, speed_threshold: float = 4.0, minimum_duration: float = 0.015,
    zscore_threshold: float = 2.0, smoothing_sigma: float = 0.015, close_event_threshold: float = 0.0, use_speed_threshold_for_zscore: bool = False,
    normalization_method: str = "zscore", normalization_mask: str | None = None, normalization_time_range: TimeRange = None, checked: bool = True,
) -> DataFrame:
    """High-synchrony events of all units (spikes: session_id, unit_id, sample_idx, n; absent rows are zero) on the grid of position
    (session_id, sample_idx, t, speed). SQL functions alone. use_speed_threshold_for_zscore is deprecated: a mask of slow samples."""
    norm.check_arguments(normalization_method, normalization_mask, normalization_time_range)
    validate.check_position(position)
    mask = normalization_mask
    if use_speed_threshold_for_zscore:
        warnings.warn("use_speed_threshold_for_zscore is deprecated: give a normalization mask", DeprecationWarning, stacklevel=2)
        if mask is None and normalization_time_range is None:
            position, mask = position.withColumn("__slow", F.col("speed") < F.lit(float(speed_threshold))), "__slow"
    if checked:
        validate.check_time_units(position, sampling_frequency)
        validate.check_speed_units(position, speed_threshold)
        validate.check_baseline(position, norm.baseline(mask, normalization_time_range))
    rate = signals.population_rate(spikes, position, sampling_frequency, smoothing_sigma)
    marked = _single(rate, minimum_duration, zscore_threshold, normalization_method, mask, normalization_time_range)
    return marked_events(marked, speed_threshold, close_event_threshold, 0.015)
