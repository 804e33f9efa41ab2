"""What analysts do with events: scores against truth, comparisons, sweeps, summaries, the whole chain at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.operators import segments as seg
from burstline.operators import signals
from burstline.plans import detectors


def score_detections(events: DataFrame, truth: DataFrame, within: float = 0.1) -> DataFrame:
    """For each session of either: n_true, n_found (true times with an event that starts within), n_events, n_false (events without one).

    truth: session_id, time. Both sides meet on time cells of the width `within`, so no session's events are all paired.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(within)).cast("long")
    e = events.select("session_id", F.col("start_time").alias("s"), F.monotonically_increasing_id().alias("e")).withColumn("cell", cell("s"))
    t = truth.select("session_id", F.col("time").alias("c"), F.monotonically_increasing_id().alias("i")).withColumn("cell", cell("c"))
    near = t.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    pairs = e.join(near, ["session_id", "cell"]).where(F.abs(F.col("s") - F.col("c")) < F.lit(within))
    hits = pairs.groupBy("session_id").agg(F.countDistinct("i").alias("n_found"), F.countDistinct("e").alias("matched"))
    sizes = e.groupBy("session_id").agg(F.count("*").alias("n_events")).join(t.groupBy("session_id").agg(F.count("*").alias("n_true")), "session_id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = sizes.join(hits, "session_id", "left").select("session_id", zero("n_true"), zero("n_found"), zero("n_events"), zero("matched"))
    return out.withColumn("n_false", F.col("n_events") - F.col("matched")).drop("matched")


def compare(results: dict[str, DataFrame]) -> DataFrame:
    """detector, n_events, mean_duration_ms and mean_zscore of each named result; detectors without events have a row too."""
    spark = next(iter(results.values())).sparkSession
    names = spark.createDataFrame([(n,) for n in results], "detector string")
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("detector"), "duration", "mean_zscore") for n, df in results.items()])
    found = rows.groupBy("detector").agg(F.count("*").alias("n_events"), (F.avg("duration") * 1000).alias("mean_duration_ms"), F.avg("mean_zscore").alias("mean_zscore"))
    return names.join(found, "detector", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)).cast("long"))


def sweep(scored: DataFrame, thresholds: list[float], minimum_duration: float = 0.015) -> DataFrame:
    """threshold and n_events: events (runs over the mean that pass) at each threshold, from one pass over scored samples.

    The runs are shared: what differs by threshold is their parts, numbered by session and threshold together.
    """
    spark = scored.sparkSession
    levels = spark.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    each = scored.withColumn("threshold", F.explode(F.array(*(F.lit(float(x)) for x in thresholds))))
    found = seg.extend_to_mean(each, F.col("z") >= 0, F.col("z") >= F.col("threshold"), minimum_duration, keys=("session_id", "threshold"))
    counts = found.groupBy("threshold").agg(F.count("*").alias("n_events"))
    return levels.join(counts, "threshold", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)).cast("long"))


def immobile(position: DataFrame, speed_threshold: float = 4.0) -> DataFrame:
    """position with the baseline column `immobile`."""
    return position.withColumn("immobile", F.coalesce(F.col("speed") < F.lit(float(speed_threshold)), F.lit(False)))


def summarise(stats: DataFrame) -> DataFrame:
    """One row: number of events, mean and sample standard deviation of durations, mean and range of scores, mean speed."""
    return stats.agg(
        F.count("*").alias("n_events"), F.avg("duration").alias("mean_duration"), F.stddev_samp("duration").alias("std_duration"),
        F.avg("mean_zscore").alias("mean_zscore"), F.max("max_zscore").alias("max_zscore"), F.min("max_thresh").alias("min_max_thresh"), F.avg("mean_speed").alias("mean_speed"),
    )


def detect(samples: DataFrame, position: DataFrame, sampling_frequency: float, detector: str = "consensus", filtered: bool = False, **options) -> DataFrame:
    """The whole chain: band-pass unless filtered, then a detector by name (consensus, mean_envelope, channel); checked=False leaves the checks of both out."""
    found = {"consensus": detectors.consensus_detector, "mean_envelope": detectors.mean_envelope_detector, "channel": detectors.channel_detector}
    if detector not in found:
        raise ValueError(f"unknown detector {detector!r}: use one of {', '.join(found)}")
    data = samples if filtered else signals.band_pass(samples, sampling_frequency=sampling_frequency, checked=options.get("checked", True))
    return found[detector](data, position, sampling_frequency, **options)


def raw_envelope_runs(samples: DataFrame, level: float, minimum_duration: float = 0.015) -> DataFrame:
    """Components on their own: envelope of each channel, a level instead of a score, runs over it."""
    return seg.segments(signals.envelope(samples), F.col("x") >= F.lit(float(level)), minimum_duration, keys=signals.CHANNEL)
