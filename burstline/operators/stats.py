"""Statistics of events: one row of sixteen measurements each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = [
    "start_time", "end_time", "duration", "max_thresh", "mean_zscore", "median_zscore", "max_zscore", "min_zscore",
    "area", "total_energy", "speed_at_start", "speed_at_end", "max_speed", "min_speed", "median_speed", "mean_speed",
]


def event_samples(events: DataFrame, samples: DataFrame, order: str = "sample_idx") -> DataFrame:
    """Samples of each event, both ends included: events spread into their indices and meet the samples on (session, index).

    That is an equi-join in proportion to the samples inside events, and right for events that overlap.
    """
    numbered = events.select("session_id", "event_number", F.explode(F.sequence("start_idx", "end_idx")).alias(order))
    return numbered.join(samples, ["session_id", order])


def _widened(rows: DataFrame, keys, z: str, order: str) -> DataFrame:
    """rows with __span, __level and __n of the window that reaches each of them; see max_threshold()."""
    by_key = Window.partitionBy(*keys)
    known = F.col(z).isNotNull()
    peak = rows.withColumn("__peak", F.min_by(order, F.struct(~known, -F.col(z), F.col(order))).over(by_key))
    side = F.when(F.col(order) < F.col("__peak"), 0).when(F.col(order) > F.col("__peak"), 1).otherwise(-1)
    far = F.abs(F.col(order) - F.col("__peak"))
    sided = peak.withColumns({"__side": side, "__far": far})
    lowest = F.min(z).over(Window.partitionBy(*keys, "__side").orderBy("__far").rowsBetween(Window.unboundedPreceding, 0))
    reached = Window.partitionBy(*keys).orderBy(F.when(F.col("__side") == -1, 0).otherwise(1), F.desc("__low"), "__side", "__far").rowsBetween(Window.unboundedPreceding, 0)
    edge = lambda s: F.coalesce(F.last(F.when(F.col("__side") == s, F.col(z)), ignorenulls=True).over(reached), F.first(z).over(reached))
    return sided.withColumn("__low", lowest).withColumns({"__span": F.max(F.when(known, F.col("t"))).over(reached) - F.min(F.when(known, F.col("t"))).over(reached), "__level": F.least(edge(0), edge(1)), "__n": F.row_number().over(reached)})


def _level(minimum_duration: float) -> Column:
    return F.min(F.when(F.col("__span") >= F.lit(float(minimum_duration)), F.struct("__n", "__level")))["__level"].alias("max_thresh")


def max_threshold(rows: DataFrame, keys, z: str = "z", order: str = "sample_idx", minimum_duration: float = 0.015) -> DataFrame:
    """The highest level that an event stays above for the minimum duration (null where it is too short).

    From the first maximum the window widens by one sample at a time to the larger neighbour (on a tie to the left) until it spans the minimum;
    the result is the lower of its two edge values. A sample is reached when the window has come
    down to the least value between it and the peak, so that order is a sort and the widening two running values.
    """
    return _widened(rows, keys, z, order).groupBy(*keys).agg(_level(minimum_duration)).where("max_thresh is not null")


def _trapezoid(value: Column, before: Column, t: Column, t_before: Column) -> Column:
    return F.coalesce(F.sum((value + before) / 2 * (t - t_before)), F.lit(0.0))


def _measured(rows: DataFrame, keys, minimum_duration: float, order: str) -> DataFrame:
    """One row of statistics for each of keys, from samples (keys, index, t, z, speed) that are dealt by them; all windows and the aggregate keep that."""
    at = Window.partitionBy(*keys).orderBy(order)
    lagged = rows.withColumns({"__z": F.lag("z").over(at), "__t": F.lag("t").over(at)})
    z, b, t, tb = F.col("z"), F.col("__z"), F.col("t"), F.col("__t")
    return _widened(lagged, keys, "z", order).groupBy(*keys).agg(
        F.min("t").alias("start_time"), F.max("t").alias("end_time"), _level(minimum_duration),
        F.avg("z").alias("mean_zscore"), F.percentile("z", F.lit(0.5)).alias("median_zscore"), F.max("z").alias("max_zscore"), F.min("z").alias("min_zscore"),
        _trapezoid(z, b, t, tb).alias("area"), _trapezoid(z * z, b * b, t, tb).alias("total_energy"),
        F.min_by("speed", order).alias("speed_at_start"), F.max_by("speed", order).alias("speed_at_end"),
        F.max("speed").alias("max_speed"), F.min("speed").alias("min_speed"), F.percentile("speed", F.lit(0.5)).alias("median_speed"), F.avg("speed").alias("mean_speed"),
    ).withColumn("duration", F.col("end_time") - F.col("start_time"))


def event_stats(events: DataFrame, samples: DataFrame, minimum_duration: float = 0.015, order: str = "sample_idx") -> DataFrame:
    """session_id, event_number (from 1 in order of start) and the sixteen columns for events (session_id, start_time, end_time, start_idx,
    end_idx), from samples (session_id, index, t, z, speed). Events may overlap."""
    numbered = events.withColumn("event_number", F.row_number().over(Window.partitionBy("session_id").orderBy("start_time", "end_time")))
    keys = ["session_id", "event_number"]
    rows = event_samples(numbered, samples.select("session_id", order, "t", "z", "speed"), order).repartition(*keys)
    return _measured(rows, keys, minimum_duration, order).select("session_id", F.col("event_number").cast("int").alias("event_number"), *COLUMNS)


def marked_events(rows: DataFrame, speed_threshold: float, gap: float, minimum_duration: float, order: str = "sample_idx") -> DataFrame:
    """Statistics of the events that rows (session_id, index, t, z, speed, ends) mark: at the first sample of an event `ends` is the index of its last.

    Events that overlap or touch are one. Those that move at either end go, then those that start less than `gap` after the end of the one before.
    No event is joined with samples: from the marks to the result nothing leaves its session, and what isn't in an event goes first.
    """
    by_time = Window.partitionBy("session_id").orderBy(order)
    reach = F.max("ends").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.col("ends").isNotNull() & (reach.isNull() | (F.col(order) > reach))
    inside = rows.select("session_id", order, "t", "z", "speed", "ends", begins.alias("__begins"))
    inside = inside.select("*", F.count_if("__begins").over(by_time.rowsBetween(Window.unboundedPreceding, 0)).alias("__event"), F.max("ends").over(by_time.rowsBetween(Window.unboundedPreceding, 0)).alias("__reach"))
    found = _measured(inside.where(F.col(order) <= F.col("__reach")), ["session_id", "__event"], minimum_duration, order)
    slow = F.lit(float(speed_threshold))
    still = found.where((F.col("speed_at_start") <= slow) & (F.col("speed_at_end") <= slow))
    by_start = Window.partitionBy("session_id").orderBy("start_time", "end_time")
    before = F.lag("end_time").over(by_start)
    kept = still.withColumn("__before", before).where(F.col("__before").isNull() | (F.col("start_time") - F.col("__before") >= F.lit(float(gap))))
    return kept.select("session_id", F.row_number().over(by_start).alias("event_number"), *COLUMNS)
