"""Runs, intervals and their exclusions: gaps and islands in windows by session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSION = ("session_id",)


def _order(keys, order="sample_idx"):
    return Window.partitionBy(*keys).orderBy(order)


def _true(flag) -> Column:
    return F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False))


def run_boundaries(df: DataFrame, flag, keys=SESSION, order: str = "sample_idx") -> DataFrame:
    """df with run_start and run_end: true where a run of true begins or ends; a missing neighbour is not true."""
    on = _true(flag)
    before, after = F.lag(on).over(_order(keys, order)), F.lead(on).over(_order(keys, order))
    return df.withColumns({"run_start": on & ~F.coalesce(before, F.lit(False)), "run_end": on & ~F.coalesce(after, F.lit(False))})


def with_runs(df: DataFrame, flag, name: str, keys=SESSION, order: str = "sample_idx") -> DataFrame:
    """df with the number of each row's run of true (null elsewhere)."""
    on = _true(flag)
    start = on & ~F.coalesce(F.lag(on).over(_order(keys, order)), F.lit(False))
    number = F.sum(F.when(start, 1).otherwise(0)).over(_order(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__on", on).withColumn(name, F.when(F.col("__on"), number)).drop("__on")


def long_enough(start, end, minimum_duration: float) -> Column:
    """`end >= start + d`, in this form: the difference of the two rounds otherwise."""
    return end >= start + F.lit(float(minimum_duration))


def segments(df: DataFrame, flag, minimum_duration: float = 0.015, keys=SESSION) -> DataFrame:
    """Runs of true of at least the minimum duration: keys, start_time, end_time, start_idx, end_idx."""
    runs = with_runs(df, flag, "__run", keys).where("__run is not null")
    out = runs.groupBy(*keys, "__run").agg(F.min("t").alias("start_time"), F.max("t").alias("end_time"), F.min("sample_idx").alias("start_idx"), F.max("sample_idx").alias("end_idx"))
    return out.where(long_enough(F.col("start_time"), F.col("end_time"), minimum_duration)).drop("__run")


def extend_to_mean(df: DataFrame, above_mean, above_threshold, minimum_duration: float = 0.015, keys=SESSION) -> DataFrame:
    """Above-mean runs of the minimum duration that hold an above-threshold run of it; the threshold is not below the mean.

    Runs within runs are numbered together, so containment is a group and no join is needed.
    """
    outer = with_runs(df.withColumn("__high", _true(above_threshold)), above_mean, "__outer", keys)
    inner = with_runs(outer, F.col("__high") & F.col("__outer").isNotNull(), "__inner", keys).where("__outer is not null")
    parts = inner.groupBy(*keys, "__outer", "__inner").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.min("sample_idx").alias("i"), F.max("sample_idx").alias("j"))
    passes = F.col("__inner").isNotNull() & long_enough(F.col("a"), F.col("b"), minimum_duration)
    runs = parts.groupBy(*keys, "__outer").agg(F.min("a").alias("start_time"), F.max("b").alias("end_time"), F.min("i").alias("start_idx"), F.max("j").alias("end_idx"), F.bool_or(passes).alias("__passes"))
    return runs.where("__passes").where(long_enough(F.col("start_time"), F.col("end_time"), minimum_duration)).drop("__outer", "__passes")


def threshold(df: DataFrame, z: str = "z", minimum_duration: float = 0.015, zscore_threshold: float = 2.0, keys=SESSION) -> DataFrame:
    """Runs of z >= 0 that hold z >= threshold for the minimum duration."""
    if zscore_threshold < 0:
        raise ValueError("zscore_threshold must not be negative")
    return extend_to_mean(df, F.col(z) >= 0, F.col(z) >= F.lit(float(zscore_threshold)), minimum_duration, keys)


def mark_events(df: DataFrame, z: str = "z", minimum_duration: float = 0.015, zscore_threshold: float = 2.0, keys=SESSION) -> DataFrame:
    """As threshold(), on the rows: df with `ends`, at the first sample of each event the index of its last one, else null."""
    if zscore_threshold < 0:
        raise ValueError("zscore_threshold must not be negative")
    outer = with_runs(df.withColumn("__high", F.col(z) >= F.lit(float(zscore_threshold))), F.col(z) >= 0, "__outer", keys)
    inner = with_runs(outer, F.col("__high") & F.col("__outer").isNotNull(), "__inner", keys)
    part, run = Window.partitionBy(*keys, "__outer", "__inner"), Window.partitionBy(*keys, "__outer")
    enough = F.col("__inner").isNotNull() & long_enough(F.min("t").over(part), F.max("t").over(part), minimum_duration)
    rows = inner.withColumn("__enough", enough)
    passes = F.col("__outer").isNotNull() & F.max("__enough").over(run) & long_enough(F.min("t").over(run), F.max("t").over(run), minimum_duration)
    first = F.col("sample_idx") == F.min("sample_idx").over(run)
    return rows.withColumn("ends", F.when(passes & first, F.max("sample_idx").over(run))).drop("__high", "__outer", "__inner", "__enough")


def containing_interval(candidates: DataFrame, targets: DataFrame, keys=SESSION) -> DataFrame:
    """For each target the last candidate that does not start after it (its end is not looked at): an as-of join by a sweep."""
    left = candidates.select(*keys, F.col("start_time").alias("__at"), F.lit(0).alias("__kind"), F.struct("start_time", "end_time").alias("__c"), F.lit(None).cast("double").alias("__end"))
    right = targets.select(*keys, F.col("start_time").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(left.schema["__c"].dataType).alias("__c"), F.col("end_time").alias("__end"))
    # Of candidates that start together the one of the latest end is last.
    sweep = Window.partitionBy(*keys).orderBy("__at", "__kind", F.col("__c.end_time")).rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("__c", F.last("__c", ignorenulls=True).over(sweep)).where("__kind = 1")
    return found.select(*keys, F.col("__at").alias("target_start"), F.col("__end").alias("target_end"), F.col("__c.start_time").alias("start_time"), F.col("__c.end_time").alias("end_time"))


def extend_segments(targets: DataFrame, candidates: DataFrame, keys=SESSION) -> DataFrame:
    """The containing intervals of all targets, each once."""
    return containing_interval(candidates, targets, keys).where("start_time is not null").select(*keys, "start_time", "end_time").distinct()


def merge_overlapping(ranges: DataFrame, keys=SESSION, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Ranges that overlap or touch become one; other columns named start_idx and end_idx follow where they exist."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    islands = ranges.withColumn("__new", fresh).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    idx = [F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx")] if {"start_idx", "end_idx"} <= set(ranges.columns) else []
    return islands.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), *idx).drop("__island")


def exclude_movement(events: DataFrame, position: DataFrame, speed_threshold: float = 4.0, keys=SESSION) -> DataFrame:
    """Events whose speed at the first and at the last sample is at most the threshold; an unknown speed drops the event."""
    slow = position.where(F.col("speed") <= F.lit(float(speed_threshold))).select(*keys, "sample_idx")
    first = events.join(slow.withColumnRenamed("sample_idx", "start_idx"), [*keys, "start_idx"], "left_semi")
    return first.join(slow.withColumnRenamed("sample_idx", "end_idx"), [*keys, "end_idx"], "left_semi").select(*events.columns)


def exclude_close(events: DataFrame, gap: float = 1.0, keys=SESSION) -> DataFrame:
    """Events at least `gap` after the end of the previous candidate, whether that one was kept or not."""
    before = F.lag("end_time").over(Window.partitionBy(*keys).orderBy("start_time", "end_time"))
    return events.withColumn("__before", before).where(F.col("__before").isNull() | (F.col("start_time") - F.col("__before") >= F.lit(float(gap)))).drop("__before")
