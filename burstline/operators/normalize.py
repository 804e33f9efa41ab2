"""z-scores and median/MAD scores, on the whole signal or a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstline.functions.kernels import MAD_TO_SD
from burstline.operators import validate
from burstline.operators.segments import SESSION

METHODS = ("zscore", "median_mad")


def check_arguments(method: str, mask=None, time_range=None, has_time: bool = True) -> None:
    if mask is not None and time_range is not None:
        raise ValueError("give either a normalization mask or a time range, not both")
    if time_range is not None and not has_time:
        raise ValueError("a normalization time range needs times")
    if method not in METHODS:
        raise ValueError(f"unknown normalization method {method!r}: use one of {', '.join(METHODS)}")


def baseline(mask: str | Column | None = None, time_range: tuple[float, float] | None = None) -> Column | None:
    """The condition that picks baseline rows; None for all. Both ends of a range belong to it."""
    if mask is not None:
        return F.coalesce(F.col(mask) if isinstance(mask, str) else mask, F.lit(False))
    if time_range is not None:
        return F.col("t").between(float(time_range[0]), float(time_range[1]))
    return None


def normalize(
    df: DataFrame, value: str = "x", method: str = "zscore", mask: str | Column | None = None,
    time_range: tuple[float, float] | None = None, keys=SESSION, per_channel: bool = False, out: str = "z", checked: bool = False, dealt: bool = False,
) -> DataFrame:
    """df with `out`: all rows scored by the statistics of the baseline rows, for each group of keys.

    per_channel says that `keys` holds a channel. A spread of zero gives null (z-score on the whole signal), zeros (baseline or MAD of a
    single trace) or a divisor of one (baseline or MAD by channel). checked=True raises ValueError where a group's baseline is empty (a job of its own).
    dealt says that df is dealt by keys already: statistics are then windows over it; else they are a table of one row a group, which df meets.
    """
    check_arguments(method, mask, time_range, "t" in df.columns)
    df = df.withColumn(value, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")))
    rows = baseline(mask, time_range)
    pick = F.col(value) if rows is None else F.when(rows, F.col(value))
    if checked:
        validate.check_baseline(df, rows, keys)
    median = lambda c: F.percentile(c, F.lit(0.5))
    over = Window.partitionBy(*keys)
    if method == "zscore":
        found = {"__centre": F.avg(pick), "__spread": F.stddev_pop(pick), "__flat": F.min(pick) == F.max(pick)}
        if dealt:
            scored = df.withColumns({n: (F.min(pick).over(over) == F.max(pick).over(over)) if n == "__flat" else c.over(over) for n, c in found.items()})
        else:
            scored = df.join(df.groupBy(*keys).agg(*(c.alias(n) for n, c in found.items())), list(keys), "left")
    else:
        apart = F.abs(pick - F.col("__centre"))
        if dealt:
            scored = df.withColumn("__centre", median(pick).over(over)).withColumn("__spread", median(apart).over(over) * F.lit(MAD_TO_SD))
        else:
            medians = df.groupBy(*keys).agg(median(pick).alias("__centre"))
            stats = df.join(medians, list(keys)).groupBy(*keys).agg(F.first("__centre").alias("__centre"), (median(apart) * F.lit(MAD_TO_SD)).alias("__spread"))
            scored = df.join(stats, list(keys), "left")
        scored = scored.withColumn("__flat", F.col("__spread") == 0)
    flat = F.coalesce("__flat", F.lit(True)) | (F.col("__spread") == 0)
    score = (F.col(value) - F.col("__centre")) / F.when(flat, None).otherwise(F.col("__spread"))
    if method == "zscore" and rows is None:
        z = F.when(~flat, score)
    elif per_channel:
        z = F.when(flat, F.col(value) - F.col("__centre")).otherwise(score)
    else:
        z = F.when(flat | F.col("__spread").isNull(), F.lit(0.0)).otherwise(score)
    return scored.withColumn(out, z).drop("__centre", "__spread", "__flat")
