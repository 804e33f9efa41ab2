"""Event statistics against loops."""

import numpy as np
import pytest

from burstline.operators.stats import COLUMNS, event_stats, max_threshold


def widened(t, z, minimum):
    """The window around the first peak, one sample at a time to the larger neighbour; the lower of its edges."""
    left = right = int(np.argmax(z))
    while t[right] - t[left] < minimum:
        if left == 0 and right == len(z) - 1:
            return None
        if left == 0:
            right += 1
        elif right == len(z) - 1:
            left -= 1
        elif z[right + 1] > z[left - 1]:
            right += 1
        else:
            left -= 1
    return min(z[left], z[right])


def frame(spark, groups):
    data = [("a", e, i, i / 1500, float(v)) for e, z in groups.items() for i, v in enumerate(z)]
    return spark.createDataFrame(data, "session_id string, event_number int, sample_idx long, t double, z double")


def test_max_threshold_matches_the_loop(spark):
    rng = np.random.default_rng(2)
    groups = {e: rng.integers(0, 6, rng.integers(1, 60)) if e % 2 else rng.standard_normal(rng.integers(1, 60)) for e in range(200)}
    for minimum in (0.0, 0.005, 0.015):
        got = {r.event_number: r.max_thresh for r in max_threshold(frame(spark, groups), ["session_id", "event_number"], minimum_duration=minimum).collect()}
        want = {e: widened(np.arange(len(z)) / 1500, z, minimum) for e, z in groups.items()}
        assert got == {e: pytest.approx(float(v)) for e, v in want.items() if v is not None}


def test_sixteen_columns(spark):
    rng = np.random.default_rng(4)
    z, speed, t = rng.standard_normal(300), rng.exponential(3, 300), np.arange(300) / 1500
    samples = spark.createDataFrame([("a", i, t[i].item(), z[i].item(), speed[i].item()) for i in range(300)], "session_id string, sample_idx long, t double, z double, speed double")
    bounds = [(10, 60), (40, 90), (200, 200)]  # two overlap, one is a single sample
    events = spark.createDataFrame([("a", t[i].item(), t[j].item(), i, j) for i, j in bounds], "session_id string, start_time double, end_time double, start_idx long, end_idx long")
    out = event_stats(events, samples)
    assert out.columns == ["session_id", "event_number", *COLUMNS]
    for row, (i, j) in zip(out.orderBy("event_number").collect(), bounds, strict=True):
        a, b, c = z[i : j + 1], speed[i : j + 1], t[i : j + 1]
        want = {
            "start_time": c[0], "end_time": c[-1], "duration": c[-1] - c[0], "mean_zscore": a.mean(), "median_zscore": np.median(a), "max_zscore": a.max(), "min_zscore": a.min(),
            "area": np.trapezoid(a, c), "total_energy": np.trapezoid(a**2, c), "speed_at_start": b[0], "speed_at_end": b[-1], "max_speed": b.max(), "min_speed": b.min(),
            "median_speed": np.median(b), "mean_speed": b.mean(), "max_thresh": widened(c, a, 0.015),
        }
        for name, value in want.items():
            assert row[name] == (pytest.approx(value, abs=1e-9) if value is not None else None), name


def test_no_events_keep_the_columns(spark):
    samples = spark.createDataFrame([("a", 0, 0.0, 1.0, 1.0)], "session_id string, sample_idx long, t double, z double, speed double")
    events = spark.createDataFrame([], "session_id string, start_time double, end_time double, start_idx long, end_idx long")
    out = event_stats(events, samples)
    assert out.count() == 0 and out.columns[2:] == COLUMNS
