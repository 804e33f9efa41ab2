"""Scores: formulas, baselines, missing values and spreads of zero."""

import numpy as np
import pytest

from burstline.operators.normalize import check_arguments, normalize


def frame(spark, values, channel=0):
    return spark.createDataFrame([("a", channel, i, float(i), None if v is None else float(v), i < 3) for i, v in enumerate(values)], "session_id string, channel_id int, sample_idx long, t double, x double, low boolean")


def z(df):
    return [r.z for r in df.orderBy("sample_idx").collect()]


def test_zscore_and_mad(spark):
    x = np.array([1, 2, 3, 4, 10.0])
    assert np.allclose(z(normalize(frame(spark, x))), (x - x.mean()) / x.std())
    mad = np.median(np.abs(x - np.median(x))) / 0.6744897501960817
    assert np.allclose(z(normalize(frame(spark, x), method="median_mad")), (x - np.median(x)) / mad)


def test_missing_values_stay_missing(spark):
    out = z(normalize(frame(spark, [1, 2, None, 4, 5])))
    assert out[2] is None and all(v is not None for i, v in enumerate(out) if i != 2)
    assert z(normalize(frame(spark, [1, 2, float("nan"), 4, 5]))) == out


def test_spread_of_zero(spark):
    flat = frame(spark, [1] * 5)
    assert z(normalize(flat)) == [None] * 5
    assert z(normalize(flat, method="median_mad")) == [0.0] * 5
    step = frame(spark, [1, 1, 1, 4, 5])
    assert z(normalize(step, mask="low")) == [0.0] * 5
    assert z(normalize(step, mask="low", keys=("session_id", "channel_id"), per_channel=True)) == [0, 0, 0, 3, 4]
    assert z(normalize(step, method="median_mad", mask="low", keys=("session_id", "channel_id"), per_channel=True)) == [0, 0, 0, 3, 4]


def test_baselines_agree(spark):
    df = frame(spark, [1, 5, 2, 8, 9])
    assert np.allclose(z(normalize(df, mask="low")), z(normalize(df, time_range=(0, 2))))


def test_errors_in_order(spark):
    df = frame(spark, [1, 2, 3])
    with pytest.raises(ValueError, match="not both"):
        check_arguments("bad", "low", (0, 1))
    with pytest.raises(ValueError, match="times"):
        check_arguments("bad", None, (0, 1), has_time=False)
    with pytest.raises(ValueError, match="unknown"):
        normalize(df, method="bad")
    with pytest.raises(ValueError, match="no samples"):
        normalize(df, time_range=(50, 60), checked=True)
