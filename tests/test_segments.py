"""Runs, intervals and exclusions on literal cases and against loops."""

import numpy as np
import pytest
from tools import rows

from burstline.operators import segments as seg

INTERVAL = "session_id string, start_time double, end_time double, start_idx long, end_idx long"


def flags(spark, values, step=0.005, session="a"):
    return spark.createDataFrame([(session, i, round(i * step, 9), bool(v) if v is not None else None) for i, v in enumerate(values)], "session_id string, sample_idx long, t double, flag boolean")


@pytest.mark.parametrize(
    ("bits", "starts", "ends"),
    [("0011010", [2, 5], [3, 5]), ("1100011", [0, 5], [1, 6]), ("0000000", [], []), ("1111111", [0], [6]), ("1010101", [0, 2, 4, 6], [0, 2, 4, 6])],
)
def test_run_boundaries(spark, bits, starts, ends):
    out = seg.run_boundaries(flags(spark, map(int, bits)), "flag").collect()
    assert sorted(r.sample_idx for r in out if r.run_start) == starts
    assert sorted(r.sample_idx for r in out if r.run_end) == ends


@pytest.mark.parametrize(("bits", "found"), [("011110", [(0.005, 0.02)]), ("0110", []), ("11110", [(0.0, 0.015)]), ("0111100111", [(0.005, 0.02)]), ("000", [])])
def test_segments_of_fifteen_milliseconds(spark, bits, found):
    out = seg.segments(flags(spark, map(int, bits)), "flag")
    assert rows(out.select("start_time", "end_time")) == found


def test_missing_flag_breaks_a_run(spark):
    out = seg.segments(flags(spark, [1, 1, 1, 1, None, 1, 1, 1, 1]), "flag")
    assert [r[2:] for r in rows(out.select("session_id", "start_time", "start_idx", "end_idx"))] == [(0, 3), (5, 8)]


def intervals(spark, pairs, session="a"):
    return spark.createDataFrame([(session, float(a), float(b), i, i) for i, (a, b) in enumerate(pairs)], INTERVAL)


def test_containing_and_extended(spark):
    wide = intervals(spark, [(1, 2), (5, 7), (20, 30)])
    out = seg.containing_interval(wide, intervals(spark, [(24, 26)]))
    assert rows(out.select("start_time", "end_time")) == [(20.0, 30.0)]
    assert rows(seg.extend_segments(intervals(spark, [(24, 26), (27, 28)]), wide)) == [("a", 20.0, 30.0)]
    assert rows(seg.containing_interval(wide, intervals(spark, [(0, 1)])).select("start_time")) == [(None,)]


@pytest.mark.parametrize(("pairs", "merged"), [([(5, 7), (3, 5), (-1, 3)], [(-1.0, 7.0)]), ([(0, 1), (2, 3)], [(0.0, 1.0), (2.0, 3.0)]), ([(0, 9), (1, 2), (3, 4)], [(0.0, 9.0)]), ([], [])])
def test_merge(spark, pairs, merged):
    assert rows(seg.merge_overlapping(intervals(spark, pairs)).select("start_time", "end_time")) == merged


def test_merge_against_a_loop_and_by_session(spark):
    rng = np.random.default_rng(5)
    made = {s: [(a, a + d) for a, d in zip(rng.uniform(0, 100, 50), rng.exponential(1.5, 50), strict=True)] for s in "ab"}
    df = intervals(spark, made["a"], "a").unionByName(intervals(spark, made["b"], "b"))
    want = []
    for s, pairs in made.items():
        done = []
        for a, b in sorted(pairs):
            if done and a <= done[-1][1]:
                done[-1][1] = max(done[-1][1], b)
            else:
                done.append([a, b])
        want += [(s, *x) for x in done]
    assert rows(seg.merge_overlapping(df).select("session_id", "start_time", "end_time")) == sorted(want, key=repr)


def test_threshold_literal(spark):
    x = np.array([0.0] * 2 + [10] * 2 + [0] * 3 + [1, 5] + [10] * 5 + [5, 1, 0])
    z = (x - x.mean()) / x.std()
    df = spark.createDataFrame([("a", i, i / 1000, float(v)) for i, v in enumerate(z)], "session_id string, sample_idx long, t double, z double")
    assert rows(seg.threshold(df, "z", 0.004, 1.0).select("start_time", "end_time")) == [(0.008, 0.014)]
    with pytest.raises(ValueError):
        seg.threshold(df, "z", 0.004, -1.0)


def test_movement_looks_at_both_ends_alone(spark):
    speed = [1 if 3 <= i <= 10 else 5 for i in range(20)]
    position = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(speed)], "session_id string, sample_idx long, speed double")
    events = spark.createDataFrame([("a", i / 1000, j / 1000, i, j) for i, j in [(4, 10), (1, 5), (5, 12), (15, 18)]], INTERVAL)
    assert rows(seg.exclude_movement(events, position).select("start_idx", "end_idx")) == [(4, 10)]


def test_close_events_look_at_the_previous_candidate(spark):
    keep = lambda pairs, gap: [r[0] for r in rows(seg.exclude_close(intervals(spark, pairs), gap).select("start_time"))]
    assert keep([(0, 0.1), (0.15, 0.2), (1, 1.1), (1.05, 1.15)], 0.1) == [0.0, 1.0]
    assert keep([(0, 1), (1.05, 1.1), (1.15, 1.2)], 0.1) == [0.0]
    assert keep([], 1.0) == []
