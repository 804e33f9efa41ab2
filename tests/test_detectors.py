"""Detectors on simulated signals, the one seeded golden case, sources and flows."""

import numpy as np
import pytest
from tools import rows
from pyspark.sql import functions as F

from burstline.functions import kernels
from burstline.operators import signals, validate
from burstline.plans import detectors, flows
from burstline.sources import simulate, tables

FS = 1500.0


def recording(spark, times=(1.1, 2.1), channels=3, seed=1, session="0", amplitude=3.0):
    """Band-passed bursts in white noise, all channels."""
    rng = np.random.default_rng(seed)
    t = np.arange(4500) / FS
    data = []
    for _ in range(channels):
        x = 0.5 * rng.standard_normal(len(t))
        for c in times:
            x += amplitude / 2 * np.sin(2 * np.pi * 200 * t) * np.exp(-0.5 * ((t - c) / (0.1 / 6)) ** 2)
        data.append(kernels.zero_phase(x, kernels.packaged_kernel()))
    return tables.samples_from_arrays(spark, t, np.column_stack(data), session), tables.position_from_arrays(spark, t, np.full(len(t), 2.0), session)


@pytest.fixture(scope="module")
def signal(spark):
    samples, position = recording(spark)
    return samples.cache(), position.cache()


@pytest.mark.parametrize("name", ["consensus", "mean_envelope", "channel"])
def test_two_bursts(spark, signal, name):
    out = flows.detect(*signal, FS, name, filtered=True, zscore_threshold=3.0).orderBy("event_number").collect()
    assert [r.event_number for r in out] == [1, 2]
    assert all(r.start_time <= c <= r.end_time for r, c in zip(out, (1.1, 2.1), strict=True))


def test_scale_order_and_other_sessions_change_nothing(spark, signal):
    samples, position = signal
    base = rows(detectors.consensus_detector(samples, position, FS))
    louder = samples.withColumn("x", F.col("x") * 7).orderBy(F.desc("x")).repartition(5)
    again = rows(detectors.consensus_detector(louder, position, FS))
    assert [r[1] for r in base] == [r[1] for r in again] and np.allclose([r[2:] for r in base], [r[2:] for r in again])
    other, where = recording(spark, (0.7,), seed=9, session="1")
    both = detectors.consensus_detector(samples.unionByName(other), position.unionByName(where), FS)
    assert np.allclose([r[2:] for r in rows(both.where("session_id = '0'"))], [r[2:] for r in base])
    assert both.where("session_id = '1'").count() >= 1


def test_movement_and_closeness(spark, signal):
    samples, position = signal
    moving = position.withColumn("speed", F.when(F.col("t") > 1.5, 5.0).otherwise(1.0))
    out = detectors.consensus_detector(samples, moving, FS, zscore_threshold=3.0).collect()
    assert len(out) == 1 and out[0].end_time < 1.5
    assert detectors.consensus_detector(samples, position, FS, zscore_threshold=3.0, close_event_threshold=2.0).count() == 1


def test_missing_rows_are_left_out(spark, signal):
    samples, position = signal
    holed = samples.withColumn("x", F.when((F.col("sample_idx") == 100) & (F.col("channel_id") == 1), None).otherwise(F.col("x")))
    assert signals.drop_incomplete(holed, position).select("sample_idx").distinct().count() == 4499
    assert detectors.consensus_detector(holed, position, FS, zscore_threshold=3.0).count() == 2


def test_higher_thresholds_find_no_more(spark, signal):
    samples, position = signal
    counts = [detectors.mean_envelope_detector(samples, position, FS, zscore_threshold=z).count() for z in (1.0, 3.0, 30.0)]
    assert counts == sorted(counts, reverse=True) and counts[-1] == 0


def test_noise_alone_finds_nothing(spark):
    samples, position = recording(spark, (), channels=1, seed=42)
    assert detectors.consensus_detector(samples, position, FS, zscore_threshold=6.0).count() == 0


def test_synchrony_golden(spark):
    rng = np.random.default_rng(42)
    counts = np.zeros((4500, 10))
    counts[rng.random((4500, 10)) < 0.01] = 1
    for i in (1200, 2700):
        counts[i : i + 10, :7] = 1
    t = np.arange(4500) / FS
    out = detectors.synchrony_detector(tables.spikes_from_arrays(spark, counts), tables.position_from_arrays(spark, t, np.full(4500, 2.0)), FS)
    found = out.orderBy("event_number").collect()
    assert len(found) == 2
    assert round(np.mean([r.duration for r in found]), 4) == 0.079 and round(np.mean([r.mean_zscore for r in found]), 4) == 3.3065
    assert [(round(r.start_time, 6), round(r.end_time, 6)) for r in found] == [(0.764667, 0.841333), (1.756667, 1.838)]


def test_deprecated_baseline_warns(spark):
    t = np.arange(300) / FS
    position = tables.position_from_arrays(spark, t, np.where(t > 0.1, 9.0, 1.0))
    with pytest.warns(DeprecationWarning):
        detectors.synchrony_detector(tables.spikes_from_arrays(spark, np.ones((300, 1))), position, FS, use_speed_threshold_for_zscore=True)


def test_checks(spark, signal):
    samples, position = signal
    with pytest.raises(ValueError, match="no column"):
        validate.check_samples(samples.drop("x"))
    with pytest.raises(ValueError, match="numeric"):
        validate.check_samples(samples.withColumn("x", F.array("x")))
    with pytest.raises(ValueError, match="other units"):
        validate.check_time_units(samples.withColumn("t", F.col("t") * 1000), FS)
    with pytest.warns(UserWarning):
        validate.check_time_units(samples, 1000.0)
    with pytest.warns(UserWarning):
        validate.check_speed_units(position.withColumn("speed", F.lit(0.02)), 4.0)
    with pytest.raises(ValueError, match="different instants"):
        validate.check_aligned(samples, position.where("sample_idx > 3"))
    with pytest.raises(ValueError, match="more than"):
        validate.check_lengths(samples, 1500)
    with pytest.raises(ValueError, match="1500"):
        signals.band_pass(samples, sampling_frequency=1000.0)


def test_smoothing_forms_agree(spark):
    rng = np.random.default_rng(0)
    x = (rng.random(700) < 0.05) * rng.integers(1, 4, 700)
    samples = tables.samples_from_arrays(spark, np.arange(700) / FS, x)
    dense = [r.x for r in signals.gaussian_smooth(samples, 0.015, FS).orderBy("sample_idx").collect()]
    grid = tables.time_grid(spark, 700, FS)
    sparse = [r.x for r in signals.smooth_sparse(samples.select("session_id", "sample_idx", "x"), grid, 0.015, FS).orderBy("sample_idx").collect()]
    want = kernels.convolve(x.astype(float), kernels.gaussian_kernel(0.015, FS))
    assert np.allclose(dense, want, atol=1e-12) and np.allclose(sparse, want, atol=1e-12)


def test_band_pass_keeps_missing_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1200, 2))
    x[50, 0] = np.nan
    out = signals.band_pass(tables.samples_from_arrays(spark, np.arange(1200) / FS, x)).orderBy("channel_id", "sample_idx").collect()
    y = np.array([np.nan if r.x is None else r.x for r in out]).reshape(2, 1200)
    kept = np.delete(np.arange(1200), 50)
    assert np.isnan(y[:, 50]).all()
    for c in range(2):
        assert np.allclose(y[c, kept], kernels.zero_phase(x[kept, c], kernels.packaged_kernel()))


def test_simulation(spark):
    grid = tables.time_grid(spark, 3000, FS)
    x = np.array([r.x for r in simulate.waveform(grid, 1.0).orderBy("sample_idx").collect()])
    f = np.fft.rfftfreq(3000, 1 / FS)[np.argmax(np.abs(np.fft.rfft(x)))]
    assert 180 < f < 220 and 0.9 < np.abs(x).max() <= 1.0
    assert rows(simulate.waveform(grid, []).select(F.max("x"))) == [(0.0,)]
    assert simulate.waveform(grid, 1e6).where("x is not null").count() == 0
    a, b, c = (rows(simulate.simulate(grid, [1.0], noise_type="pink", seed=s).select("sample_idx", "x")) for s in (1, 1, 2))
    assert a == b != c
    with pytest.raises(KeyError):
        simulate.noise(grid, "blue")
    scaled = simulate.normalize_power(grid.withColumn("x", F.col("t") + 1))
    assert abs(simulate.mean_squares(scaled).first().mean_square - 1) < 1e-9
    assert simulate.normalize_power(grid.withColumn("x", F.lit(0.0))).where("x is not null").count() == 0


DETECTORS = {"consensus": detectors.consensus_detector, "mean_envelope": detectors.mean_envelope_detector, "channel": detectors.channel_detector}


@pytest.mark.parametrize("name", list(DETECTORS))
def test_detectors_check_what_they_are_given(spark, signal, name):
    samples, position = signal
    find = DETECTORS[name]
    with pytest.raises(ValueError, match="different instants"):
        find(samples, position.where("sample_idx > 3"), FS)
    with pytest.raises(ValueError, match="other units"):
        find(samples.withColumn("t", F.col("t") * 1000), position, FS)
    with pytest.raises(ValueError, match="no samples"):
        find(samples, position, FS, normalization_time_range=(50, 60))
    with pytest.raises(ValueError, match="no samples"):
        find(samples, position.withColumn("none", F.lit(False)), FS, normalization_mask="none")
    with pytest.raises(ValueError, match="not both"):
        find(samples, position, FS, normalization_mask="m", normalization_time_range=(0, 1))
    with pytest.warns(UserWarning, match="cm/s"):
        find(samples, position.withColumn("speed", F.lit(0.02)), FS)
    assert find(samples, position.where("sample_idx > 3"), FS, checked=False).count() >= 0
    assert find(samples, position, FS, normalization_time_range=(0.0, 0.9), zscore_threshold=5.0).count() == 2


def test_synchrony_checks_what_it_is_given(spark):
    position = tables.position_from_arrays(spark, np.arange(300) / FS, np.full(300, 2.0))
    spikes = tables.spikes_from_arrays(spark, np.ones((300, 1)))
    with pytest.raises(ValueError, match="no samples"):
        detectors.synchrony_detector(spikes, position, FS, normalization_time_range=(50, 60))
    with pytest.raises(ValueError, match="other units"):
        detectors.synchrony_detector(spikes, position.withColumn("t", F.col("t") * 1000), FS)
    assert detectors.synchrony_detector(spikes, position, FS, normalization_time_range=(50, 60), checked=False).count() == 0


def test_short_sessions_are_found_on_the_driver(spark):
    rng = np.random.default_rng(3)
    long = tables.samples_from_arrays(spark, np.arange(1200) / FS, rng.standard_normal(1200), "long")
    short = tables.samples_from_arrays(spark, np.arange(1200) / FS, np.where(np.arange(1200) < 500, np.nan, rng.standard_normal(1200)), "short")
    both = long.unionByName(short)
    with pytest.raises(ValueError, match="session short: 700 samples"):
        signals.band_pass(both)
    with pytest.raises(ValueError, match="more than"):
        flows.detect(both, both.select("session_id", "sample_idx", "t", F.lit(1.0).alias("speed")), FS)


@pytest.mark.parametrize(("name", "passes"), [("consensus", 2), ("mean_envelope", 1), ("channel", 1)])
def test_a_detector_makes_its_trace_once(spark, signal, name, passes):
    out = DETECTORS[name](*signal, FS, checked=False)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FlatMapGroupsInArrow") == passes
    assert plan.count("Exchange hashpartitioning") < 20 and "CartesianProduct" not in plan


def test_blocks_of_a_long_channel(spark):
    """Two million samples in blocks, against the whole at once."""
    n = 2_000_000
    rng = np.random.default_rng(8)
    x = rng.standard_normal(n)
    samples = tables.samples_from_arrays(spark, np.arange(n) / FS, x)
    taps = kernels.packaged_kernel()
    out = signals.band_pass(samples, checked=False).select("sample_idx", "x").toPandas().sort_values("sample_idx")
    assert np.abs(out["x"].to_numpy() - kernels.zero_phase(x, taps)).max() < 1e-9
    out = signals.gaussian_smooth(samples, 0.004, FS).select("sample_idx", "x").toPandas().sort_values("sample_idx")
    assert np.abs(out["x"].to_numpy() - kernels.convolve(x, kernels.gaussian_kernel(0.004, FS))).max() < 1e-9


def test_envelope_in_blocks_errs_as_stated(spark):
    n = 60_000
    x = kernels.zero_phase(np.random.default_rng(12).standard_normal(n), kernels.packaged_kernel())
    samples = tables.samples_from_arrays(spark, np.arange(n) / FS, x)
    out = signals.envelope(samples, halo=4096, block=10_000).select("sample_idx", "x").toPandas().sort_values("sample_idx")
    whole = kernels.envelope(x)
    apart = np.abs(out["x"].to_numpy() - whole) / whole.max()
    assert apart[4096:-4096].max() < 1e-4 and apart[500:-500].max() < 1e-3


@pytest.mark.parametrize("name", ["consensus", "mean_envelope", "channel"])
def test_detectors_with_envelopes_in_blocks(spark, signal, name, monkeypatch):
    """The same events within a sample or two; scores differ a little, as the ends of the blocks do."""
    monkeypatch.setattr(signals, "BLOCK", 64)
    whole = rows(DETECTORS[name](*signal, FS, zscore_threshold=3.0, checked=False))
    cut = rows(DETECTORS[name](*signal, FS, zscore_threshold=3.0, checked=False, envelope_halo=400))
    assert len(cut) == len(whole) == 2
    for a, b in zip(cut, whole, strict=True):
        assert a[1] == b[1] and abs(a[2] - b[2]) < 2.1 / FS and abs(a[3] - b[3]) < 2.1 / FS and abs(a[6] - b[6]) < 0.05


@pytest.mark.parametrize("n", [1000, 1023, 1024, 1025, 1340, 1341, 2049])
def test_blocks_of_any_length(spark, n):
    """Channels that end within, at and just beyond a block and its neighbours."""
    x = np.random.default_rng(n).standard_normal((n, 2))
    samples = tables.samples_from_arrays(spark, np.arange(n) / FS, x)
    taps = kernels.remez(51, [(0, 125), (150, 250), (275, 750)], [0, 1, 0], FS)
    out = signals.band_pass(samples, taps, block=256).orderBy("channel_id", "sample_idx").collect()
    got = np.array([r.x for r in out]).reshape(2, n)
    for c in range(2):
        assert np.allclose(got[c], kernels.zero_phase(x[:, c], taps), atol=1e-9)


def test_places_are_numbered_through_blocks(spark):
    rng = np.random.default_rng(2)
    at = sorted(rng.choice(1000, 300, replace=False).tolist())
    df = spark.createDataFrame([(s, i, c) for s in "ab" for i in at for c in (0, 1)], "session_id string, sample_idx long, channel_id int")
    out = signals.numbered(df, block=64).collect()
    assert len(out) == 1200 and all(at[r.dense_idx] == r.sample_idx for r in out)


def test_events_that_overlap_or_touch_are_one(spark):
    """Marked rows against the same events merged and measured one by one."""
    from burstline.operators import segments as seg
    from burstline.operators import stats

    rng = np.random.default_rng(4)
    n = 400
    z, speed = np.round(rng.standard_normal(n), 3), np.round(rng.uniform(0, 6, n), 3)
    pairs = {}
    for a, d in zip(rng.integers(0, n - 30, 25).tolist(), rng.integers(0, 25, 25).tolist(), strict=True):
        pairs[a] = max(pairs.get(a, 0), a + d)
    rows_of = [("s", i, i / FS, float(z[i]), float(speed[i]), pairs.get(i)) for i in range(n)]
    marked = spark.createDataFrame(rows_of, "session_id string, sample_idx long, t double, z double, speed double, ends long")
    events = spark.createDataFrame([("s", a / FS, b / FS, a, b) for a, b in pairs.items()], "session_id string, start_time double, end_time double, start_idx long, end_idx long")
    kept = seg.exclude_close(seg.exclude_movement(seg.merge_overlapping(events), marked, 4.0), 0.003)
    want = rows(stats.event_stats(kept, marked, 0.002))
    got = rows(stats.marked_events(marked, 4.0, 0.003, 0.002))
    assert len(want) > 2 and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and all((x is None and y is None) or abs(x - y) < 1e-9 for x, y in zip(a[2:], b[2:], strict=True))


def test_sources(spark, tmp_path):
    x = np.arange(12.0).reshape(4, 3)
    np.save(tmp_path / "x.npy", x)
    samples = tables.load_npy(spark, str(tmp_path / "x.npy"), FS)
    wide = tables.samples_to_wide(samples)
    assert [list(r.x) for r in wide.orderBy("sample_idx").collect()] == x.tolist()
    assert rows(tables.wide_to_samples(wide, "x").select("channel_id", "sample_idx", "x")) == rows(samples.select("channel_id", "sample_idx", "x"))
    with pytest.raises(ValueError):
        tables.samples_from_arrays(spark, [0, 1], [1.0, 2.0, 3.0])
    with pytest.raises(ValueError):
        tables.samples_from_arrays(spark, [0], np.zeros((1, 1, 1)))


def test_flows(spark):
    events = spark.createDataFrame([("a", 1.05), ("a", 3.0), ("b", 1.0)], "session_id string, start_time double")
    truth = spark.createDataFrame([("a", 1.1), ("a", 2.1), ("c", 1.0)], "session_id string, time double")
    assert rows(flows.score_detections(events, truth)) == [("a", 2, 1, 2, 1), ("b", 0, 0, 1, 1), ("c", 1, 0, 0, 0)]
    stats = spark.createDataFrame([(0.1, 3.0), (0.2, 4.0)], "duration double, mean_zscore double")
    assert rows(flows.compare({"x": stats, "none": stats.limit(0)})) == [("none", 0, None, None), ("x", 2, pytest.approx(150.0), pytest.approx(3.5))]
