"""The engine's registered queries over the test tables, and the same in SQL for DuckDB.

Signals come from `events`: a session is one of four groups of users, a channel a type of event, samples follow (ts, event_id) on a grid of
1500 Hz; speed is a tenth of the channel `view`; a spike is a value over 80.
"""

from __future__ import annotations

import tempfile
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burstline.functions import kernels
from burstline.operators import normalize as norm
from burstline.operators import segments as seg
from burstline.operators import signals, stats, validate
from burstline.plans import detectors, flows
from burstline.sources import simulate, tables

FS, SIGMA, THRESHOLD, SHORT = 1500.0, 0.004, 1.0, 0.002
GAP, SPEED = 0.004, 8.0
SHORT_TAPS = kernels.remez(11, [(0, 125), (150, 250), (275, 750)], [0, 1, 0], FS)
BURSTS = [0.01, 0.05]
LEVELS = [0.5, 1.0, 1.5, 2.0]


# ---- tables ------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.grid_of_events(_events(spark, sf_dir), (F.col("user_id") % 4).cast("string"), F.col("event_type"), F.col("value"), FS)


def position(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = samples(spark, sf_dir).where("channel_id = 'view'")
    return view.select("session_id", "sample_idx", "t", (F.col("x") / 10).alias("speed"))


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).where("x > 80").select("session_id", F.col("channel_id").alias("unit_id"), "sample_idx", F.lit(1.0).alias("n"))


def _complete(spark, sf_dir):
    return signals.drop_incomplete(samples(spark, sf_dir), position(spark, sf_dir))


#: Means of values of few digits, which often lie just between two roundings.
_FINE = {"mean_speed": 9, "median_speed": 9}


def _rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    """Doubles to so many digits; a zero has no sign."""
    return df.select(*((F.round(c, _FINE.get(c, digits)) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _scored(spark, sf_dir):
    """Score of the channel `click` in each session."""
    click = samples(spark, sf_dir).where("channel_id = 'click'").drop("channel_id")
    smooth = signals.gaussian_smooth(click, 0.001, FS, keys=("session_id",))
    return norm.normalize(smooth).join(position(spark, sf_dir).drop("t"), ["session_id", "sample_idx"], "left")


def _candidates(spark, sf_dir):
    return seg.threshold(_scored(spark, sf_dir), "z", SHORT, THRESHOLD)


def _ranges(spark, sf_dir):
    start = tables.seconds(F.col("ts"))
    return _events(spark, sf_dir).select(F.col("user_id").alias("session_id"), start.alias("start_time"), (start + 60 * F.col("value")).alias("end_time"))


# ---- SQL ---------------------------------------------------------------------------------------

_BASE = """samples AS (SELECT *, sample_idx / 1500.0 AS t FROM (SELECT CAST(user_id % 4 AS VARCHAR) AS session_id, event_type AS channel_id,
    row_number() OVER (PARTITION BY user_id % 4, event_type ORDER BY ts, event_id) - 1 AS sample_idx, value AS x FROM events)),
position AS (SELECT session_id, sample_idx, t, x / 10 AS speed FROM samples WHERE channel_id = 'view'),
complete AS (SELECT s.*, p.speed FROM samples s JOIN position p USING (session_id, sample_idx)
    WHERE (session_id, sample_idx) IN (SELECT (session_id, sample_idx) FROM samples GROUP BY session_id, sample_idx HAVING count(*) = 5))"""


def _r(columns: str, source: str, digits: int = 5, plain: str = "") -> str:
    rounded = ", ".join(f"round({c}, {_FINE.get(c, digits)}) + 0.0 AS {c}" for c in columns.split())
    return f"SELECT {', '.join(x for x in (plain, rounded) if x)} FROM {source}"


def _smooth(name: str, source: str, keys: str, sigma: float, value: str = "x", extra: str = "") -> str:
    """Rows of `source` with `value` smoothed within the keys."""
    sd = sigma * FS
    radius = int(8 * sd + 0.5)
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split())
    kept = ", ".join(f"a.{k}" for k in [*keys.split(), "sample_idx", "t", *extra.split()])
    return f"""{name} AS (SELECT {kept}, sum(b.{value} * exp(-0.5 * pow((b.sample_idx - a.sample_idx) / {sd!r}, 2)) / (SELECT sum(exp(-0.5 * pow(o / {sd!r}, 2))) FROM range({-radius}, {radius + 1}) r(o))) AS {value}
    FROM {source} a JOIN {source} b ON {on} AND b.sample_idx BETWEEN a.sample_idx - {radius} AND a.sample_idx + {radius} GROUP BY {kept})"""


_ENVELOPE = """sizes AS (SELECT session_id, channel_id, count(*) AS n FROM complete GROUP BY ALL),
fast AS (SELECT DISTINCT CAST(pow(2, a) * pow(3, b) * pow(5, c) AS BIGINT) AS f FROM range(0, 22) x(a), range(0, 14) y(b), range(0, 10) z(c) WHERE pow(2, a) * pow(3, b) * pow(5, c) < 4e6),
lengths AS (SELECT session_id, channel_id, min(f) AS size FROM sizes JOIN fast ON f >= n GROUP BY ALL),
hilbert AS (SELECT a.session_id, a.channel_id, a.sample_idx, sum(b.x * CASE
      WHEN size % 2 = 0 THEN CASE WHEN (a.sample_idx - b.sample_idx) % 2 <> 0 THEN 2.0 / size / tan(pi() * (a.sample_idx - b.sample_idx) / size) ELSE 0 END
      WHEN a.sample_idx = b.sample_idx THEN 0
      ELSE (1 / tan(pi() * (a.sample_idx - b.sample_idx) / size) - cos(pi() * (a.sample_idx - b.sample_idx)) / sin(pi() * (a.sample_idx - b.sample_idx) / size)) / size END) AS h
    FROM complete a JOIN complete b USING (session_id, channel_id) JOIN lengths USING (session_id, channel_id) GROUP BY ALL),
enveloped AS (SELECT c.* EXCLUDE (x), sqrt(c.x * c.x + h * h) AS x FROM complete c JOIN hilbert USING (session_id, channel_id, sample_idx))"""

_CONSENSUS = "summed AS (SELECT session_id, sample_idx, t, any_value(speed) AS speed, sum(x * x) AS x FROM {source} GROUP BY session_id, sample_idx, t), " + _smooth("smoothed", "summed", "session_id", SIGMA, extra="speed") + ", trace AS (SELECT * EXCLUDE (x), sqrt(x) AS x FROM smoothed)"
_SQUARED = "squared AS (SELECT * EXCLUDE (x), x * x AS x FROM enveloped), " + _smooth("smoothed", "squared", "session_id channel_id", SIGMA, extra="speed") + ", trace AS (SELECT session_id, sample_idx, t, any_value(speed) AS speed, avg(sqrt(x)) AS x FROM smoothed GROUP BY session_id, sample_idx, t)"
_CHANNELS = _smooth("smoothed", "enveloped", "session_id channel_id", SIGMA, extra="speed")
_RATE = f"counts AS (SELECT p.session_id, p.sample_idx, p.t, p.speed, coalesce(n, 0) * {FS} AS x FROM position p LEFT JOIN (SELECT session_id, sample_idx, count(*) AS n FROM samples WHERE x > 80 GROUP BY ALL) USING (session_id, sample_idx)), " + _smooth("trace", "counts", "session_id", SIGMA, extra="speed")
_CLICK = "click AS (SELECT session_id, sample_idx, t, x FROM samples WHERE channel_id = 'click'), " + _smooth("smooth", "click", "session_id", 0.001) + ", trace AS (SELECT s.*, p.speed FROM smooth s LEFT JOIN position p USING (session_id, sample_idx))"


def _z(keys: str = "session_id", source: str = "trace", name: str = "scored") -> str:
    w = f"(PARTITION BY {', '.join(keys.split())})"
    return f"{name} AS (SELECT *, CASE WHEN max(x) OVER {w} > min(x) OVER {w} THEN (x - avg(x) OVER {w}) / stddev_pop(x) OVER {w} END AS z FROM {source})"


def _found(threshold: str, minimum: float, keys: str = "session_id", source: str = "scored") -> str:
    k = ", ".join(keys.split())
    w = f"(PARTITION BY {k} ORDER BY sample_idx)"
    return f"""r1 AS (SELECT *, coalesce(z >= 0, false) AS a, coalesce(z >= {threshold}, false) AS b FROM {source}),
r2 AS (SELECT *, CASE WHEN a AND NOT coalesce(lag(a) OVER {w}, false) THEN 1 ELSE 0 END AS sa, CASE WHEN b AND NOT coalesce(lag(b) OVER {w}, false) THEN 1 ELSE 0 END AS sb FROM r1),
r3 AS (SELECT *, sum(sa) OVER {w} AS ra, sum(sb) OVER {w} AS rb FROM r2),
parts AS (SELECT {k}, ra FROM r3 WHERE b GROUP BY {k}, ra, rb HAVING max(t) >= min(t) + {minimum}),
runs AS (SELECT {k}, ra, min(t) AS start_time, max(t) AS end_time, min(sample_idx) AS start_idx, max(sample_idx) AS end_idx FROM r3 WHERE a GROUP BY {k}, ra HAVING max(t) >= min(t) + {minimum}),
found AS (SELECT {k}, start_time, end_time, start_idx, end_idx FROM runs SEMI JOIN parts USING ({k}, ra))"""


def _excluded(source: str = "scored") -> str:
    return f"""still AS (SELECT f.* FROM found f JOIN {source} a ON a.session_id = f.session_id AND a.sample_idx = f.start_idx AND a.speed <= {SPEED} JOIN {source} b ON b.session_id = f.session_id AND b.sample_idx = f.end_idx AND b.speed <= {SPEED}),
kept AS (SELECT * EXCLUDE (before) FROM (SELECT *, lag(end_time) OVER (PARTITION BY session_id ORDER BY start_time) AS before FROM still) WHERE before IS NULL OR start_time - before >= {GAP})"""


def _stats(events: str, source: str, minimum: float) -> str:
    k = "PARTITION BY session_id, event_number"
    return f"""numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY start_time, end_time) AS INTEGER) AS event_number FROM {events}),
inside AS (SELECT e.session_id, e.event_number, s.sample_idx, s.t, s.z, s.speed FROM numbered e JOIN {source} s ON s.session_id = e.session_id AND s.sample_idx BETWEEN e.start_idx AND e.end_idx),
lagged AS (SELECT *, lag(z) OVER ({k} ORDER BY sample_idx) AS pz, lag(t) OVER ({k} ORDER BY sample_idx) AS pt FROM inside),
measured AS (SELECT session_id, event_number, min(t) AS start_time, max(t) AS end_time, max(t) - min(t) AS duration, avg(z) AS mean_zscore, quantile_cont(z, 0.5) AS median_zscore, max(z) AS max_zscore, min(z) AS min_zscore,
    coalesce(sum((z + pz) / 2 * (t - pt)), 0) AS area, coalesce(sum((z * z + pz * pz) / 2 * (t - pt)), 0) AS total_energy, arg_min_null(speed, sample_idx) AS speed_at_start, arg_max_null(speed, sample_idx) AS speed_at_end,
    max(speed) AS max_speed, min(speed) AS min_speed, quantile_cont(speed, 0.5) AS median_speed, avg(speed) AS mean_speed FROM lagged GROUP BY ALL),
peaks AS (SELECT *, first_value(sample_idx) OVER ({k} ORDER BY z DESC, sample_idx) AS p FROM inside WHERE z IS NOT NULL),
lows AS (SELECT *, sign(sample_idx - p) AS side, min(z) OVER (PARTITION BY session_id, event_number, sign(sample_idx - p) ORDER BY abs(sample_idx - p)) AS low FROM peaks),
steps AS (SELECT *, row_number() OVER ({k} ORDER BY side <> 0, low DESC, side, abs(sample_idx - p)) AS n FROM lows),
wide AS (SELECT a.session_id, a.event_number, a.n, max(b.t) - min(b.t) AS span, arg_min(b.z, b.sample_idx) AS l, arg_max(b.z, b.sample_idx) AS r FROM steps a JOIN steps b ON a.session_id = b.session_id AND a.event_number = b.event_number AND b.n <= a.n GROUP BY ALL),
levels AS (SELECT session_id, event_number, arg_min(least(l, r), n) AS max_thresh FROM wide WHERE span >= {minimum} GROUP BY ALL),
event_stats AS (SELECT m.*, max_thresh FROM measured m LEFT JOIN levels USING (session_id, event_number))"""


_STAT = " ".join(stats.COLUMNS)


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join((_BASE, *parts[:-1])) + "\n" + parts[-1]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(sql: str | None = None, name: str | None = None):
    def put(function):
        QUERIES[name or function.__name__] = function
        if sql is not None:
            ORACLE_SQL[name or function.__name__] = sql
        return function

    return put


# ---- sources and checks --------------------------------------------------------------------------


@_register(_with(_r("t x", "samples", 6, "session_id, channel_id, sample_idx")))
def sample_grid(spark, sf_dir):
    return _rounded(samples(spark, sf_dir), 6).select("session_id", "channel_id", "sample_idx", "t", "x")


@_register("SELECT i AS sample_idx, round(i / 1500.0, 9) AS t FROM range(4500) r(i)")
def time_source(spark, sf_dir):
    return tables.time_grid(spark, 4500, FS).select("sample_idx", F.round("t", 9).alias("t"))


@_register("SELECT CAST(vec_id AS VARCHAR) AS session_id, CAST(i - 1 AS INTEGER) AS channel_id, round(CAST(e[i] AS DOUBLE), 6) + 0.0 AS x FROM (SELECT vec_id AS vec_id, embedding AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def wide_arrays(spark, sf_dir):
    wide = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = wide.select(F.col(wide.columns[0]).cast("string").alias("session_id"), F.lit(0).cast("long").alias("sample_idx"), F.lit(0.0).alias("t"), "embedding")
    return _rounded(tables.wide_to_samples(rows, "embedding").select("session_id", "channel_id", "x"), 6)


@_register("SELECT '0' AS session_id, CAST(c AS INTEGER) AS channel_id, i AS sample_idx, round(i / 1500.0, 9) AS t, CASE WHEN i % 7 <> c THEN i * 0.5 - c END AS x FROM range(300) r(i), range(3) q(c)")
def npy_source(spark, sf_dir):
    """A matrix of 300 instants and three channels with missing values, saved and loaded on the driver."""
    i, c = np.arange(300)[:, None], np.arange(3)[None, :]
    with tempfile.TemporaryDirectory() as folder:
        np.save(f"{folder}/x.npy", np.where(i % 7 != c, i * 0.5 - c, np.nan))
        return _rounded(tables.load_npy(spark, f"{folder}/x.npy", FS), 9)


def _outcome(check) -> str:
    """What a check does: error, warning or nothing."""
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        try:
            check()
        except ValueError:
            return "error"
    return "warning" if any(w.category is UserWarning for w in told) else "passes"


_OUTCOMES = {
    "dimensions": "passes", "dimensions_no_channel": "error", "dimensions_not_numeric": "error", "position_no_speed": "error", "lengths_equal": "passes", "lengths_differ": "error",
    "time_seconds": "passes", "time_milliseconds": "error", "time_other_frequency": "warning", "speed_centimetres": "passes", "speed_metres": "warning", "kernel_1500": "passes",
    "kernel_1300": "warning", "kernel_1000": "error", "kernel_not_told": "passes", "session_long": "passes", "session_short": "error", "arguments": "passes", "arguments_both": "error",
    "arguments_no_time": "error", "arguments_unknown": "error", "baseline": "passes", "baseline_empty": "error",
}


@_register("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{o}')" for n, o in _OUTCOMES.items()) + ") v(name, outcome)")
def input_checks(spark, sf_dir):
    """What each check of inputs says to tables that are right and to others that are not."""
    own, where = samples(spark, sf_dir), position(spark, sf_dir)
    view = own.where("channel_id = 'view'")
    slow = where.withColumn("speed", F.col("speed") / 1000)
    checks = {
        "dimensions": lambda: validate.check_samples(own), "dimensions_no_channel": lambda: validate.check_samples(own.drop("channel_id")),
        "dimensions_not_numeric": lambda: validate.check_samples(own.withColumn("x", F.array("x"))), "position_no_speed": lambda: validate.check_position(where.drop("speed")),
        "lengths_equal": lambda: validate.check_aligned(view, where), "lengths_differ": lambda: validate.check_aligned(view.where("sample_idx > 0"), where),
        "time_seconds": lambda: validate.check_time_units(own, FS), "time_milliseconds": lambda: validate.check_time_units(own.withColumn("t", F.col("t") * 1000), FS),
        "time_other_frequency": lambda: validate.check_time_units(own, 1000.0), "speed_centimetres": lambda: validate.check_speed_units(where, SPEED), "speed_metres": lambda: validate.check_speed_units(slow, SPEED),
        "kernel_1500": lambda: signals.check_sampling(1500.0), "kernel_1300": lambda: signals.check_sampling(1300.0), "kernel_1000": lambda: signals.check_sampling(1000.0), "kernel_not_told": lambda: signals.check_sampling(None),
        "session_long": lambda: validate.check_lengths(view, 5), "session_short": lambda: validate.check_lengths(view, 10**6), "arguments": lambda: norm.check_arguments("median_mad", "mask"),
        "arguments_both": lambda: norm.check_arguments("zscore", "mask", (0, 1)), "arguments_no_time": lambda: norm.check_arguments("zscore", None, (0, 1), has_time=False), "arguments_unknown": lambda: norm.check_arguments("other"),
        "baseline": lambda: validate.check_baseline(where, norm.baseline(None, (0.0, 0.01))), "baseline_empty": lambda: validate.check_baseline(where, norm.baseline(None, (-2.0, -1.0))),
    }
    return spark.createDataFrame([(n, _outcome(c)) for n, c in checks.items()], "name string, outcome string")


@_register(_with("steps AS (SELECT session_id, t - lag(t) OVER (PARTITION BY session_id ORDER BY sample_idx) AS d FROM (SELECT DISTINCT session_id, sample_idx, t FROM samples))", "SELECT session_id, round(quantile_cont(d, 0.5), 9) AS median_step FROM steps GROUP BY session_id"))
def time_step_median(spark, sf_dir):
    return validate.time_steps(samples(spark, sf_dir)).select("session_id", F.round("median_step", 9).alias("median_step"))


@_register(_with("SELECT session_id, round(quantile_cont(speed, 0.5), 9) AS median_speed FROM position WHERE speed > 0 GROUP BY session_id"))
def speed_median(spark, sf_dir):
    return _rounded(validate.speed_medians(position(spark, sf_dir)), 6)


@_register(_with(_r("x speed", "complete", 6, "session_id, channel_id, sample_idx, sample_idx AS dense_idx")))
def drop_incomplete_rows(spark, sf_dir):
    return _rounded(_complete(spark, sf_dir), 6).select("session_id", "channel_id", "sample_idx", "dense_idx", "x", "speed")


# ---- transforms ------------------------------------------------------------------------------------


@_register(_with(_smooth("smooth", "samples", "session_id channel_id", SIGMA), _r("x", "smooth", 5, "session_id, channel_id, sample_idx")))
def gaussian_smooth(spark, sf_dir):
    return _rounded(signals.gaussian_smooth(samples(spark, sf_dir), SIGMA, FS)).select("session_id", "channel_id", "sample_idx", "x")


@_register(_with(_RATE, _r("x", "trace", 4, "session_id, sample_idx")))
def population_rate(spark, sf_dir):
    return _rounded(signals.population_rate(spikes(spark, sf_dir), position(spark, sf_dir), FS, SIGMA), 4).select("session_id", "sample_idx", "x")


def _band(taps: np.ndarray, source: str, name: str = "filtered") -> str:
    """Rows of `source` (session_id, channel_id, sample_idx from 0, t, x) filtered forward and backward, reflected oddly at both ends."""
    pad, both = 3 * len(taps), [float(w) for w in np.convolve(taps, taps[::-1])]
    on = "f.session_id = c.session_id AND f.channel_id = c.channel_id"
    return f"""n AS (SELECT session_id, channel_id, max(sample_idx) AS last FROM {source} GROUP BY ALL),
    padded AS (SELECT session_id, channel_id, sample_idx, x FROM {source} UNION ALL
        SELECT c.session_id, c.channel_id, -c.sample_idx, 2 * f.x - c.x FROM {source} c JOIN {source} f ON {on} AND f.sample_idx = 0 WHERE c.sample_idx BETWEEN 1 AND {pad} UNION ALL
        SELECT c.session_id, c.channel_id, 2 * last - c.sample_idx, 2 * f.x - c.x FROM {source} c JOIN n USING (session_id, channel_id) JOIN {source} f ON {on} AND f.sample_idx = last WHERE c.sample_idx BETWEEN last - {pad} AND last - 1),
    kernel AS (SELECT unnest(range({-len(taps) + 1}, {len(taps)})) AS o, unnest({both}) AS w),
    {name} AS (SELECT c.session_id, c.channel_id, c.sample_idx, any_value(c.t) AS t, sum(p.x * w) AS x FROM {source} c JOIN kernel ON true JOIN padded p ON p.session_id = c.session_id AND p.channel_id = c.channel_id AND p.sample_idx = c.sample_idx + o GROUP BY ALL)"""


@_register(_with(_band(SHORT_TAPS, "complete"), _r("x", "filtered", 5, "session_id, channel_id, sample_idx")))
def band_pass(spark, sf_dir):
    complete = _complete(spark, sf_dir).select("session_id", "channel_id", "sample_idx", "t", "x")
    return _rounded(signals.band_pass(complete, SHORT_TAPS, checked=False)).select("session_id", "channel_id", "sample_idx", "x")


@_register(_with(_band(SHORT_TAPS, "complete"), _r("x", "filtered", 5, "session_id, channel_id, sample_idx")))
def band_pass_blocks(spark, sf_dir):
    """The same in blocks of 64 samples."""
    complete = _complete(spark, sf_dir).select("session_id", "channel_id", "sample_idx", "t", "x")
    return _rounded(signals.band_pass(complete, SHORT_TAPS, checked=False, block=64)).select("session_id", "channel_id", "sample_idx", "x")


@_register(_with(_smooth("smooth", "samples", "session_id channel_id", SIGMA), _r("x", "smooth", 5, "session_id, channel_id, sample_idx")))
def smooth_blocks(spark, sf_dir):
    return _rounded(signals.gaussian_smooth(samples(spark, sf_dir), SIGMA, FS, block=64)).select("session_id", "channel_id", "sample_idx", "x")


def _responses(spark, taps, edge: int, within: float) -> DataFrame:
    """Whether a kernel passes or stops each frequency in steps of 5 Hz that is not within `edge` Hz beside the band."""
    parts = spark.createDataFrame([(i, float(w)) for i, w in enumerate(taps)], "i int, w double")
    angle = F.lit(2 * np.pi / FS) * F.col("frequency") * F.col("i")
    asked = spark.range(0, 751, 5).withColumnRenamed("id", "frequency").where(f"frequency between 150 and 250 or frequency <= {150 - edge} or frequency >= {250 + edge}")
    sums = asked.crossJoin(F.broadcast(parts)).groupBy("frequency").agg(F.sum(F.col("w") * F.cos(angle)).alias("a"), F.sum(F.col("w") * F.sin(angle)).alias("b"))
    gain = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    return sums.select("frequency", F.when(F.abs(gain - 1) < within, "pass").when(gain < within, "stop").otherwise("neither").alias("band"))


def _bands(edge: int) -> str:
    return f"SELECT f AS frequency, CASE WHEN f BETWEEN 150 AND 250 THEN 'pass' ELSE 'stop' END AS band FROM range(0, 751, 5) r(f) WHERE f BETWEEN 150 AND 250 OR f <= {150 - edge} OR f >= {250 + edge}"


@_register(_bands(10))
def packaged_kernel(spark, sf_dir):
    return _responses(spark, kernels.packaged_kernel(), 10, 0.02)


@_register(_bands(25))
def bandpass_taps(spark, sf_dir):
    return _responses(spark, kernels.bandpass_taps(FS), 25, 0.1)


@_register(_with(_ENVELOPE, _r("x", "enveloped", 5, "session_id, channel_id, sample_idx")))
def envelope(spark, sf_dir):
    return _rounded(signals.envelope(_complete(spark, sf_dir), order="dense_idx")).select("session_id", "channel_id", "sample_idx", "x")


@_register(_with(_ENVELOPE, _CONSENSUS.format(source="enveloped"), _r("x", "trace", 5, "session_id, sample_idx")))
def consensus_trace(spark, sf_dir):
    return _rounded(signals.consensus_trace(_complete(spark, sf_dir), FS, SIGMA)).select("session_id", "sample_idx", "x")


@_register(_with(_CONSENSUS.format(source="complete"), _r("x", "trace", 5, "session_id, sample_idx")))
def consensus_no_envelope(spark, sf_dir):
    return _rounded(signals.consensus_trace(_complete(spark, sf_dir), FS, SIGMA, enveloped=False)).select("session_id", "sample_idx", "x")


@_register(_with(_ENVELOPE, _SQUARED, _r("x", "trace", 5, "session_id, sample_idx")))
def mean_envelope_trace(spark, sf_dir):
    return _rounded(signals.mean_envelope_trace(_complete(spark, sf_dir), FS, SIGMA)).select("session_id", "sample_idx", "x")


@_register(_with(_ENVELOPE, _CHANNELS, _r("x", "smoothed", 5, "session_id, channel_id, sample_idx")))
def channel_envelopes(spark, sf_dir):
    return _rounded(signals.channel_envelopes(_complete(spark, sf_dir), FS, SIGMA)).select("session_id", "channel_id", "sample_idx", "x")


# ---- scores ------------------------------------------------------------------------------------------


def _score_query(name: str, sql: str, **options):
    keys = options.pop("keys", ("session_id", "channel_id"))

    @_register(_with(sql, _r("z", "scored", 5, "session_id, channel_id, sample_idx")), name)
    def query(spark, sf_dir):
        scored = norm.normalize(samples(spark, sf_dir), keys=keys, **options)
        return _rounded(scored.select("session_id", "channel_id", "sample_idx", "z"))


def _subset(condition: str, keys: str = "session_id, channel_id") -> str:
    f = f"FILTER (WHERE {condition}) OVER (PARTITION BY {keys})"
    return f"scored AS (SELECT *, (x - avg(x) {f}) / stddev_pop(x) {f} AS z FROM samples)"


def _mad(keys: str, condition: str = "true") -> str:
    return f"""m AS (SELECT {keys}, quantile_cont(x, 0.5) FILTER (WHERE {condition}) AS c FROM samples GROUP BY {keys}),
d AS (SELECT {keys}, any_value(c) AS c, quantile_cont(abs(x - c), 0.5) FILTER (WHERE {condition}) / 0.6744897501960817 AS s FROM samples JOIN m USING ({keys}) GROUP BY {keys}),
scored AS (SELECT samples.*, (x - c) / s AS z FROM samples JOIN d USING ({keys}))"""


_BOTH = "session_id, channel_id"
_score_query("zscore_by_channel", _z("session_id channel_id", "samples"))
_score_query("zscore_by_session", _z("session_id", "samples"), keys=("session_id",))


@_register(_with(_subset("x < 50"), _r("z", "scored", 5, "session_id, channel_id, sample_idx")))
def zscore_masked(spark, sf_dir):
    masked = samples(spark, sf_dir).withColumn("low", F.col("x") < 50)
    return _rounded(norm.normalize(masked, mask="low", keys=signals.CHANNEL, per_channel=True).select("session_id", "channel_id", "sample_idx", "z"))


_score_query("zscore_time_range", _subset("t BETWEEN 0.0 AND 0.02", "session_id"), keys=("session_id",), time_range=(0.0, 0.02))
_score_query("median_mad_by_channel", _mad(_BOTH), method="median_mad", per_channel=True)
_score_query("median_mad_by_session", _mad("session_id"), method="median_mad", keys=("session_id",))
_score_query("median_mad_time_range", _mad(_BOTH, "t BETWEEN 0.0 AND 0.02"), method="median_mad", per_channel=True, time_range=(0.0, 0.02))


# ---- segments and intervals ----------------------------------------------------------------------------

_HIGH = "SELECT *, coalesce(x >= 40, false) AS a FROM samples"
_RUNS = f"""flags AS (SELECT *, a AND NOT coalesce(lag(a) OVER w, false) AS s, a AND NOT coalesce(lead(a) OVER w, false) AS e FROM ({_HIGH}) WINDOW w AS (PARTITION BY session_id, channel_id ORDER BY sample_idx)),
numbered_runs AS (SELECT *, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, channel_id ORDER BY sample_idx) AS run FROM flags)"""
_PLACES = "start_idx, end_idx"


@_register(_with(_RUNS, "SELECT session_id, channel_id, sample_idx, s AS run_start, e AS run_end FROM flags WHERE s OR e"))
def run_boundaries(spark, sf_dir):
    rows = seg.run_boundaries(samples(spark, sf_dir), F.col("x") >= 40, signals.CHANNEL)
    return rows.where("run_start or run_end").select("session_id", "channel_id", "sample_idx", "run_start", "run_end")


@_register(_with(_RUNS, f"""SELECT session_id, channel_id, round(min(t), 9) AS start_time, round(max(t), 9) AS end_time, min(sample_idx) AS start_idx, max(sample_idx) AS end_idx
    FROM numbered_runs WHERE a GROUP BY session_id, channel_id, run HAVING max(t) >= min(t) + {SHORT}"""))
def boolean_segments(spark, sf_dir):
    return _rounded(seg.segments(samples(spark, sf_dir), F.col("x") >= 40, SHORT, signals.CHANNEL), 9)


@_register(_with(_CLICK, _z(), _found(str(THRESHOLD), SHORT), _r("start_time end_time", "found", 9, f"session_id, {_PLACES}")))
def extend_to_mean(spark, sf_dir):
    return _rounded(_candidates(spark, sf_dir), 9).select("session_id", "start_idx", "end_idx", "start_time", "end_time")


def _interval_pairs(spark, sf_dir):
    base = samples(spark, sf_dir)
    return seg.segments(base, F.col("x") >= 20, 0.0, signals.CHANNEL), seg.segments(base, F.col("x") >= 60, 0.0, signals.CHANNEL)


_PAIRS = ", ".join(
    f"""f{x} AS (SELECT *, x >= {x} AND NOT coalesce(lag(x >= {x}) OVER (PARTITION BY session_id, channel_id ORDER BY sample_idx), false) AS s FROM samples),
g{x} AS (SELECT *, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, channel_id ORDER BY sample_idx) AS run FROM f{x}),
i{x} AS (SELECT session_id, channel_id, min(t) AS start_time, max(t) AS end_time FROM g{x} WHERE x >= {x} GROUP BY session_id, channel_id, run)"""
    for x in (20, 60)
)
_ASOF = "held AS (SELECT a.session_id, a.channel_id, a.start_time AS target_start, a.end_time AS target_end, b.start_time, b.end_time FROM i60 a ASOF LEFT JOIN i20 b ON a.session_id = b.session_id AND a.channel_id = b.channel_id AND a.start_time >= b.start_time)"


@_register(_with(_PAIRS, _ASOF, _r("target_start target_end start_time end_time", "held", 9, _BOTH)))
def containing_interval(spark, sf_dir):
    return _rounded(seg.containing_interval(*_interval_pairs(spark, sf_dir), signals.CHANNEL), 9)


@_register(_with(_PAIRS, _ASOF, "SELECT DISTINCT session_id, channel_id, round(start_time, 9) AS start_time, round(end_time, 9) AS end_time FROM held"))
def extend_segments(spark, sf_dir):
    wide, narrow = _interval_pairs(spark, sf_dir)
    return _rounded(seg.extend_segments(narrow, wide, signals.CHANNEL), 9)


@_register("""WITH r AS (SELECT user_id AS session_id, epoch_us(ts) / 1e6 AS start_time, epoch_us(ts) / 1e6 + 60 * value AS end_time FROM events),
    m AS (SELECT *, max(end_time) OVER (PARTITION BY session_id ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_time > reach THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start_time, end_time ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT session_id, round(min(start_time), 6) AS start_time, round(max(end_time), 6) AS end_time FROM i GROUP BY session_id, island""")
def merge_ranges(spark, sf_dir):
    return _rounded(seg.merge_overlapping(_ranges(spark, sf_dir)), 6)


@_register(_with(_CLICK, _z(), _found(str(THRESHOLD), SHORT), _excluded(), _r("start_time end_time", "still", 9, f"session_id, {_PLACES}")))
def exclude_movement(spark, sf_dir):
    return _rounded(seg.exclude_movement(_candidates(spark, sf_dir), position(spark, sf_dir), SPEED), 9).select("session_id", "start_idx", "end_idx", "start_time", "end_time")


@_register(_with(_CLICK, _z(), _found(str(THRESHOLD), SHORT), "still AS (SELECT * FROM found)", f"kept AS (SELECT * FROM (SELECT *, lag(end_time) OVER (PARTITION BY session_id ORDER BY start_time) AS before FROM still) WHERE before IS NULL OR start_time - before >= {GAP})", _r("start_time end_time", "kept", 9, f"session_id, {_PLACES}")))
def exclude_close(spark, sf_dir):
    return _rounded(seg.exclude_close(_candidates(spark, sf_dir), GAP), 9).select("session_id", "start_idx", "end_idx", "start_time", "end_time")


# ---- statistics, detectors, flows ----------------------------------------------------------------------


@_register(_with(_CLICK, _z(), _found(str(THRESHOLD), SHORT), _stats("found", "scored", SHORT), _r(_STAT, "event_stats", 5, "session_id, event_number")))
def event_statistics(spark, sf_dir):
    return _rounded(stats.event_stats(_candidates(spark, sf_dir), _scored(spark, sf_dir), SHORT))


@_register(_with(_CLICK, _z(), _found(str(THRESHOLD), SHORT), _stats("found", "scored", 0.004), _r("max_thresh", "event_stats", 5, "session_id, event_number")))
def max_threshold(spark, sf_dir):
    found = stats.event_stats(_candidates(spark, sf_dir), _scored(spark, sf_dir), 0.004)
    return _rounded(found.select("session_id", "event_number", "max_thresh"))


# Channels of these sessions differ in length, which the checks would not let pass.
_LIMITS = {"checked": False, "speed_threshold": SPEED, "minimum_duration": SHORT, "zscore_threshold": THRESHOLD, "smoothing_sigma": SIGMA, "close_event_threshold": GAP}
_EVENT = _r(_STAT, "event_stats", 5, "session_id, event_number")
_TAIL = (_z(), _found(str(THRESHOLD), SHORT), _excluded())


def _synchrony(spark, sf_dir):
    return detectors.synchrony_detector(spikes(spark, sf_dir), position(spark, sf_dir), FS, **_LIMITS)


@_register(_with(_RATE, *_TAIL, _stats("kept", "scored", 0.015), _EVENT))
def synchrony_events(spark, sf_dir):
    return _rounded(_synchrony(spark, sf_dir))


def _z_picked(condition: str, keys: str = "session_id", source: str = "trace") -> str:
    f = f"FILTER (WHERE {condition}) OVER (PARTITION BY {', '.join(keys.split())})"
    return f"scored AS (SELECT *, (x - avg(x) {f}) / stddev_pop(x) {f} AS z FROM {source})"


def _z_mad(keys: str = "session_id", source: str = "trace", condition: str = "true") -> str:
    k = ", ".join(keys.split())
    return f"""mid AS (SELECT {k}, quantile_cont(x, 0.5) FILTER (WHERE {condition}) AS c FROM {source} GROUP BY {k}),
apart AS (SELECT {k}, any_value(c) AS c, quantile_cont(abs(x - c), 0.5) FILTER (WHERE {condition}) / 0.6744897501960817 AS s FROM {source} JOIN mid USING ({k}) GROUP BY {k}),
scored AS (SELECT {source}.*, (x - c) / s AS z FROM {source} JOIN apart USING ({k}))"""


_FOUND = (_found(str(THRESHOLD), SHORT), _excluded())


@_register(_with(_ENVELOPE, _CONSENSUS.format(source="enveloped"), _z_picked("speed < 4"), *_FOUND, _stats("kept", "scored", SHORT), _EVENT))
def consensus_events_masked(spark, sf_dir):
    """On the baseline of slow samples."""
    still = flows.immobile(position(spark, sf_dir))
    return _rounded(detectors.consensus_detector(samples(spark, sf_dir), still, FS, normalization_mask="immobile", **_LIMITS))


@_register(_with(_ENVELOPE, _SQUARED, _z_picked("t BETWEEN 0.0 AND 0.1"), *_FOUND, _stats("kept", "scored", SHORT), _EVENT))
def mean_envelope_events_time_range(spark, sf_dir):
    return _rounded(detectors.mean_envelope_detector(samples(spark, sf_dir), position(spark, sf_dir), FS, normalization_time_range=(0.0, 0.1), **_LIMITS))


@_register(_with(_RATE, _z_mad(), *_FOUND, _stats("kept", "scored", 0.015), _EVENT))
def synchrony_events_median_mad(spark, sf_dir):
    return _rounded(detectors.synchrony_detector(spikes(spark, sf_dir), position(spark, sf_dir), FS, normalization_method="median_mad", **_LIMITS))


@_register(_with(_RATE, _z_picked(f"coalesce(speed < {SPEED}, false)"), *_FOUND, _stats("kept", "scored", 0.015), _EVENT))
def synchrony_events_slow(spark, sf_dir):
    """By the deprecated argument, which is a mask of slow samples."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)
        return _rounded(detectors.synchrony_detector(spikes(spark, sf_dir), position(spark, sf_dir), FS, use_speed_threshold_for_zscore=True, **_LIMITS))


@_register(_with(_ENVELOPE, _CONSENSUS.format(source="enveloped"), *_TAIL, _stats("kept", "scored", SHORT), _EVENT))
def consensus_events(spark, sf_dir):
    return _rounded(detectors.consensus_detector(samples(spark, sf_dir), position(spark, sf_dir), FS, **_LIMITS))


@_register(_with(_CONSENSUS.format(source="complete"), *_TAIL, _stats("kept", "scored", SHORT), _EVENT))
def consensus_events_no_envelope(spark, sf_dir):
    return _rounded(detectors.consensus_detector(samples(spark, sf_dir), position(spark, sf_dir), FS, enveloped=False, **_LIMITS))


@_register(_with(_ENVELOPE, _SQUARED, *_TAIL, _stats("kept", "scored", SHORT), _EVENT))
def mean_envelope_events(spark, sf_dir):
    return _rounded(detectors.mean_envelope_detector(samples(spark, sf_dir), position(spark, sf_dir), FS, **_LIMITS))


_MERGED = """islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_time > reach THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start_time, end_time ROWS UNBOUNDED PRECEDING) AS island
    FROM (SELECT *, max(end_time) OVER (PARTITION BY session_id ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM channel_found)),
found AS (SELECT session_id, min(start_time) AS start_time, max(end_time) AS end_time, min(start_idx) AS start_idx, max(end_idx) AS end_idx FROM islands GROUP BY session_id, island),
mean AS (SELECT session_id, sample_idx, t, any_value(speed) AS speed, avg(z) AS z FROM scored GROUP BY session_id, sample_idx, t)"""


@_register(_with(_ENVELOPE, _CHANNELS, _z("session_id channel_id", "smoothed"), _found("2.0", SHORT, "session_id channel_id").replace("found AS", "channel_found AS"), _MERGED, _excluded("mean"), _stats("kept", "mean", 0.015), _EVENT))
def channel_events(spark, sf_dir):
    return _rounded(detectors.channel_detector(samples(spark, sf_dir), position(spark, sf_dir), FS, **_LIMITS | {"zscore_threshold": 2.0}))


@_register(_with(_ENVELOPE, _CHANNELS, _z_mad("session_id channel_id", "smoothed"), _found("2.0", SHORT, "session_id channel_id").replace("found AS", "channel_found AS"), _MERGED, _excluded("mean"), _stats("kept", "mean", 0.015), _EVENT))
def channel_events_median_mad(spark, sf_dir):
    return _rounded(detectors.channel_detector(samples(spark, sf_dir), position(spark, sf_dir), FS, normalization_method="median_mad", **_LIMITS | {"zscore_threshold": 2.0}))


@_register(_with(_RATE, *_TAIL, _stats("kept", "scored", 0.015), "SELECT count(*) AS n_events, round(avg(duration), 6) AS mean_duration, round(stddev_samp(duration), 6) AS std_duration, round(avg(mean_zscore), 6) AS mean_zscore, round(max(max_zscore), 6) AS max_zscore, round(min(max_thresh), 6) AS min_max_thresh, round(avg(mean_speed), 9) AS mean_speed FROM event_stats"))
def event_summary(spark, sf_dir):
    return _rounded(flows.summarise(_synchrony(spark, sf_dir)), 6)


@_register(
    _with(
        _CONSENSUS.format(source="complete"), *_TAIL, _stats("kept", "scored", SHORT),
        "SELECT 'consensus' AS detector, count(*) AS n_events, round(avg(duration) * 1000, 5) AS mean_duration_ms, round(avg(mean_zscore), 5) AS mean_zscore FROM event_stats UNION ALL SELECT * FROM (" + _with(_RATE, *_TAIL, _stats("kept", "scored", 0.015), "SELECT 'synchrony' AS detector, count(*) AS n_events, round(avg(duration) * 1000, 5) AS mean_duration_ms, round(avg(mean_zscore), 5) AS mean_zscore FROM event_stats") + ")",
    )
)
def detector_comparison(spark, sf_dir):
    consensus = detectors.consensus_detector(samples(spark, sf_dir), position(spark, sf_dir), FS, enveloped=False, **_LIMITS)
    return _rounded(flows.compare({"consensus": consensus, "synchrony": _synchrony(spark, sf_dir)}))


@_register(_with(_CLICK, _z(), "swept AS (SELECT scored.*, CAST(l AS DOUBLE) AS level FROM scored, (SELECT unnest([0.5, 1.0, 1.5, 2.0]) AS l))", _found("level", SHORT, "session_id level", "swept"), "SELECT CAST(l AS DOUBLE) AS threshold, count(found.level) AS n_events FROM (SELECT unnest([0.5, 1.0, 1.5, 2.0]) AS l) LEFT JOIN found ON level = l GROUP BY l"))
def threshold_sweep(spark, sf_dir):
    return flows.sweep(_scored(spark, sf_dir), LEVELS, SHORT)


@_register(_with(_CLICK, _z(), _found(str(THRESHOLD), SHORT), "truth AS (SELECT session_id, t AS time FROM samples WHERE channel_id = 'error' AND x > 200)", """SELECT session_id, n_true, n_found, n_events, n_false FROM
    (SELECT session_id, count(*) AS n_true, count_if(EXISTS (SELECT 1 FROM found f WHERE f.session_id = truth.session_id AND abs(f.start_time - time) < 0.005)) AS n_found FROM truth GROUP BY session_id) FULL JOIN
    (SELECT session_id, count(*) AS n_events, count_if(NOT EXISTS (SELECT 1 FROM truth t WHERE t.session_id = found.session_id AND abs(found.start_time - time) < 0.005)) AS n_false FROM found GROUP BY session_id) USING (session_id)""").replace("SELECT session_id, n_true, n_found, n_events, n_false FROM", "SELECT session_id, CAST(coalesce(n_true, 0) AS BIGINT) AS n_true, CAST(coalesce(n_found, 0) AS BIGINT) AS n_found, CAST(coalesce(n_events, 0) AS BIGINT) AS n_events, CAST(coalesce(n_false, 0) AS BIGINT) AS n_false FROM"))
def score_detections(spark, sf_dir):
    truth = samples(spark, sf_dir).where("channel_id = 'error' and x > 200").select("session_id", F.col("t").alias("time"))
    return flows.score_detections(_candidates(spark, sf_dir), truth, 0.005)


@_register(_with(_RATE, "marked AS (SELECT *, coalesce(speed < 4, false) AS m FROM trace)", "scored AS (SELECT *, (x - avg(x) FILTER (WHERE m) OVER w) / stddev_pop(x) FILTER (WHERE m) OVER w AS z FROM marked WINDOW w AS (PARTITION BY session_id))", _r("z", "scored", 5, "session_id, sample_idx")))
def immobility_baseline(spark, sf_dir):
    still = flows.immobile(position(spark, sf_dir))
    rate = signals.population_rate(spikes(spark, sf_dir), still, FS, SIGMA)
    return _rounded(norm.normalize(rate, mask="immobile").select("session_id", "sample_idx", "z"))


# ---- simulation ------------------------------------------------------------------------------------------


def _curve(i: int, c: float) -> str:
    return f"exp(-0.5 * pow((t - {c}) / (0.1 / 6), 2)) / max(exp(-0.5 * pow((t - {c}) / (0.1 / 6), 2))) OVER ()"


@_register("WITH g AS (SELECT i AS sample_idx, i / 1500.0 AS t FROM range(4500) r(i)) SELECT sample_idx, round(sin(2 * pi() * 200 * t) * (" + " + ".join(_curve(i, c) for i, c in enumerate((1.1, 2.1))) + "), 5) + 0.0 AS x FROM g")
def burst_waveform(spark, sf_dir):
    return _rounded(simulate.waveform(tables.time_grid(spark, 4500, FS), [1.1, 2.1]).select("sample_idx", "x"))


@_register(_with("SELECT session_id, channel_id, round(avg(x * x), 4) AS mean_square FROM samples GROUP BY ALL"))
def mean_square(spark, sf_dir):
    return _rounded(simulate.mean_squares(samples(spark, sf_dir), keys=signals.CHANNEL), 4)


@_register(_with("scaled AS (SELECT *, x / sqrt(avg(x * x) OVER (PARTITION BY session_id, channel_id)) AS y FROM samples)", "SELECT session_id, channel_id, sample_idx, round(y, 6) + 0.0 AS x FROM scaled"))
def power_normalize(spark, sf_dir):
    return _rounded(simulate.normalize_power(samples(spark, sf_dir), keys=signals.CHANNEL), 6).select("session_id", "channel_id", "sample_idx", "x")


def _burst(c: float) -> str:
    return f"exp(-0.5 * pow((t - {c}) / (0.1 / 6), 2)) / max(exp(-0.5 * pow((t - {c}) / (0.1 / 6), 2))) OVER ()"


_MADE = f"""grid AS (SELECT '0' AS session_id, 0 AS channel_id, i AS sample_idx, i / 1500.0 AS t FROM range(4500) r(i)),
made AS (SELECT *, 1.5 * sin(2 * pi() * 200 * t) * ({_burst(1.1)} + {_burst(2.1)}) + 0.4 * sin(2 * pi() * 60 * t) + 0.05 * sin(2 * pi() * 190 * t) AS x FROM grid)"""


@_register("WITH " + ",\n".join((_MADE, _band(kernels.packaged_kernel(), "made", "passed"), "complete AS (SELECT passed.*, 1.0 AS speed FROM passed)", _ENVELOPE, _CONSENSUS.format(source="enveloped"), _z(), _found("2.0", 0.015),
    "still AS (SELECT * FROM found), kept AS (SELECT * FROM still)", _stats("kept", "scored", 0.015))) + "\n" + _r(_STAT, "event_stats", 4, "session_id, event_number"))
def simulated_detection(spark, sf_dir):
    """Simulated bursts in two sines through the whole chain: band-pass by the packaged kernel, envelope, consensus, events."""
    grid = tables.time_grid(spark, 4500, FS)
    hum = F.lit(0.4) * F.sin(F.lit(2 * np.pi * 60) * F.col("t")) + F.lit(0.05) * F.sin(F.lit(2 * np.pi * 190) * F.col("t"))
    made = simulate.simulate(grid, [1.1, 2.1], 3.0, noise_amplitude=0.0, seed=1).withColumn("x", F.col("x") + hum).withColumn("channel_id", F.lit(0))
    return _rounded(flows.detect(made, grid.withColumn("speed", F.lit(1.0)), FS), 4)


@_register("WITH " + _MADE + " SELECT kind, CAST(4500 AS BIGINT) AS n, 1.0 AS mean_square, true AS falls FROM (VALUES ('pink'), ('brown')) v(kind) UNION ALL SELECT 'white', 4500, 1.0, false")
def noise_spectra(spark, sf_dir):
    """Noise of each kind: its length, its mean square (of white noise to the nearest whole number) and whether its steps are far smaller than itself."""
    grid, out = tables.time_grid(spark, 4500, FS), None
    for kind in simulate.NOISES:
        step = F.col("x") - F.lag("x").over(Window.partitionBy("session_id").orderBy("sample_idx"))
        rows = simulate.noise(grid, kind, seed=5).withColumn("step", step)
        one = rows.agg(F.count("*").alias("n"), F.avg(F.col("x") * F.col("x")).alias("power"), F.avg(F.col("step") * F.col("step")).alias("steps"))
        digits = 0 if kind == "white" else 9
        one = one.select(F.lit(kind).alias("kind"), "n", F.round("power", digits).alias("mean_square"), (F.col("steps") < F.col("power")).alias("falls"))
        out = one if out is None else out.unionByName(one)
    return out


@_register(_with(_ENVELOPE.replace("FROM complete", "FROM samples").replace("JOIN complete b", "JOIN samples b").replace("FROM samples a", "FROM samples a"), f"""hi AS (SELECT *, x >= 100 AND NOT coalesce(lag(x >= 100) OVER (PARTITION BY session_id, channel_id ORDER BY sample_idx), false) AS s FROM enveloped),
    num AS (SELECT *, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, channel_id ORDER BY sample_idx) AS run FROM hi)""", f"SELECT session_id, channel_id, round(min(t), 9) AS start_time, round(max(t), 9) AS end_time, min(sample_idx) AS start_idx, max(sample_idx) AS end_idx FROM num WHERE x >= 100 GROUP BY session_id, channel_id, run HAVING max(t) >= min(t) + {SHORT}"))
def raw_envelope_runs(spark, sf_dir):
    return _rounded(flows.raw_envelope_runs(samples(spark, sf_dir), 100.0, SHORT), 9)
