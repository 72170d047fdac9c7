import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.models import Series
from tidewatch.operators import detect
from tidewatch.operators.baseline import AlertKernel, CounterKernel, StateKernel, ewma
from tidewatch.operators.ordered import ordered_scan, ordered_segments
from tidewatch.rules import Rules
from tidewatch.schema import EVENT

WARM5 = Rules(warmup_samples=5)


def metric(i, value, name="latency_ms", source="svc", component="svc", ts=None):
    return (f"{i:06d}", i if ts is None else ts, source, (name, value, "", component, {}), None, None, None)


def log(i, severity, source="worker", message=""):
    return (f"{i:06d}", i, source, None, (severity, message, source, "", "", {}), None, None)


def found(spark, rows, rules=Rules()):
    df = spark.createDataFrame(rows, EVENT)
    return [tuple(r) for r in detect.detect_alerts(df, rules).orderBy("timestamp_ms", "rule").collect()]


NEAR_100 = [98.0, 102.0, 99.0, 101.0, 100.0, 98.0, 102.0, 100.0]


def series(values, **kw):
    return [metric(i, v, **kw) for i, v in enumerate(values)]


def test_threshold_fires_on_the_first_sample(spark):
    rows = found(spark, series([5000.0], component="kafka-consumer"))
    assert rows == [("000000", "latency_ms_threshold", "kafka-consumer", 200.0, 5000.0, 0, "CRITICAL")]


def test_threshold_is_strict_and_ignores_other_metrics(spark):
    assert found(spark, series([200.0]) + series([1e9], name="records_per_second")) == []


def test_deviation_after_warmup(spark):
    rows = found(spark, series(NEAR_100 + [199.0]), WARM5)
    assert [(r[1], r[4], r[6]) for r in rows] == [("latency_ms_baseline_deviation", 199.0, "WARNING")]
    model = Series(warmup=5)
    for v in NEAR_100:
        model.metric("latency_ms", v)
    assert rows[0][3] == pytest.approx(model.mean, rel=1e-15)


def test_no_deviation_near_the_baseline(spark):
    assert found(spark, series(NEAR_100 + [100.0]), WARM5) == []


def test_metrics_keep_their_own_baselines(spark):
    rows = []
    for i in range(8):
        rows.append(metric(2 * i, 100.0 + i % 2))
        rows.append(metric(2 * i + 1, 5000.0 + 10 * (i % 2), name="consumer_lag"))
    rows.append(metric(17, 5010.0, name="consumer_lag"))
    assert found(spark, rows, WARM5) == []


def test_value_can_raise_both_alerts(spark):
    rows = found(spark, series(NEAR_100 + [5000.0]), WARM5)
    assert sorted(r[1] for r in rows) == ["latency_ms_baseline_deviation", "latency_ms_threshold"]


def test_nan_spoils_the_baseline_but_not_the_threshold(spark):
    rows = found(spark, series(NEAR_100 + [math.nan, 5000.0]), WARM5)
    assert [r[1] for r in rows] == ["latency_ms_threshold"]


@pytest.mark.parametrize("severity", [3, 4])
def test_error_rate_from_the_eleventh_log(spark, severity):
    rows = found(spark, [log(i, severity) for i in range(12)])
    assert [(r[0], r[1], r[2], r[3], r[4], r[6]) for r in rows] == [
        (f"{i:06d}", "error_rate_high", "worker", 0.2, 1.0, "CRITICAL") for i in (10, 11)
    ]


def test_error_rate_alerts_on_good_logs_too(spark):
    rows = found(spark, [log(i, 4 if i < 5 else 2) for i in range(30)])
    assert [r[0] for r in rows] == [f"{i:06d}" for i in range(10, 24)]


def test_other_payloads_are_ignored(spark):
    alert = ("a", "CRITICAL", "r", "", "c", 1.0, 2.0, 0, 0, {})
    rows = [("1", 1, "s", None, None, alert, None), ("2", 2, "s", None, None, None, ("c", "HEALTHY", 1, {}))]
    assert found(spark, rows) == []
    keys = spark.createDataFrame(rows, EVENT).select(detect.series_key()).distinct().collect()
    assert [k[0] for k in keys] == ["s|other"]


def test_metric_named_log_shares_the_log_key(spark):
    rows = [metric(0, 1.0, name="log", source="s"), log(1, 2, source="s")]
    df = spark.createDataFrame(rows, EVENT)
    assert df.select(detect.series_key()).distinct().count() == 1
    assert df.select(detect.typed_series_key()).distinct().count() == 2


def test_alert_json_escapes_and_rounds_half_up(spark):
    df = spark.createDataFrame(
        [('r"x', "a\\b", 0.125, 200.0, 7, "CRITICAL"), ("r", "c", math.nan, 1.0, 7, "WARNING"), ("r", "c", 2.0, math.inf, 7, "CRITICAL")],
        "rule string, component string, threshold double, actual double, timestamp_ms long, severity string",
    )
    assert [r.value for r in detect.alert_json(df).collect()] == [
        '{"rule":"r\\"x","component":"a\\\\b","threshold":0.13,"actual":200.00,"timestamp_ms":7,"severity":"CRITICAL"}',
        '{"rule":"r","component":"c","threshold":null,"actual":1.00,"timestamp_ms":7,"severity":"WARNING"}',
        '{"rule":"r","component":"c","threshold":2.00,"actual":null,"timestamp_ms":7,"severity":"CRITICAL"}',
    ]


def test_a_missing_value_counts_as_zero_above_a_negative_limit(spark):
    df = spark.createDataFrame([metric(0, None, name="cold")], EVENT)
    assert [(r.rule, r.actual) for r in detect.threshold_alerts(df, Rules(limits={"cold": -5.0})).collect()] == [("cold_threshold", 0.0)]
    assert detect.threshold_alerts(df, Rules(limits={"cold": 5.0})).collect() == []


def _model(rows, alpha=0.1):
    """(position, kind, threshold, actual) of one key's rows of (is_metric, value, severity)."""
    s = Series(alpha=alpha)
    out = []
    for i, (is_metric, value, severity) in enumerate(rows):
        for kind, threshold, actual in s.metric("other", value) if is_metric else s.log(severity):
            out.append((i, kind == "deviation", threshold, actual))
    return out


def _columns(rows):
    return {
        "is_metric": np.array([r[0] for r in rows], dtype=bool),
        "value": np.array([r[1] if r[0] else math.nan for r in rows], dtype=float),
        "severity": np.array([math.nan if r[0] else r[2] for r in rows], dtype=float),
    }


ROWS = st.lists(
    st.tuples(
        st.booleans(),
        st.one_of(st.floats(-1e6, 1e6), st.sampled_from([100.0, 101.0, 99.0])),
        st.integers(0, 5),
    ),
    min_size=1,
    max_size=150,
)


@settings(max_examples=150, deadline=None)
@given(ROWS, st.lists(st.integers(1, 149), max_size=5), st.sampled_from([0.1, 0.5, 1.0, 0.0]))
def test_any_split_gives_the_model_state(rows, cuts, alpha):
    """Summaries of any runs of rows, combined or advanced over, lead to the state of the model."""
    kernel = AlertKernel(Rules(ema_alpha=alpha))
    model = Series(alpha=alpha)
    for is_metric, value, severity in rows:
        model.metric("other", value) if is_metric else model.log(severity)
    bounds = [0, *sorted({c for c in cuts if c < len(rows)}), len(rows)]
    parts = [_columns(rows[a:b]) for a, b in zip(bounds, bounds[1:])]
    scanned = advanced = combined = None
    for p in parts:
        *_, scanned = kernel.alerts(scanned, p)
        s = kernel.summarize(p)
        advanced = kernel.advance(advanced, s)
        combined = s if combined is None else kernel.combine(combined, s)
    scale = 1 + max(abs(r[1]) for r in rows)
    for state in (scanned, advanced, kernel.advance(None, combined)):
        assert state[3] == model.count and state[4] == model.errors
        assert bool(state[0]) == (model.mean is not None)
        if model.mean is not None:
            assert state[1] == pytest.approx(model.mean, abs=1e-9 * scale)
            assert state[2] == pytest.approx(model.var, abs=1e-9 * scale * scale)


@settings(max_examples=60, deadline=None)
@given(ROWS)
def test_alerts_of_one_run(rows):
    at, deviates, threshold, actual, _ = AlertKernel(Rules()).alerts(None, _columns(rows))
    got = list(zip(at.tolist(), deviates.tolist(), threshold.tolist(), actual.tolist()))
    want = _model(rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2:] for g in got] == [pytest.approx(w[2:], rel=1e-9) for w in want]


def test_long_runs_take_the_vector_path():
    rng = random.Random(5)
    x = np.array([rng.gauss(100, 10) for _ in range(5000)])
    mean, var, last_mean, last_var = ewma(x, None, 0.0, 0.1)
    model = Series()
    for i, v in enumerate(x):
        if i:
            assert mean[i] == pytest.approx(model.mean, rel=1e-12)
            assert var[i] == pytest.approx(model.var, rel=1e-9)
        model.metric("other", v)
    assert (last_mean, last_var) == (pytest.approx(model.mean), pytest.approx(model.var))


@pytest.mark.parametrize("bad", [math.nan, math.inf, -math.inf])
def test_a_number_that_is_not_finite_ends_the_baseline(bad):
    rng = random.Random(1)
    values = [rng.gauss(100, 10) for _ in range(200)] + [bad] + [rng.gauss(100, 10) for _ in range(200)]
    rows = [(True, v, 0) for v in values]
    at, *_ = AlertKernel(Rules()).alerts(None, _columns(rows))
    assert at.tolist() == [i for i, *_ in _model(rows)]


def test_one_hot_series_is_split_over_segments(spark):
    """A key with nearly all rows spans several segments and still gives the model's alerts."""
    rng = random.Random(3)
    rows = []
    for i in range(20000):
        v = rng.gauss(50, 5) + (60 if rng.random() < 0.01 else 0)
        rows.append((f"{i:06d}", "hot" if i % 20 else f"cold-{i % 7}", i // 3, v))
    df = spark.createDataFrame(rows, "event_id string, source string, timestamp_ms long, v double")
    events = df.select(
        "event_id",
        "timestamp_ms",
        "source",
        F.struct(F.lit("m").alias("metric_name"), F.col("v").alias("value"), F.col("source").alias("component")).alias(
            "metric"
        ),
        F.lit(None).cast("struct<severity:int>").alias("log"),
    ).repartition(6)
    keyed = detect.keyed_rows(events)
    segments = ordered_segments(keyed, "series_key", ["timestamp_ms", "event_id"])
    per_segment = segments.filter("series_key = 'hot|m'").groupBy("_segment").count().collect()
    assert len(per_segment) >= 7 and max(r["count"] for r in per_segment) < 5000
    models, want = {}, set()
    for event_id, source, _, v in rows:
        for kind, *_ in models.setdefault(source, Series()).metric("m", v):
            want.add((event_id, kind))
    got = {(r.event_id, "deviation") for r in detect.deviation_alerts(events).collect()}
    assert got == want and len(want) > 100
    states = detect.ewma_baseline(events).collect()
    assert len(states) == len(rows)
    last = max((r for r in states if r.series_key == "hot|m"), key=lambda r: r.samples)
    assert last.samples == models["hot"].count
    assert last.mean == pytest.approx(models["hot"].mean, rel=1e-9)


def test_hot_log_source_is_split_too(spark):
    rng = random.Random(4)
    rows = [(i, 4 if rng.random() < 0.2 else 2) for i in range(9000)]
    df = spark.createDataFrame(rows, "event_id long, severity int")
    events = df.select(
        "event_id",
        F.col("event_id").alias("timestamp_ms"),
        F.lit("hot").alias("source"),
        F.lit(None).cast("struct<metric_name:string,value:double,component:string>").alias("metric"),
        F.struct("severity").alias("log"),
    )
    model, want = Series(), {}
    for event_id, severity in rows:
        for _, _, rate in model.log(severity):
            want[event_id] = rate
    got = {r.event_id: r.actual for r in detect.log_error_rate_alerts(events).collect()}
    assert got == want and want


def test_scan_of_nothing(spark):
    empty = spark.createDataFrame([], EVENT)
    assert detect.detect_alerts(empty).count() == 0
    assert detect.ewma_baseline(empty).count() == 0


def test_counter_restarts_across_segments(spark):
    rows = [(i, float(i % 700)) for i in range(5000)]
    df = spark.createDataFrame(rows, "n long, value double").withColumn("k", F.lit("one"))
    got = ordered_scan(df, "k", ["n"], CounterKernel(), ["n", "value"]).orderBy("n").collect()
    assert [r.increase for r in got] == [0.0] + [
        v - p if v >= p else v for (_, p), (_, v) in zip(rows, rows[1:])
    ]


def test_order_by_log_position(spark):
    """With offsets given, arrival order counts instead of event time."""
    rows = [metric(i, v, ts=100 - i) + (0, i) for i, v in enumerate(NEAR_100 + [199.0])]
    schema = T.StructType(list(EVENT.fields)).add("partition", "integer").add("offset", "long")
    df = spark.createDataFrame(rows, schema)
    kept = detect.baseline_alerts(df, WARM5, by_offset=True).collect()
    assert [r.actual for r in kept] == [199.0]
    assert detect.baseline_alerts(df, WARM5).count() == 0


def test_state_kernel_reports_every_metric():
    kernel = StateKernel(Rules())
    assert kernel.output.names == ["samples", "mean", "variance"]
