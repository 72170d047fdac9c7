import random

import pytest
from pyspark.sql import functions as F

from tests.models import Memory, number
from tidewatch.functions.keys import fingerprint
from tidewatch.functions.text import leading_number
from tidewatch.operators import incidents
from tidewatch.rules import Rules

SCHEMA = "cycle long, anomaly_type string, affected_component string, observed_value string, delivered boolean"
SPIKE = "latency_spike"


def tracked(spark, rows, rules=Rules()):
    df = incidents.track_incidents(spark.createDataFrame(rows, SCHEMA), rules)
    return [
        (r.cycle, r.fingerprint, r.status, r.occurrences, r.should_report)
        for r in df.orderBy("cycle", "fingerprint").collect()
    ]


def row(cycle, value=None, delivered=True, kind=SPIKE, component="processor"):
    return (cycle, kind, component, value, delivered)


@pytest.mark.parametrize(
    ("rows", "last"),
    [
        ([row(1)], ("new", 1, True)),
        ([row(1), row(2)], ("ongoing", 2, False)),
        ([row(1, delivered=False), row(2)], ("ongoing", 2, True)),
        ([row(1, "2000"), row(2, "3000")], ("worsening", 2, True)),
        ([row(1, "2000"), row(2, "2100")], ("ongoing", 2, False)),
        ([row(1, "2000"), row(2, "2500")], ("worsening", 2, True)),
        ([row(1, "0"), row(2, "2500")], ("ongoing", 2, False)),
        ([row(1, "-5"), row(2, "2500")], ("ongoing", 2, False)),
        ([row(1), row(5)], ("new", 1, True)),
        ([row(1), row(3)], ("new", 1, True)),
    ],
)
def test_lifecycle(spark, rows, last):
    assert tracked(spark, rows)[-1][2:] == last


def test_dedup_off_reports_each_time(spark):
    assert [r[4] for r in tracked(spark, [row(1), row(2)], Rules(dedup=False))] == [True, True]


def test_missing_component_reads_unknown(spark):
    rows = tracked(spark, [row(1, component=None), row(2, component="")])
    assert [(r[1], r[2]) for r in rows] == [(f"{SPIKE}:unknown", "new"), (f"{SPIKE}:unknown", "ongoing")]


def test_resolved_by_another_anomaly_or_an_all_clear(spark):
    two = spark.createDataFrame([row(1), row(2, kind="backpressure", component="sink")], SCHEMA)
    got = incidents.resolved_incidents(two).collect()
    assert [(r.cycle, r.fingerprint) for r in got] == [(2, f"{SPIKE}:processor")]
    one = spark.createDataFrame([row(1)], SCHEMA)
    assert incidents.resolved_incidents(one).collect() == []
    clear = spark.createDataFrame([(2,), (3,), (4,)], "cycle long")
    got = incidents.resolved_incidents(one, all_clear=clear).collect()
    assert sorted(r.cycle for r in got) == [2, 3]


@pytest.mark.parametrize("gap", [1, 2])
def test_random_histories_agree_with_the_model(spark, gap):
    rng = random.Random(gap)
    kinds = [(SPIKE, "a"), (SPIKE, "b"), ("backpressure", None)]
    rows, clear, want, resolved, carried = [], [], [], [], []
    memory = Memory(gap=gap)
    for cycle in range(1, 400):
        active = [
            (cycle, f, m["n"], m["value"]) for f, m in memory.known.items() if 0 < cycle - m["last"] <= gap
        ]
        carried += active
        current = [k for k in kinds if rng.random() < 0.35]
        names = {f"{k}:{c or 'unknown'}" for k, c in current}
        if current or rng.random() < 0.5:
            resolved += [(cycle, f) for f in memory.resolved(cycle, names)]
            if not current:
                clear.append((cycle,))
        for kind, component in current:
            value = rng.choice([None, "n/a", f"{rng.randint(-5, 20)},000ms", str(rng.random())])
            delivered = rng.random() < 0.6
            rows.append((cycle, kind, component, value, delivered))
            want.append((cycle, *memory.observe(kind, component, value, cycle, delivered)))
    df = spark.createDataFrame(rows, SCHEMA)
    rules = Rules(ongoing_gap=gap)
    assert tracked(spark, rows, rules) == sorted(want)
    got = incidents.resolved_incidents(df, rules, spark.createDataFrame(clear, "cycle long")).collect()
    assert sorted((r.cycle, r.fingerprint) for r in got) == sorted(resolved)
    got = incidents.carried_over(df, rules).filter("before_cycle < 400").collect()
    assert sorted((r.before_cycle, r.fingerprint, r.occurrences, r.last_value) for r in got) == sorted(
        carried, key=lambda r: r[:2]
    )
    before = incidents.carryover_before(df, 200, rules).collect()
    assert [(200, r.fingerprint, r.occurrences, r.last_value) for r in before] == sorted(
        (c for c in carried if c[0] == 200), key=lambda r: r[1]
    )


def test_leading_number(spark):
    texts = ["2,340ms", None, "n/a", "-5", ".5s", "+7", "up 12.25 of 30", "1.", ""]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r[0] for r in df.select(leading_number(F.col("v"))).collect()]
    assert got == [number(t) for t in texts] == [2340.0, None, None, -5.0, 0.5, 7.0, 12.25, 1.0, None]


def test_anomaly_per_cycle_is_the_one_furthest_over_its_limit(spark):
    alerts = spark.createDataFrame(
        [
            ("e1", "latency_ms_threshold", "a", 200.0, 400.0, 61_000, "CRITICAL"),
            ("e2", "latency_ms_threshold", "a", 200.0, 900.0, 62_000, "CRITICAL"),
            ("e3", "latency_ms_baseline_deviation", "a", 100.0, 30.0, 63_000, "WARNING"),
            ("e4", "heap_usage_percent_threshold", "a", 85.0, 90.0, 64_000, "CRITICAL"),
            ("e5", "error_rate_high", "a", 0.2, 0.5, 130_000, "CRITICAL"),
            ("e6", "disk_baseline_deviation", "b", 10.0, 5.0, 130_000, "WARNING"),
        ],
        "event_id string, rule string, component string, threshold double, actual double, timestamp_ms long, "
        "severity string",
    )
    got = incidents.anomalies_from_alerts(alerts).orderBy("cycle", "anomaly_type").collect()
    assert [(r.cycle, r.anomaly_type, r.observed_value, r.source_signal_ids, r.breach_direction) for r in got] == [
        (1, "latency_spike", "900.00ms", ["e2"], "above"),
        (1, "memory_pressure", "90.00%", ["e4"], "above"),
        (2, "error_burst", "0.50", ["e5"], "above"),
        (2, "unknown", "5.00", ["e6"], "below"),
    ]
    assert got[3].baseline == "10.00" and got[3].threshold is None


def test_fingerprint(spark):
    got = spark.range(1).select(fingerprint(F.lit("t"), F.lit(None).cast("string"))).first()[0]
    assert got == "t:unknown"


def test_times_are_utc_in_any_session(spark):
    alerts = spark.createDataFrame(
        [("e", "latency_ms_threshold", "a", 200.0, 400.0, 1704067200123, "CRITICAL")],
        "event_id string, rule string, component string, threshold double, actual double, timestamp_ms long, "
        "severity string",
    )
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert incidents.anomalies_from_alerts(alerts).first().detected_at == "2024-01-01T00:00:00.123Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
