import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import detect, incidents
from tidewatch.plans import adapters
from tidewatch.rules import Rules
from tidewatch.schema import AUDIT
from tidewatch.sources import audit
from tidewatch.sources.events import decode, decoded_events
from tidewatch.streaming import detector, packs, reorder, sinks
from tidewatch.streaming.incidents import track_incidents_stream

EVENTS = "/root/testdata/sf0.001/events.parquet"


def fresh():
    return tempfile.mkdtemp(prefix="run-")


def stream_of(spark, parts, schema, folder):
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .parquet(folder)
    )


def alerts_of(spark, parts, schema, rules=Rules(), **kw):
    folder = fresh()
    found = detector.detect_alerts_stream(stream_of(spark, parts, schema, f"{folder}/in"), rules, **kw)
    query = sinks.write_alert_files(found, f"{folder}/out", f"{folder}/state", once=True)
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out"), query


def key(r):
    return (r.event_id, r.rule, r.component, round(r.threshold, 9), round(r.actual, 9), r.timestamp_ms, r.severity)


@pytest.mark.parametrize("files", [1, 2, 5])
def test_stream_equals_batch_whatever_the_files(spark, files):
    telemetry = adapters.as_telemetry(spark.read.parquet(EVENTS))
    rules = Rules(warmup_samples=5)
    want = sorted(key(r) for r in detect.detect_alerts(telemetry, rules).collect())
    size = 1000 // files
    parts = [
        telemetry.filter((F.col("event_id") >= i * size) & (F.col("event_id") < (i + 1) * size)) for i in range(files)
    ]
    got, query = alerts_of(spark, parts, telemetry.schema, rules)
    assert sorted(key(r) for r in got.collect()) == want and want
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == files


def _plain(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, timestamp_ms long, value double")
    return df.select(
        "event_id",
        "timestamp_ms",
        F.lit("s").alias("source"),
        F.struct(F.lit("m").alias("metric_name"), "value", F.lit("c").alias("component")).alias("metric"),
        F.lit(None).cast("struct<severity:int>").alias("log"),
    )


def test_late_rows_are_processed_in_arrival_order(spark):
    rules = Rules(warmup_samples=5)
    early = _plain(spark, [(i, 1000 + i, v) for i, v in enumerate([98.0, 102.0, 99.0, 101.0, 100.0, 98.0])])
    late = _plain(spark, [(100, 1, 500.0)])
    got, _ = alerts_of(spark, [early, late], early.schema, rules)
    assert [r.event_id for r in got.collect()] == [100]
    assert detect.detect_alerts(early.union(late), rules).count() == 0


def test_state_with_a_time_to_live(spark):
    """With a clock in play a stream never counts as finished, so run one micro-batch only."""
    folder = fresh()
    rows = _plain(spark, [(i, i, 100.0 + i % 3) for i in range(30)] + [(30, 30, 900.0)])
    found = detector.detect_alerts_stream(stream_of(spark, [rows], rows.schema, f"{folder}/in"), ttl_ms=3_600_000)
    writer = found.writeStream.format("parquet").option("path", f"{folder}/out")
    query = writer.option("checkpointLocation", f"{folder}/state").trigger(once=True).start()
    assert query.awaitTermination(120)
    got = spark.read.schema(found.schema).parquet(f"{folder}/out").collect()
    assert [r.event_id for r in got] == [30]


def test_restart_goes_on_with_the_state(spark):
    """A second run on the same checkpoint reads only the new file, with the old baseline."""
    folder = fresh()
    first = _plain(spark, [(i, i, 100.0 + i % 3) for i in range(25)])
    second = _plain(spark, [(99, 99, 900.0)])
    for i, part in enumerate([first, second]):
        part.coalesce(1).write.parquet(f"{folder}/in/{i}")
        stream = spark.readStream.schema(first.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        found = detector.detect_alerts_stream(stream)
        sinks.write_alert_json(found, f"{folder}/out", f"{folder}/state", once=True).awaitTermination()
    lines = [r.value for r in spark.read.text(f"{folder}/out").collect()]
    assert len(lines) == 1 and '"rule":"m_baseline_deviation"' in lines[0]


def test_incident_state_equals_batch(spark):
    rng = random.Random(2)
    rows = [
        (cycle, kind, "c", rng.choice([None, f"{rng.randint(1, 9)}ms"]), rng.random() < 0.5)
        for cycle in range(60)
        for kind in ("a", "b", "d")
        if rng.random() < 0.5
    ]
    # A suppressed detection is never delivered, so batch and stream see the same flags.
    schema = "cycle long, anomaly_type string, affected_component string, observed_value string, delivered boolean"
    df = spark.createDataFrame(rows, schema)
    columns = ["fingerprint", "cycle", "observed_value", "value", "status", "occurrences", "should_report"]
    want = sorted(map(str, incidents.track_incidents(df).select(*columns).collect()))
    folder = fresh()
    parts = [df.filter(f"cycle div 20 = {i}") for i in range(3)]
    out = track_incidents_stream(stream_of(spark, parts, df.schema, f"{folder}/in"))
    sinks._writer(out, "incidents", f"{folder}/state", True).format("parquet").option(
        "path", f"{folder}/out"
    ).start().awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{folder}/out").select(*columns)
    assert sorted(map(str, got.collect())) == want


def test_decode_errors_show_in_the_progress(spark):
    folder = fresh()
    spark.createDataFrame([("{}",), ("{broken",), (None,)], "value string").coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("value string").parquet(f"{folder}/in")
    events = decoded_events(decode(stream)).select("event_id", "timestamp_ms", "source")
    query = (
        events.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == 1
    seen = [p["observedMetrics"]["decode"] for p in query.recentProgress if "decode" in p["observedMetrics"]]
    assert (seen[0]["records"], seen[0]["errors"]) == (3, 2)


def test_offsets_of_a_kafka_query(spark):
    progress = {
        "sources": [
            {"endOffset": '{"t":{"0":5,"1":7}}', "latestOffset": '{"t":{"0":9,"1":7,"2":4}}'},
            {"endOffset": {"u": {"0": 1}}, "latestOffset": {"u": {"0": 2}}},
        ]
    }
    got = sinks.offsets_from_progress(spark, progress, "g").collect()
    assert sorted((r.topic, r.partition, r.committed, r.high) for r in got) == [
        ("t", 0, 5, 9), ("t", 1, 7, 7), ("t", 2, -1, 4), ("u", 0, 1, 2),
    ]


def test_stream_query_reads_a_folder_like_a_file(spark, tmp_path):
    """A table may be one file or many part files in a folder; both give the alerts of the batch."""
    from tidewatch.plans import catalog

    source = "/root/testdata/sf0.001"
    if not os.path.isdir(source):
        pytest.skip("no test data")
    events = spark.read.parquet(f"{source}/events.parquet")
    events.repartition(5).write.parquet(f"file://{tmp_path}/events.parquet")
    whole = sorted(map(tuple, catalog.queries()["all_alerts"](spark, source).collect()))
    assert whole
    for folder in (source, f"file://{tmp_path}"):
        assert sorted(map(tuple, catalog.queries()["stream_alerts"](spark, folder).collect())) == whole


def test_audit_keeps_entries_over_new_checkpoints_and_writers(spark, tmp_path):
    """A stream with a new checkpoint starts at batch 0 again, but replaces nothing that is there."""
    entry = {f.name: None for f in AUDIT.fields}
    rows = [spark.createDataFrame([tuple((entry | {"incident_id": f"i{n}"}).values())], AUDIT) for n in range(3)]
    log = f"{tmp_path}/log"
    audit.append_audit(rows[0], log)
    for n in (1, 2):
        rows[n].write.parquet(f"{tmp_path}/in{n}")
        stream = spark.readStream.schema(AUDIT).parquet(f"{tmp_path}/in{n}").writeStream.foreachBatch(audit.audit_batch_writer(log))
        stream.option("checkpointLocation", f"{tmp_path}/state{n}").trigger(availableNow=True).start().awaitTermination()
    back = audit.read_audit(spark, log)
    assert back.columns == AUDIT.names
    assert sorted(r.incident_id for r in back.collect()) == ["i0", "i1", "i2"]


def _written(stream, folder):
    query = sinks.write_alert_files(stream, f"{folder}/out", f"{folder}/state", once=True)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out"), query


def test_reordered_rows_give_the_alerts_of_the_batch(spark):
    """Rows late within the delay are put in order; what is later than that is dropped and counted."""
    rules = Rules(warmup_samples=5)
    rng = random.Random(3)
    rows = [(i, (i + 60) * 1000, 100.0 + rng.choice([-1, 0, 1]) if i % 17 else 500.0) for i in range(120)]
    shuffled = sorted(rows, key=lambda r: r[0] + rng.random() * 25)
    parts = [_plain(spark, shuffled[i : i + 30]) for i in range(0, 120, 30)]
    # The first one is later than the delay when it comes, the second one moves the watermark on.
    parts += [_plain(spark, [(998, 1, 900.0)]), _plain(spark, [(999, 10_000_000, 100.0)]), _plain(spark, [(1000, 20_000_000, 100.0)])]
    folder = fresh()
    found = reorder.detect_alerts_in_order(stream_of(spark, parts, parts[0].schema, f"{folder}/in"), "30 seconds", rules)
    got, query = _written(found, folder)
    want = detect.detect_alerts(_plain(spark, rows), rules)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and got.count() > 3
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    assert dropped == 1
    # In arrival order the same files give other alerts.
    folder = fresh()
    other, _ = _written(detector.detect_alerts_stream(stream_of(spark, parts, parts[0].schema, f"{folder}/in"), rules), folder)
    assert sorted(map(key, other.collect())) != sorted(map(key, want.collect()))


def test_reordered_log_rows_keep_their_severity(spark):
    telemetry = adapters.as_telemetry(spark.read.parquet(EVENTS), "log").filter("event_id < 400")
    far = telemetry.limit(1).withColumn("timestamp_ms", F.col("timestamp_ms") + 10**10).withColumn("source", F.lit("tick"))
    parts = [telemetry.filter(f"event_id % 2 = {i}") for i in (1, 0)] + [far]
    folder = fresh()
    found = reorder.detect_alerts_in_order(stream_of(spark, parts, telemetry.schema, f"{folder}/in"), "40 days")
    got, _ = _written(found, folder)
    want = detect.detect_alerts(telemetry)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and got.count() > 3


def test_waiting_rows_survive_a_restart(spark):
    rules = Rules(warmup_samples=5)
    folder = fresh()
    rows = [(i, (i + 1) * 1000, 100.0 + i % 3) for i in range(40)] + [(40, 41_000, 900.0), (41, 10_000_000, 100.0)]
    for i, part in enumerate((rows[20:41], rows[:20], rows[41:])):
        _plain(spark, part).coalesce(1).write.parquet(f"{folder}/in/{i}")
        stream = spark.readStream.schema(_plain(spark, rows).schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        got, _ = _written(reorder.detect_alerts_in_order(stream, "1 hour", rules), folder)
    assert [r.event_id for r in got.collect()] == [40]


def test_repeated_alert_lines_are_read_once(spark):
    def line(ts, actual, rule="r"):
        return (f'{{"rule":"{rule}","component":"c","threshold":1.00,"actual":{actual},"timestamp_ms":{ts},"severity":"WARNING"}}',)

    first = [line(1000, "2.00"), line(1000, "3.00"), line(2000, "2.00"), ("{broken",), (None,), line(1500, "null")]
    parts = [spark.createDataFrame(rows, "value string") for rows in (first, first, [*first[:2], line(1000, "2.00", "q")], first[::-1])]
    folder = fresh()
    found = sinks.read_alerts_once(stream_of(spark, parts, parts[0].schema, f"{folder}/in"), "1 hour")
    got, _ = _written(found, folder)
    assert sorted((r.timestamp_ms, r.rule, str(r.actual)) for r in got.collect()) == [
        (1000, "q", "2.0"), (1000, "r", "2.0"), (1000, "r", "3.0"), (1500, "r", "None"), (2000, "r", "2.0"),
    ]


def test_waiting_rows_are_kept_in_packs(spark):
    """State holds packs of rows, so neither it nor the engine handles single rows."""
    rules = Rules(warmup_samples=5)
    rows = [(i, (i + 60) * 1000, 100.0 + i % 3 if i % 17 else 500.0) for i in range(5000)]
    ends = [(9000, 10**8, 100.0), (9001, 2 * 10**8, 100.0)]
    parts = [_plain(spark, part) for part in (rows[2500:], rows[:2500], *([end] for end in ends))]
    folder = fresh()
    found = reorder.detect_alerts_in_order(stream_of(spark, parts, parts[0].schema, f"{folder}/in"), "2 hours", rules)
    got, query = _written(found, folder)
    want = detect.detect_alerts(_plain(spark, rows + ends), rules)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and got.count() > 3
    assert 0 < max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) < 200


def test_rows_behind_the_scan_in_a_pack_in_time_are_counted(spark):
    rules = Rules(warmup_samples=5)
    rows = [(i, (i + 1) * 1000, 100.0 + i % 3) for i in range(40)]
    late = (1000, 9_965_000, 900.0)
    later = [[(999, 10_000_000, 100.0)], [(1001, 10_000_001, 100.0)], [late, (1002, 9_990_000, 100.0)], [(1003, 20_000_000, 100.0)], [(1004, 30_000_000, 900.0)]]
    parts = [_plain(spark, part) for part in (rows, *later, [(1005, 40_000_000, 100.0)], [(1006, 50_000_000, 100.0)])]
    folder, dropped = fresh(), spark.sparkContext.accumulator(0)
    found = reorder.detect_alerts_in_order(stream_of(spark, parts, parts[0].schema, f"{folder}/in"), "30 seconds", rules, dropped)
    got, _ = _written(found, folder)
    want = detect.detect_alerts(_plain(spark, [*rows, *(r for part in later for r in part if r != late)]), rules)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and got.count() > 0
    assert dropped.value == 1


def test_packs_hold_the_rows_of_one_series_and_cell(spark):
    """The engine hands a state processor packs, not single rows."""
    rows = detect.keyed_rows(_plain(spark, [(i, i * 500, float(i)) for i in range(20_000)])).coalesce(2)
    got = packs.pack(rows, 600_000).collect()
    assert len(got) <= 2 * 18
    read = [(r, packs.read_rows([bytes(r.rows)]).to_pylist()) for r in got]
    assert all({x["timestamp_ms"] // 600_000 for x in inner} == {r.from_ms // 600_000} for r, inner in read)
    assert all((inner[0]["timestamp_ms"], inner[-1]["timestamp_ms"]) == (r.from_ms, r.to_ms) for r, inner in read)
    back = sorted((x | {"series_key": r.series_key} for r, inner in read for x in inner), key=lambda x: x["event_id"])
    assert back == [r.asDict() for r in rows.orderBy("event_id").collect()]


def test_state_has_no_more_partitions_than_cores_can_use(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        _, query = alerts_of(spark, [_plain(spark, [(1, 1, 1.0)])], _plain(spark, []).schema)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "100"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert query.lastProgress["stateOperators"][0]["numShufflePartitions"] <= 2 * spark.sparkContext.defaultParallelism
