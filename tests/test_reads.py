import json
import random
import tempfile

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import durations
from tidewatch.operators import lag, metrics, tail
from tidewatch.rules import Rules
from tidewatch.schema import EVENT
from tidewatch.sources import events as ev
from tidewatch.sources import snapshots

LOG_SCHEMA = T.StructType(list(EVENT.fields)).add("partition", "integer").add("offset", "long")


def topic(spark, sizes, seed=0):
    """Events of a topic; partition p holds sizes[p] rows with dense offsets."""
    rng = random.Random(seed)
    rows = []
    for p, size in enumerate(sizes):
        for o in range(size):
            is_log = rng.random() < 0.6
            log = (rng.randint(0, 5), rng.choice(["Timeout at 50%", "all fine", None]), rng.choice(["A", "b"]), "", "", {})
            metric = ("m", float(o), "", "c", {})
            rows.append((f"{p}-{o}", o * 10 + p, "s", None if is_log else metric, log if is_log else None, None, None, p, o))
    return spark.createDataFrame(rows, LOG_SCHEMA), rows


def newest_first(rows):
    return sorted(rows, key=lambda r: (r[1], r[7], r[8]), reverse=True)


@pytest.mark.parametrize(("sizes", "count"), [([30, 30], 7), ([3, 40, 0], 20), ([200, 200], 500), ([5], 20)])
def test_recent_events(spark, sizes, count):
    df, rows = topic(spark, sizes)
    n = min(count, 100)
    parts = {r[7] for r in rows}
    share = n // len(parts) + 1
    last = [r for r in rows if r[8] >= max(0, sizes[r[7]] - share)]
    rules = Rules(events_max_count=100)
    got = [r.event_id for r in tail.recent_events(df, count, rules=rules).collect()]
    assert got == [r[0] for r in newest_first(last)[:n]]
    # The type filter comes after the tail.
    got = [r.event_id for r in tail.recent_events(df, count, "LOG", rules).collect()]
    assert got == [r[0] for r in newest_first(r for r in last if r[4])[:n]]


def test_recent_events_with_given_offsets(spark):
    df, _ = topic(spark, [50, 50])
    offsets = spark.createDataFrame([(0, 20), (1, 50)], "partition int, high long")
    got = {r.event_id for r in tail.recent_events(df, 4, offsets=offsets).collect()}
    # Partition 0 starts at 20 - 3; its later events are there as well.
    assert got == {r[0] for r in newest_first([r for r in topic(spark, [50, 50])[1] if r[8] >= (17, 47)[r[7]]])[:4]}


def test_unknown_type_is_refused(spark):
    df, _ = topic(spark, [2])
    with pytest.raises(ValueError):
        tail.recent_events(df, 2, "source")


def model_search(rows, sizes, pattern, count, severity=None, component=None, depth=None):
    names = ["SEVERITY_UNSPECIFIED", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
    share = max(sizes) if depth is None else depth // len(sizes)
    scan = sorted((r for r in rows if r[8] >= max(0, sizes[r[7]] - share)), key=lambda r: (r[1], r[7], r[8]))[:depth]
    found, scanned = [], 0
    for r in scan:
        if count is not None and len(found) >= count:
            break
        scanned += 1
        log = r[4]
        if log is None or pattern.lower() not in (log[1] or "").lower():
            continue
        if severity and names[log[0]] != severity.upper():
            continue
        if component and log[2].lower() != component.lower():
            continue
        found.append((r[7], r[8]))
    return found, scanned


@pytest.mark.parametrize("depth", [None, 500])
@pytest.mark.parametrize(
    ("pattern", "count", "severity", "component"),
    [("TIMEOUT", 20, None, None), ("50%", 5, "warn", None), ("", 300, None, "B"), ("_", 5, None, None), ("t", 0, None, None), ("fine", None, None, None)],
)
def test_search(spark, pattern, count, severity, component, depth):
    sizes = [400, 100, 300]
    df, rows = topic(spark, sizes, 1)
    rules = Rules(log_scan_depth=depth)
    want, scanned = model_search(rows, sizes, pattern, count, severity, component, depth)
    got = tail.search_logs(df, pattern, count, severity, component, rules).collect()
    assert [(r.partition, r.offset) for r in got] == want
    one = tail.search_summary(df, pattern, count, severity, component, rules).collect()[0]
    stopped = count is not None and len(want) >= count
    assert (one.pattern, one.messages_scanned, one.match_count, one.partial) == (pattern, scanned, len(want), stopped or depth is not None)


def test_search_finds_a_match_long_before_the_end(spark):
    log = F.struct(F.lit(2).alias("severity"), F.when(F.col("id") == 10, "needle").otherwise("hay").alias("message"), F.lit("c").alias("component"), F.lit("").alias("logger_name"), F.lit("").alias("stack_trace"), F.create_map().cast("map<string,string>").alias("context"))
    events = spark.range(50_000).select(F.col("id").alias("timestamp_ms"), F.lit("s").alias("source"), log.alias("log"), (F.col("id") % 4).cast("int").alias("partition"), F.floor(F.col("id") / 4).alias("offset"))
    assert [r.timestamp_ms for r in tail.search_logs(events, "needle").collect()] == [10]
    one = tail.search_summary(events, "needle", 1).collect()[0]
    assert (one.messages_scanned, one.match_count, one.partial) == (11, 1, True)
    one = tail.search_summary(events, "needle", 2).collect()[0]
    assert (one.messages_scanned, one.match_count, one.partial) == (50_000, 1, False)


def test_search_of_an_empty_log(spark):
    df = topic(spark, [3])[0].limit(0)
    assert tail.search_logs(df, "x").collect() == []
    assert tuple(tail.search_summary(df, "x").collect()[0]) == ("x", 0, 0, False)


def test_tail_reads_the_log_twice(spark, tmp_path):
    """A narrow scan for the watermarks, then only row groups that reach the tail."""
    df, _ = topic(spark, [5000, 5000])
    df.repartitionByRange(8, "offset").write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    out = tail.last_per_partition(log, 20, 1)
    assert out.count() == 22
    out.collect()

    def scans(plan):
        if plan.nodeName().startswith("Scan"):
            yield plan.metrics().get("numOutputRows").get().value()
        inner = [plan.children().apply(i) for i in range(plan.children().size())]
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            inner.append(plan.executedPlan())
        elif "QueryStage" in kind:
            inner.append(plan.plan())
        for p in inner:
            yield from scans(p)

    assert max(scans(out._jdf.queryExecution().executedPlan())) < 10_000


def test_lag_and_throughput(spark):
    high = spark.createDataFrame(
        [("t", p, 0, h) for p, h in enumerate([14000, 14000, 14500, 14500, 14000, 14000])],
        "topic string, partition int, low long, high long",
    )
    committed = spark.createDataFrame(
        [("g", "t", 0, -1), ("g", "t", 1, 0), ("g", "t", 2, 20000), ("other", "t", 3, 14500)],
        "group string, topic string, partition int, committed long",
    )
    got = {r.partition: r for r in lag.consumer_lag(high, committed, "g").collect()}
    assert [got[p].lag for p in range(6)] == [14000, 14000, 0, 14500, 14000, 14000]
    assert got[0].committed_offset == 0 and got[3].committed_offset == 0
    total = lag.total_lag(lag.consumer_lag(high, committed.limit(0), "g")).collect()[0]
    assert (total.total_lag, total.partitions) == (85000, 6)
    rate = lag.topic_throughput(high, 0).collect()[0]
    assert (rate.total_messages, rate.estimated_rate_per_second, rate.partition_count) == (85000, 85000.0, 6)
    empty = high.withColumn("high", F.lit(0).cast("long"))
    assert lag.topic_throughput(empty).collect()[0].estimated_rate_per_second == 0.0


def docs(spark, key, *values):
    rows = [(f"k{i}", v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"{key} string, value string")


def test_jobs(spark):
    job = {"jid": "abc123", "name": "n", "state": "RUNNING", "start-time": 1718000000000, "duration": 3600000}
    got = snapshots.job_overview(docs(spark, "k", {"jobs": [job]}, {"jobs": []}, {})).collect()
    assert [tuple(r) for r in got] == [("abc123", "n", "RUNNING", 1718000000000, 3600000, {})]


def test_checkpoints(spark):
    full = {
        "counts": {"completed": 42, "failed": 1, "in_progress": 0, "restored": 0, "total": 43},
        "latest": {"completed": {"id": 42, "duration": 1500, "state_size": 1048576}, "failed": {}},
        "summary": {"state_size": {"min": 500000, "max": 2000000, "avg": 1000000}},
    }
    a, b = snapshots.checkpoint_stats(docs(spark, "job_id", full, {})).orderBy("job_id").collect()
    assert (a.completed, a.failed, a.total, a.latest_completed.duration_ms) == (42, 1, 43, 1500)
    assert a.latest_failed is None and tuple(a.size_summary) == (500000, 2000000, 1000000)
    assert (b.completed, b.total, b.latest_completed, b.size_summary) == (0, 0, None, None)


def test_exceptions(spark):
    many = {"root-exception": "r", "timestamp": 5, "all-exceptions": [{"exception": f"e{i}"} for i in range(12)]}
    got = snapshots.job_exceptions(docs(spark, "job_id", many, {})).orderBy("job_id", "pos").collect()
    assert [r.exception for r in got] == [f"e{i}" for i in range(12)] + [None]
    assert (got[0].root_exception, got[0].root_timestamp, got[12].root_exception) == ("r", 5, None)


def test_snapshots_that_do_not_parse_are_listed(spark):
    bad = ["{broken", "", '{"counts": 5}', '{"counts": {"completed": "x"}}', "[]"]
    frame = docs(spark, "job_id", *bad, {"counts": {"completed": 1}}, {}).union(spark.createDataFrame([("none", None)], "job_id string, value string"))
    found = {r.key: (r.kind, r.error, r.value) for r in snapshots.snapshot_errors(frame, "checkpoints", "job_id").collect()}
    read = {r.job_id: r.completed for r in snapshots.checkpoint_stats(frame).collect()}
    assert found["none"] == ("checkpoints", "missing", None) and found["k0"] == ("checkpoints", "malformed", "{broken")
    # Each document is either read or listed.
    assert set(found) | set(read) == {f"k{i}" for i in range(7)} | {"none"} and not set(found) & set(read)
    assert {"k0", "k2", "k3", "none"} <= set(found) and read["k5"] == 1 and read["k6"] == 0
    broken = docs(spark, "job_id", "{broken", {"all-exceptions": "x"}, {})
    assert [r.job_id for r in snapshots.job_exceptions(broken).collect()] == ["k2"]
    assert sorted(r.key for r in snapshots.snapshot_errors(broken, "exceptions", "job_id").collect()) == ["k0", "k1"]
    jobs = snapshots.snapshot_errors(docs(spark, "k", "{", {"jobs": []}), "jobs").collect()
    assert [tuple(r) for r in jobs] == [("jobs", None, "malformed", "{")]


def test_metric_results(spark):
    vector = {"status": "success", "data": {"resultType": "vector", "result": [
        {"metric": {"a": "b"}, "value": [1718000000, "42.5"]}]}}
    matrix = {"status": "success", "data": {"resultType": "matrix", "result": [
        {"metric": {}, "values": [[1, "1"], [2.5, "NaN"]]}] * 60}}
    frame = docs(spark, "query", vector, matrix, {"status": "error", "error": "bad"}, {"status": "error"}, "junk")
    got = snapshots.metric_results(frame).orderBy("query", "series", "timestamp").collect()
    assert tuple(got[0]) == ("k0", "vector", 1, 0, {"a": "b"}, 1718000000.0, "42.5", 42.5)
    assert len(got) == 1 + 60 * 2 and got[1].result_count == 60 and got[2].timestamp == 2.5
    errors = {r.query: r.error for r in snapshots.metric_errors(frame).collect()}
    assert errors == {"k2": "bad", "k3": "Unknown Prometheus error", "k4": "Unknown Prometheus error"}


def test_durations(spark):
    steps = {"5m": 5, "15m": 15, "60m": 60, "2h": 60, "1d": 300, "foo": 15, "1.5m": None}
    assert {k: durations.step_seconds(k) for k in steps} == steps
    seconds = {"90s": 90.0, "5m": 300.0, "2h": 7200.0, "1d": 86400.0, "foo": 900.0, "1.5m": 90.0}
    assert {k: durations.duration_seconds(k) for k in seconds} == seconds
    df = spark.createDataFrame([(k,) for k in {**steps, **seconds}], "t string")
    both = df.select("t", durations.step_seconds_column(F.col("t")), durations.duration_seconds_column(F.col("t")))
    for t, step, secs in both.collect():
        assert step == durations.step_seconds(t)
        if t in seconds:
            assert secs == seconds[t]


def samples(spark, rows):
    df = spark.createDataFrame(rows, "name string, host string, ts_ms long, value double")
    return df.withColumn("labels", F.create_map(F.lit("host"), "host")).drop("host")


def test_range_and_rate_against_a_model(spark):
    rng = random.Random(7)
    rows = [("m", rng.choice("ab"), rng.randrange(0, 400_000), float(rng.randint(0, 50))) for _ in range(150)]
    rows = list({(n, h, ts): (n, h, ts, v) for n, h, ts, v in rows}.values())
    start, end, step, stale = 50_000, 350_000, 15, 40
    grid = metrics.metric_range(samples(spark, rows), start, end, step, stale)
    got = {(json.loads(r.series)["host"], r.ts_ms): r.value for r in grid.collect()}
    want = {}
    for host in "ab":
        for t in range(start, end + 1, step * 1000):
            seen = [(ts, v) for _, h, ts, v in rows if h == host and t - stale * 1000 <= ts <= t]
            if seen:
                want[host, t] = max(seen)[1]
    assert got == want
    rates = metrics.metric_rate(metrics.counter_increase(samples(spark, rows)), start, end, step, 60)
    got = {(json.loads(r.series)["host"], r.ts_ms): r.rate for r in rates.collect()}
    want = {}
    for host in "ab":
        own = sorted((ts, v) for _, h, ts, v in rows if h == host)
        grown = [(own[0][0], 0.0)] + [(t, v - p if v >= p else v) for (_, p), (t, v) in zip(own, own[1:])]
        for t in range(start, end + 1, step * 1000):
            inside = [g for ts, g in grown if t - 60_000 < ts <= t]
            if inside:
                want[host, t] = sum(inside) / 60
    assert got == pytest.approx(want)


def test_latest_bands_and_difference(spark):
    df = samples(spark, [("a", "x", 1, 7.0), ("a", "x", 3, None), ("a", "x", 2, 4.0), ("b", "x", 2, 1.0)])
    got = {r.name: r for r in metrics.metric_bands(metrics.metric_latest(df), "restarts").collect()}
    assert (got["a"].last_value, got["a"].max_value, got["a"].last_ts_ms, got["a"].status) == (4.0, 7.0, 2, "yellow")
    assert got["b"].status == "yellow"
    values = spark.createDataFrame([(v,) for v in [-1.0, 0.0, 1.0, 4.9, 5.0, None]], "v double")
    band = metrics.band(F.col("v"), metrics.BANDS["restarts"])
    assert [r[0] for r in values.select(band).collect()] == ["green", "green", "yellow", "yellow", "red", None]
    grid = metrics.metric_range(df, 0, 4, 1, 10)
    out = metrics.series_minus(grid.filter("name = 'a'"), grid.filter("name = 'b'")).collect()
    assert out == []
    grid = metrics.metric_range(df, 0, 4000, 1, 10)
    out = metrics.series_minus(grid.filter("name = 'a'"), grid.filter("name = 'b'")).collect()
    assert {r.value for r in out} == {3.0} and len(out) == 4


def test_decode(spark):
    good = json.dumps({"event_id": "test-001", "source": "s", "metric": {"metric_name": "latency_ms", "value": 42.5}})
    rows = [(good,), ("garbage",), ("",), (None,)]
    records = spark.createDataFrame(rows, "value string").select(F.col("value").cast("binary").alias("value"))
    watch = Observation("decode")
    got = sorted(ev.decoded_events(ev.decode(records), watch).collect(), key=lambda r: r.event_id)
    assert [(r.event_id, r.timestamp_ms, r.source) for r in got] == [("", 0, ""), ("test-001", 0, "s")]
    assert got[0].metric is None and (got[1].metric.value, got[1].metric.component) == (42.5, "")
    assert watch.get == {"records": 4, "errors": 2}


def test_options_need_no_jar():
    source = ev.kafka_source_options("host:1", group="g", maxOffsetsPerTrigger="10")
    assert source["startingOffsets"] == "latest" and source["kafka.group.id"] == "g"
    assert source["maxOffsetsPerTrigger"] == "10"
    assert ev.kafka_sink_options("host:1")["topic"] == "stream-alerts"


def test_event_files(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    df, rows = topic(spark, [5])
    df.write.parquet(f"{folder}/events")
    assert ev.read_event_files(spark, f"{folder}/events").count() == len(rows)
    timed = ev.with_event_time(df, "5 seconds")
    assert timed.schema["event_time"].dataType == T.TimestampType()


def test_rules_are_checked():
    with pytest.raises(ValueError):
        Rules(ema_alpha=1.5)
    with pytest.raises(ValueError):
        Rules(hypothesis_mode="dice")


def test_rate_of_a_range_reads_that_range(spark, tmp_path):
    """The time reaches the scan; of what came before, one row per series is ordered."""
    rng = random.Random(8)
    rows = [("c", {"s": rng.choice("ab")}, t, float(rng.randint(0, 50))) for t in range(0, 200_000, 500)]
    samples(spark, rows).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    whole = metrics.metric_rate(metrics.counter_increase(stored), 100_000, 150_000, 10, 30)
    part = metrics.metric_rate(metrics.counter_increase(stored, None, 70_000, 150_000), 100_000, 150_000, 10, 30)
    assert sorted(map(str, part.collect())) == sorted(map(str, whole.collect())) and part.count() > 5
    kept = metrics.counter_increase(stored, None, 70_000, 150_000)
    assert {r.ts_ms for r in kept.collect()} == set(range(70_500, 150_001, 500))
    empty = metrics.counter_increase(stored, None, 900_000, 950_000)
    assert empty.collect() == []
