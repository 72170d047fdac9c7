"""Streams over the given tables, run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import detect
from tidewatch.operators.ordered import checkpoint_dir
from tidewatch.plans import adapters, alerts, incidents
from tidewatch.streaming import detector, reorder, sinks
from tidewatch.streaming.incidents import track_incidents_stream

_MICRO_BATCH = 256 << 20
# The events of a month arrive in eighths, of which every two are exchanged.
_PARTS = 8
_PART_MS = 30 * 86_400_000 // _PARTS
_DELAY = "8 days"


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same alerts as the batch, by way of keyed state and an exactly-once file sink.

    Rows are taken by event time within a micro-batch and by arrival of their files across micro-batches, so of a table
    larger than one micro-batch the files have to arrive in time order.
    """
    static = adapters.table(spark, sf_dir, "events")
    arriving = (
        spark.readStream.schema(static.schema)
        .option("maxBytesPerTrigger", str(_MICRO_BATCH))
        # As a pattern the path may be one file or a folder of part files.
        .parquet(f"{sf_dir}/events.parque[t]")
    )
    run = _folder(spark)
    found = detector.detect_alerts_stream(adapters.as_telemetry(arriving))
    sinks.write_alert_files(found, f"{run}/alerts", f"{run}/checkpoint", once=True).awaitTermination()
    return alerts.rounded(spark.read.schema(found.schema).parquet(f"{run}/alerts"))


def _arriving(parts: list[DataFrame], run: str) -> DataFrame:
    """A stream that gets one part per micro-batch, in the given order."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    files = parts[0].rdd.getNumPartitions()
    for i, part in enumerate(parts):
        part.repartition(files).write.parquet(f"{run}/in/{i:03d}")
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files)
    return reader.parquet(f"{run}/in")


def _result(stream: DataFrame, run: str, name: str) -> DataFrame:
    sinks.write_alert_files(stream, f"{run}/out", f"{run}/state", name, once=True).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{run}/out")


def _part() -> F.Column:
    return F.least(F.lit(_PARTS - 1), F.floor((F.col("timestamp_ms") - adapters.RANGE_START_MS) / _PART_MS))


def _exchanged(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    telemetry = adapters.telemetry(spark, sf_dir)
    return [telemetry.filter(_part() == (i ^ 1)) for i in range(_PARTS)]


def stream_alerts_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts out of time order, taken in the order of their arrival."""
    run = _folder(spark)
    found = detector.detect_alerts_stream(_arriving(_exchanged(spark, sf_dir), run))
    return alerts.rounded(_result(found, run, "arrival"))


def stream_alerts_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts out of time order, held back until the watermark has passed them: the alerts of the batch."""
    parts = _exchanged(spark, sf_dir)
    # A last event of a series of its own moves the watermark beyond all others.
    empty = F.create_map().cast("map<string,string>")
    metric = F.struct(
        F.lit("tick").alias("metric_name"), F.lit(0.0).alias("value"), F.lit("").alias("unit"),
        F.lit("tick").alias("component"), empty.alias("tags"),
    )
    end_ms = adapters.RANGE_END_MS + 60 * 86_400_000
    end = {"event_id": F.lit(-1), "timestamp_ms": F.lit(end_ms), "source": F.lit("tick"), "metric": metric}
    fields = parts[0].schema.fields
    tick = spark.range(1).select(
        *[end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )
    run = _folder(spark)
    found = reorder.detect_alerts_in_order(_arriving([*parts, tick], run), _DELAY)
    return alerts.rounded(_result(found, run, "reordered"))


def stream_alerts_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert lines of a sink that repeats every second batch, read back once each."""
    lines = detect.alert_json(detect.detect_alerts(adapters.telemetry(spark, sf_dir)))
    run = _folder(spark)
    lines.write.parquet(f"{run}/sent")
    sent = spark.read.schema(lines.schema).parquet(f"{run}/sent").select("value")
    batches = [sent.filter(F.pmod(F.xxhash64("value"), F.lit(3)) == i) for i in (0, 1, 0, 2, 1)]
    found = sinks.read_alerts_once(_arriving(batches, run), "60 days")
    return _result(found, run, "once").select(F.col("component").alias("key"), "value")


def incident_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The life of incidents from a stream of detections, a third of the month at a time."""
    run = _folder(spark)
    detections = incidents.detections(spark, sf_dir)
    detections.write.parquet(f"{run}/detections")
    settled = spark.read.schema(detections.schema).parquet(f"{run}/detections")
    first = adapters.RANGE_START_MS // 3_600_000
    third = F.least(F.lit(2), F.floor((F.col("cycle") - first) / 240))
    stream = track_incidents_stream(_arriving([settled.filter(third == i) for i in range(3)], run), incidents.RULES)
    return _result(stream, run, "incidents")


QUERIES = {
    "stream_alerts": stream_alerts,
    "stream_alerts_arrival": stream_alerts_arrival,
    "stream_alerts_reordered": stream_alerts_reordered,
    "stream_alerts_once": stream_alerts_once,
    "incident_state": incident_state,
}

_ARRIVAL_SQL = f"xor(CAST(least({_PARTS - 1}, (timestamp_ms - {adapters.RANGE_START_MS}) // {_PART_MS}) AS BIGINT), 1)"

ORACLES = {
    "stream_alerts": alerts.ORACLES["all_alerts"],
    "stream_alerts_arrival": alerts.ORACLES["all_alerts"].replace(
        "ORDER BY timestamp_ms, event_id", f"ORDER BY {_ARRIVAL_SQL}, timestamp_ms, event_id"
    ),
    "stream_alerts_reordered": alerts.ORACLES["all_alerts"],
    "stream_alerts_once": f"SELECT DISTINCT * FROM ({alerts.ORACLES['alert_json']})",
    "incident_state": incidents.ORACLES["incident_lifecycle"],
}
