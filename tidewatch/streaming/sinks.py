"""Running streams: sinks, triggers, recovery and the lag of a stream itself."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidewatch.operators.detect import alert_json
from tidewatch.schema import ALERT
from tidewatch.sources.audit import audit_batch_writer

CHECKPOINT_SECONDS = 30
#: State is cut into this many partitions per core; each costs every micro-batch a fraction of a second.
STATE_PARTITIONS_PER_CORE = 2
_PARTITIONS = "spark.sql.shuffle.partitions"


def _start(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Start with as many partitions as the cores can use: a stream keeps the number of its first start for good.

    A query takes a copy of the settings when it starts, so those of the session are as before after it.
    """
    before = spark.conf.get(_PARTITIONS)
    enough = STATE_PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism
    spark.conf.set(_PARTITIONS, str(min(int(before), enough)))
    try:
        return writer.start()
    finally:
        spark.conf.set(_PARTITIONS, before)


def _writer(df: DataFrame, name: str, checkpoint: str, once: bool) -> DataStreamWriter:
    """A named query with its own checkpoint folder, so that a restart finds its state."""
    writer = df.writeStream.queryName(name).outputMode("append").option("checkpointLocation", f"{checkpoint}/{name}")
    if once:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{CHECKPOINT_SECONDS} seconds")


def write_alert_files(
    alerts: DataFrame, path: str, checkpoint: str, name: str = "alerts", once: bool = False
) -> StreamingQuery:
    """Alerts as parquet; the file sink keeps each alert exactly once."""
    return _start(_writer(alerts, name, checkpoint, once).format("parquet").option("path", path), alerts.sparkSession)


def write_alert_json(
    alerts: DataFrame, path: str, checkpoint: str, name: str = "alert_json", once: bool = False
) -> StreamingQuery:
    """Alerts as lines of six-field JSON."""
    lines = alert_json(alerts).select("value")
    return _start(_writer(lines, name, checkpoint, once).format("text").option("path", path), alerts.sparkSession)


def write_alert_topic(
    alerts: DataFrame, options: dict[str, str], checkpoint: str, name: str = "alert_topic", once: bool = False
) -> StreamingQuery:
    """Alerts to Kafka, at least once (needs the Kafka jar)."""
    return _start(_writer(alert_json(alerts), name, checkpoint, once).format("kafka").options(**options), alerts.sparkSession)


def read_alerts_once(lines: DataFrame, delay: str) -> DataFrame:
    """Alerts from lines of six-field JSON, each once, however often an at-least-once sink has sent it.

    ``lines`` is a stream of (value). A repeated line is one that agrees in all
    six fields; what is known of earlier lines is kept until the watermark, which
    ``delay`` holds back, has passed them. A line that is no alert is left out.
    """
    alert = F.from_json("value", ALERT)
    parsed = lines.select("value", alert.alias("a")).filter(F.col("a.rule").isNotNull() & F.col("a.timestamp_ms").isNotNull())
    timed = parsed.select("value", "a.*", F.timestamp_millis("a.timestamp_ms").alias("event_time"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(ALERT.names).drop("event_time")


def write_audit_stream(
    entries: DataFrame, path: str, checkpoint: str, name: str = "audit", once: bool = False
) -> StreamingQuery:
    return _writer(entries, name, checkpoint, once).foreachBatch(audit_batch_writer(path)).start()


def offsets_from_progress(spark: SparkSession, progress: dict[str, Any], group: str) -> DataFrame:
    """(group, topic, partition, committed, high) of a running Kafka query, for the lag operators.

    A progress report has one source per topic subscription and one number per
    partition.
    """

    def offsets(value: Any) -> dict[str, dict[str, int]]:
        return json.loads(value) if isinstance(value, str) else (value or {})

    rows = []
    for source in progress.get("sources", []):
        done, latest = offsets(source.get("endOffset")), offsets(source.get("latestOffset"))
        for topic, partitions in latest.items():
            for partition, high in partitions.items():
                committed = done.get(topic, {}).get(partition, -1)
                rows.append((group, topic, int(partition), int(committed), int(high)))
    return spark.createDataFrame(rows, "group string, topic string, partition int, committed long, high long")
