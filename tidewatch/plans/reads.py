"""Log reads, lag and service snapshots, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import lag, tail
from tidewatch.plans import adapters as a
from tidewatch.sources import events as event_source
from tidewatch.sources import snapshots


def _flat_events(events: DataFrame) -> DataFrame:
    return events.select(
        "partition",
        "offset",
        "timestamp_ms",
        "event_id",
        "source",
        F.col("metric.metric_name").alias("metric_name"),
        F.col("metric.value").alias("value"),
        F.col("log.severity").alias("severity"),
        F.col("log.message").alias("message"),
    )


def _wide_events(events: DataFrame) -> DataFrame:
    """Also what the flat view leaves out: texts and map entries of the payloads."""
    return events.select(
        "partition", "offset", "timestamp_ms", "event_id", "source",
        F.col("metric.metric_name").alias("metric_name"), F.col("metric.value").alias("value"),
        F.col("metric.unit").alias("unit"), F.try_element_at("metric.tags", F.lit("source")).alias("tag"),
        F.col("log.severity").alias("severity"), F.col("log.message").alias("message"),
        F.col("log.logger_name").alias("logger_name"), F.try_element_at("log.context", F.lit("type")).alias("context"),
    )


def recent_events_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_events(tail.recent_events(a.telemetry(spark, sf_dir)))


def recent_events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_events(tail.recent_events(a.telemetry(spark, sf_dir), 60, "Metric"))


def search_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tail.search_logs(a.telemetry(spark, sf_dir), "POLL Timeout", 30)
    return found.select("partition", "offset", "timestamp_ms", "source", "severity", "message", "component")


def search_logs_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tail.search_logs(a.telemetry(spark, sf_dir), "", 100, severity="info", component="SVC-3")
    return found.select("partition", "offset", "timestamp_ms", "source", "severity", "message", "component")


def search_logs_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tail.search_summary(a.telemetry(spark, sf_dir), "OutOfMemory", 10)


def search_logs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match in the log, however far back."""
    found = tail.search_logs(a.telemetry(spark, sf_dir), "OutOfMemory", None, severity="error", component="svc-3")
    return found.select("partition", "offset", "timestamp_ms", "source", "severity", "message", "component")


def search_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over raw messages, which scans those that don't decode as well."""
    decoded = event_source.decode(a.wire_messages(spark, sf_dir), protobuf=True)
    return tail.search_summary(event_source.messages(decoded), "poll timeout", 25)


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.offset_snapshots(spark, sf_dir)


def consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = _offsets(spark, sf_dir)
    return lag.consumer_lag(offsets.select("topic", "partition", "high"), offsets, a.GROUP)


def consumer_lag_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lag.total_lag(consumer_lag(spark, sf_dir))


def topic_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lag.topic_throughput(_offsets(spark, sf_dir), 64)


def topic_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lag.topic_partitions(_offsets(spark, sf_dir))


def job_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = snapshots.job_overview(a.job_snapshots(spark, sf_dir))
    return jobs.select(
        "job_id", "name", "state", "start_time", "duration_ms",
        F.try_element_at("tasks", F.lit("running")).alias("running"), F.size("tasks").alias("task_states"),
    )


def checkpoint_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = snapshots.checkpoint_stats(a.checkpoint_snapshots(spark, sf_dir))
    return stats.select(
        "job_id", "completed", "failed", "in_progress", "restored", "total",
        F.col("latest_completed.id").alias("completed_id"),
        F.col("latest_completed.duration_ms").alias("duration_ms"),
        F.col("latest_completed.size_bytes").alias("size_bytes"),
        F.col("latest_completed.trigger_timestamp").alias("trigger_timestamp"),
        F.col("latest_failed.id").alias("failed_id"),
        F.col("latest_failed.failure_message").alias("failure_message"),
        F.col("size_summary.min").alias("size_min"),
        F.col("size_summary.max").alias("size_max"),
        F.col("size_summary.avg").alias("size_avg"),
    )


def job_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.job_exceptions(a.exception_snapshots(spark, sf_dir))


def snapshot_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snapshots.snapshot_errors(a.job_snapshots(spark, sf_dir), "jobs")
    for kind, documents in (("checkpoints", a.checkpoint_snapshots), ("exceptions", a.exception_snapshots)):
        found = found.unionByName(snapshots.snapshot_errors(documents(spark, sf_dir), kind, "job_id"))
    # Whole documents, in short: how they begin, and their length (of jobs, whose text the SQL repeats).
    chars = F.when(F.col("kind") == "jobs", F.length("value"))
    return found.select("kind", "key", "error", chars.alias("chars"), F.substring("value", 1, 2).alias("start"))


def metric_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = snapshots.metric_results(a.metric_snapshots(spark, sf_dir))
    return points.withColumn("task", F.try_element_at("labels", F.lit("task"))).drop("labels")


def metric_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.metric_errors(a.metric_snapshots(spark, sf_dir))


def decode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = event_source.decode(a.event_messages(spark, sf_dir))
    return _flat_events(event_source.decoded_events(decoded))


def decode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_source.decode(a.event_messages(spark, sf_dir)).agg(
        F.count("*").alias("records"), F.count_if(F.col("event").isNull()).alias("errors")
    )


def decode_protobuf(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = event_source.decode(a.wire_messages(spark, sf_dir), protobuf=True)
    return _wide_events(event_source.decoded_events(decoded, "decode_protobuf"))


def decode_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = event_source.decode(a.wire_messages(spark, sf_dir, mixed=True), protobuf=True, fallback=True)
    return _wide_events(event_source.decoded_events(decoded, "decode_fallback"))


def decode_protobuf_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_source.decode(a.wire_messages(spark, sf_dir), protobuf=True).agg(
        F.count("*").alias("records"), F.count_if(F.col("event").isNull()).alias("errors")
    )


def _tail_sql(total: int, extra: int) -> str:
    return f"""
tail AS (
  SELECT t.* FROM telemetry t JOIN (SELECT partition, max("offset") + 1 AS high FROM telemetry GROUP BY partition) h
    USING (partition)
  WHERE "offset" >= greatest(0, high - (SELECT {total} // count(DISTINCT partition) + {extra} FROM telemetry)))"""


_FLAT = 'partition, "offset", timestamp_ms, event_id, source, metric_name, '
_FLAT += "CASE WHEN metric_name IS NOT NULL THEN value END AS value, severity, "
_FLAT += "CASE WHEN severity IS NOT NULL THEN message END AS message"


def _scan_sql(match: str, n: int | None) -> str:
    """All events up to the n-th match, in the order of the log."""
    return f"""{a.TELEMETRY_SQL},
scanned AS (
  SELECT * FROM (
    SELECT *, sum(is_match) OVER (ORDER BY timestamp_ms, partition, "offset" ROWS BETWEEN UNBOUNDED PRECEDING
                                  AND 1 PRECEDING) AS seen
    FROM (SELECT *, CASE WHEN severity IS NOT NULL AND {match} THEN 1 ELSE 0 END AS is_match FROM telemetry))
  WHERE {"true" if n is None else f"coalesce(seen, 0) < {n}"})"""


def _summary_sql(pattern: str, n: int) -> str:
    return f"""SELECT '{pattern}' AS pattern, count(*) AS messages_scanned, CAST(sum(is_match) AS BIGINT) AS match_count,
        sum(is_match) >= {n} AS partial FROM scanned"""


_ERROR_SQL = "event_id % 50 = 0 OR (event_id % 51 <> 0 AND event_id % 53 = 0)"

QUERIES = {
    "recent_events_tail": recent_events_tail,
    "recent_events_by_type": recent_events_by_type,
    "search_logs": search_logs,
    "search_logs_filtered": search_logs_filtered,
    "search_logs_summary": search_logs_summary,
    "search_logs_all": search_logs_all,
    "search_messages": search_messages,
    "consumer_lag": consumer_lag,
    "consumer_lag_total": consumer_lag_total,
    "topic_throughput": topic_throughput,
    "topic_partitions": topic_partitions,
    "job_overview": job_overview,
    "checkpoint_stats": checkpoint_stats,
    "job_exceptions": job_exceptions,
    "snapshot_errors": snapshot_errors,
    "metric_results": metric_results,
    "metric_errors": metric_errors,
    "decode_events": decode_events,
    "decode_errors": decode_errors,
    "decode_protobuf": decode_protobuf,
    "decode_protobuf_errors": decode_protobuf_errors,
    "decode_fallback": decode_fallback,
}

_WIDE_SQL = f"""
        SELECT partition, "offset", CASE WHEN empty THEN 0 ELSE timestamp_ms END AS timestamp_ms,
               CASE WHEN empty THEN '' ELSE CAST(event_id AS VARCHAR) END AS event_id,
               CASE WHEN empty THEN '' ELSE source END AS source,
               CASE WHEN NOT empty THEN metric_name END AS metric_name,
               CASE WHEN NOT empty AND metric_name IS NOT NULL THEN value END AS value,
               CASE WHEN NOT empty THEN CASE metric_name WHEN 'latency_ms' THEN 'ms' WHEN 'heap_usage_percent' THEN 'percent' END
                 END AS unit,
               CASE WHEN NOT empty AND metric_name IS NOT NULL THEN source END AS tag,
               CASE WHEN NOT empty THEN severity END AS severity,
               CASE WHEN NOT empty AND severity IS NOT NULL THEN message END AS message,
               CASE WHEN NOT empty AND severity IS NOT NULL THEN 'worker' END AS logger_name,
               CASE WHEN NOT empty AND severity IS NOT NULL THEN event_type END AS context
        FROM (SELECT *, event_id % 51 = 0 AS empty FROM telemetry JOIN (SELECT event_id, event_type FROM events) USING (event_id))
        WHERE NOT ({_ERROR_SQL})"""

_MATCH_COLUMNS = 'partition, "offset", timestamp_ms, source, severity, message, source AS component'
_LAG_SQL = """
lag AS (
  SELECT "group", topic, partition, greatest(0, committed) AS committed_offset, high AS latest_offset,
         greatest(0, high - greatest(0, committed)) AS lag
  FROM offsets)"""

ORACLES = {
    "recent_events_tail": f"""WITH {a.TELEMETRY_SQL},{_tail_sql(20, 1)}
        SELECT {_FLAT} FROM tail ORDER BY timestamp_ms DESC, partition DESC, "offset" DESC LIMIT 20""",
    "recent_events_by_type": f"""WITH {a.TELEMETRY_SQL},{_tail_sql(60, 1)}
        SELECT {_FLAT} FROM tail WHERE metric_name IS NOT NULL
        ORDER BY timestamp_ms DESC, partition DESC, "offset" DESC LIMIT 60""",
    "search_logs": f"""WITH {_scan_sql("contains(lower(message), 'poll timeout')", 30)}
        SELECT {_MATCH_COLUMNS} FROM scanned WHERE is_match = 1""",
    "search_logs_filtered": f"""WITH {_scan_sql("severity = 2 AND source = 'svc-3'", 100)}
        SELECT {_MATCH_COLUMNS} FROM scanned WHERE is_match = 1""",
    "search_logs_summary": f"""WITH {_scan_sql("contains(lower(message), 'outofmemory')", 10)}
        {_summary_sql("OutOfMemory", 10)}""",
    "search_logs_all": f"""WITH {_scan_sql("contains(lower(message), 'outofmemory') AND severity = 4 AND source = 'svc-3'", None)}
        SELECT {_MATCH_COLUMNS} FROM scanned WHERE is_match = 1""",
    "search_messages": f"""WITH {_scan_sql(f"contains(lower(message), 'poll timeout') AND event_id % 51 <> 0 AND NOT ({_ERROR_SQL})", 25)}
        {_summary_sql("poll timeout", 25)}""",
    "consumer_lag": f"WITH {a.TELEMETRY_SQL},{a.OFFSETS_SQL},{_LAG_SQL} SELECT * FROM lag",
    "consumer_lag_total": f"""WITH {a.TELEMETRY_SQL},{a.OFFSETS_SQL},{_LAG_SQL}
        SELECT "group", topic, CAST(sum(lag) AS BIGINT) AS total_lag, count(*) AS partitions FROM lag GROUP BY ALL""",
    "topic_throughput": f"""WITH {a.TELEMETRY_SQL},{a.OFFSETS_SQL}
        SELECT topic, count(*) AS partition_count, CAST(sum(high - low) AS BIGINT) AS total_messages,
               round_even(sum(high - low) / 64e0, 2) AS estimated_rate_per_second,
               CAST(64 AS BIGINT) AS sample_window_seconds
        FROM offsets GROUP BY topic""",
    "topic_partitions": f"""WITH {a.TELEMETRY_SQL},{a.OFFSETS_SQL}
        SELECT topic, partition, low AS low_watermark, high AS high_watermark, high - low AS message_count FROM offsets""",
    "job_overview": """
        SELECT 'job-' || o_orderkey AS job_id, o_orderpriority AS name,
               CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'FINISHED' ELSE 'FAILED' END AS state,
               epoch_ms(o_orderdate) AS start_time, CAST(floor(o_totalprice) AS BIGINT) AS duration_ms,
               CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % 5 END AS running,
               CAST(CASE WHEN o_orderkey % 7 <> 0 THEN 2 ELSE 0 END AS INTEGER) AS task_states
        FROM orders WHERE o_orderkey % 10 <> 0 AND NOT """ + a.SNAPSHOT_ERROR_SQL,
    "checkpoint_stats": """
        SELECT 'job-' || o_orderkey AS job_id, o_orderkey % 50 AS completed,
               CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey % 3 ELSE 0 END AS failed,
               CAST(0 AS BIGINT) AS in_progress, CAST(0 AS BIGINT) AS restored,
               CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 50 + o_custkey % 3 ELSE 0 END AS total,
               CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END AS completed_id,
               CASE WHEN o_orderstatus <> 'F' THEN o_orderkey % 2000 END AS duration_ms,
               CASE WHEN o_orderstatus <> 'F' THEN CAST(floor(o_totalprice) AS BIGINT) END AS size_bytes,
               CASE WHEN o_orderstatus <> 'F' THEN epoch_ms(o_orderdate) END AS trigger_timestamp,
               CASE WHEN o_orderstatus = 'P' THEN o_orderkey END AS failed_id,
               CASE WHEN o_orderstatus = 'P' THEN 'timed out' END AS failure_message,
               CASE WHEN o_orderkey % 2 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) - 1 END AS size_min,
               CASE WHEN o_orderkey % 2 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) + 1 END AS size_max,
               CASE WHEN o_orderkey % 2 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS size_avg
        FROM orders WHERE NOT """ + a.SNAPSHOT_ERROR_SQL,
    "job_exceptions": """
        SELECT 'job-' || o_orderkey AS job_id,
               CASE WHEN o_orderkey % 13 > 0 THEN 'java.lang.OutOfMemoryError: Java heap space' END AS root_exception,
               CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey END AS root_timestamp,
               CAST(i - 1 AS INTEGER) AS pos, 'error ' || i AS exception,
               CASE WHEN i IS NOT NULL THEN 'task-' || (o_orderkey % 4) END AS task,
               CASE WHEN i IS NOT NULL THEN 'host:1' END AS location, o_orderkey * 100 + i AS timestamp
        FROM orders LEFT JOIN range(1, 13) r(i) ON i <= o_orderkey % 13 WHERE NOT """ + a.SNAPSHOT_ERROR_SQL,
    "snapshot_errors": f"""
        WITH jobs AS (
          SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN '{{"jobs":[]}}' ELSE to_json({{jobs: [struct_pack(
              jid := 'job-' || o_orderkey, name := o_orderpriority,
              state := CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'FINISHED' ELSE 'FAILED' END,
              "start-time" := epoch_ms(o_orderdate), duration := CAST(floor(o_totalprice) AS BIGINT),
              tasks := {{running: o_custkey % 5, finished: o_orderkey % 3}})]}}) END AS doc, o_orderkey % 7 = 0 AS bare
          FROM orders),
        broken AS (
          SELECT 'jobs' AS kind, CAST(NULL AS VARCHAR) AS "key", k,
                 CASE WHEN bare AND k % 10 <> 0 THEN regexp_replace(doc, ',"tasks":[{{][^}}]*[}}]', '') ELSE doc END AS doc FROM jobs
          UNION ALL
          SELECT 'checkpoints', 'job-' || o_orderkey, o_orderkey, NULL FROM orders
          UNION ALL
          SELECT 'exceptions', 'job-' || o_orderkey, o_orderkey, NULL FROM orders)
        SELECT b.kind, b."key", CASE WHEN k % 19 = 0 THEN 'malformed' ELSE 'missing' END AS error,
               CASE WHEN k % 19 = 0 THEN CAST(length(doc) - 1 AS INTEGER) END AS chars,
               CASE WHEN k % 19 = 0 THEN '{{"' END AS start
        FROM broken b WHERE k % 19 = 0 OR k % 23 = 0""",
    "metric_results": """
        WITH counted AS (
          SELECT o_orderkey AS k, CASE WHEN o_orderkey % 1000 = 0 THEN 55 ELSE o_orderkey % 3 END AS n
          FROM orders WHERE o_orderkey % 17 <> 0)
        SELECT 'q-' || k AS query, CASE WHEN k % 2 = 0 THEN 'matrix' ELSE 'vector' END AS result_type,
               CAST(n AS INTEGER) AS result_count, CAST(i - 1 AS INTEGER) AS series,
               CAST(k + 15 * p AS DOUBLE) AS timestamp, (i + p) || '.5' AS value,
               CAST(i + p AS DOUBLE) + 5e-1 AS number, 't' || i AS task
        FROM counted LEFT JOIN range(1, 56) r(i) ON i <= n
        LEFT JOIN range(0, 2) s(p) ON i IS NOT NULL AND (p = 0 OR k % 2 = 0)""",
    "metric_errors": """
        SELECT 'q-' || o_orderkey AS query,
               CASE WHEN o_orderkey % 34 = 0 THEN 'bad query' ELSE 'Unknown Prometheus error' END AS error
        FROM orders WHERE o_orderkey % 17 = 0""",
    "decode_events": f"""WITH {a.TELEMETRY_SQL}
        SELECT partition, "offset", CASE WHEN event_id % 51 = 0 THEN 0 ELSE timestamp_ms END AS timestamp_ms,
               CASE WHEN event_id % 51 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS event_id,
               CASE WHEN event_id % 51 = 0 THEN '' ELSE source END AS source,
               CASE WHEN event_id % 51 <> 0 THEN metric_name END AS metric_name,
               CASE WHEN event_id % 51 <> 0 AND metric_name IS NOT NULL THEN value END AS value,
               CASE WHEN event_id % 51 <> 0 THEN severity END AS severity,
               CASE WHEN event_id % 51 <> 0 AND severity IS NOT NULL THEN message END AS message
        FROM telemetry WHERE NOT ({_ERROR_SQL})""",
    "decode_protobuf": f"WITH {a.TELEMETRY_SQL} {_WIDE_SQL}",
    "decode_fallback": f"WITH {a.TELEMETRY_SQL} {_WIDE_SQL}",
    "decode_protobuf_errors": f"SELECT count(*) AS records, count(*) FILTER (WHERE {_ERROR_SQL}) AS errors FROM events",
    "decode_errors": f"SELECT count(*) AS records, count(*) FILTER (WHERE {_ERROR_SQL}) AS errors FROM events",
}
