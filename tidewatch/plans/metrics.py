"""Metric queries and their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.durations import duration_seconds, step_seconds
from tidewatch.operators import metrics
from tidewatch.plans import adapters as a

_RANGE = "30d"
_END = a.RANGE_END_MS
_START = _END - int(duration_seconds(_RANGE) * 1000)
_STEP = step_seconds(_RANGE)
_RATE_STEP = step_seconds("720h")
_DAY_START = _START + 10 * 86_400_000
_DAY_END = _DAY_START + 86_400_000
_DAY_STEP, _DAY_WINDOW = step_seconds("1d"), 3600


def metric_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metric_latest(a.gauge_samples(spark, sf_dir))


def metric_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = a.gauge_samples(spark, sf_dir)
    return samples.select(
        "event_id",
        *[
            metrics.band(F.col("value"), metrics.BANDS[p]).alias(p)
            for p in ("restarts", "backpressure_ms_per_second", "failed_checkpoints", "task_managers")
        ],
        metrics.band(F.col("value") * 500, metrics.BANDS["job_uptime_ms"]).alias("job_uptime_ms"),
        metrics.band(F.col("value") * 100, metrics.BANDS["checkpoint_duration_ms"]).alias("checkpoint_duration_ms"),
    )


def latest_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metric_bands(metric_latest(spark, sf_dir), "restarts").select(
        "name", "series", "last_value", "status"
    )


def metric_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metric_range(a.gauge_samples(spark, sf_dir), _START, _END, _STEP)


def counter_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counter_increase(a.counter_samples(spark, sf_dir), ["ts_ms", "event_id"])


def metric_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = metrics.metric_rate(counter_increase(spark, sf_dir), _START, _END, _RATE_STEP)
    return rates.withColumn("rate", a.six_digits("rate"))


def metric_rate_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day in the middle of the log, in overlapping windows of an hour."""
    increases = metrics.counter_increase(
        a.counter_samples(spark, sf_dir), ["ts_ms", "event_id"], _DAY_START - _DAY_WINDOW * 1000, _DAY_END
    )
    rates = metrics.metric_rate(increases, _DAY_START, _DAY_END, _DAY_STEP, _DAY_WINDOW)
    return rates.withColumn("rate", a.six_digits("rate"))


def series_minus_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = metric_range(spark, sf_dir)
    out = metrics.series_minus(
        grid.filter(F.col("name") == "heap_usage_percent"), grid.filter(F.col("name") == "latency_ms")
    )
    return out.withColumn("value", a.six_digits("value"))


_GAUGES_SQL = f"""{a.TELEMETRY_SQL},
gauges AS (
  SELECT metric_name AS name, '{{"source":"' || source || '"}}' AS series, timestamp_ms AS ts_ms, event_id, value
  FROM telemetry WHERE metric_name IS NOT NULL)"""

_GRID_SQL = f"""{_GAUGES_SQL},
points AS (SELECT CAST({_START} + {_STEP * 1000} * p AS BIGINT) AS ts_ms
           FROM range(0, {(_END - _START) // (_STEP * 1000) + 1}) r(p)),
grid AS (
  SELECT g.name, g.series, p.ts_ms, arg_max(g.value, (g.ts_ms, g.value)) AS value
  FROM gauges g JOIN points p ON g.ts_ms <= p.ts_ms AND g.ts_ms >= p.ts_ms - {metrics.STALE_SECONDS * 1000}
  GROUP BY ALL)"""

_INCREASE_SQL = f"""{a.TELEMETRY_SQL},
increases AS (
  SELECT 'records_total' AS name, '{{"source":"' || source || '"}}' AS series, timestamp_ms AS ts_ms, event_id,
         CAST(event_id % {a.RESTART_EVERY} AS DOUBLE) AS value,
         CASE WHEN previous IS NULL THEN 0e0 WHEN event_id % {a.RESTART_EVERY} >= previous
              THEN CAST(event_id % {a.RESTART_EVERY} - previous AS DOUBLE)
              ELSE CAST(event_id % {a.RESTART_EVERY} AS DOUBLE) END AS increase
  FROM (SELECT *, lag(event_id % {a.RESTART_EVERY}) OVER (PARTITION BY source ORDER BY timestamp_ms, event_id)
                  AS previous FROM telemetry))"""

QUERIES = {
    "metric_latest": metric_latest,
    "metric_bands": metric_bands,
    "latest_bands": latest_bands,
    "metric_range": metric_range,
    "counter_increase": counter_increase,
    "metric_rate": metric_rate,
    "metric_rate_day": metric_rate_day,
    "series_minus_series": series_minus_series,
}

_LATEST_SQL = f"""{_GAUGES_SQL},
latest AS (
  SELECT name, series, arg_max(value, (ts_ms, value)) AS last_value, max(ts_ms) AS last_ts_ms, max(value) AS max_value
  FROM gauges GROUP BY ALL)"""

ORACLES = {
    "metric_latest": f"WITH {_LATEST_SQL} SELECT * FROM latest",
    "metric_bands": f"""WITH {_GAUGES_SQL}
        SELECT event_id, CASE WHEN value >= 5 THEN 'red' WHEN value >= 1 THEN 'yellow' ELSE 'green' END AS restarts,
               CASE WHEN value >= 500 THEN 'red' WHEN value >= 100 THEN 'yellow' ELSE 'green' END
                 AS backpressure_ms_per_second,
               CASE WHEN value >= 1 THEN 'red' ELSE 'green' END AS failed_checkpoints,
               CASE WHEN value >= 0 THEN 'red' ELSE 'green' END AS task_managers,
               CASE WHEN value * 500 >= 60000 THEN 'green' ELSE 'red' END AS job_uptime_ms,
               CASE WHEN value * 100 >= 30000 THEN 'red' WHEN value * 100 >= 5000 THEN 'yellow' ELSE 'green' END
                 AS checkpoint_duration_ms
        FROM gauges""",
    "latest_bands": f"""WITH {_LATEST_SQL}
        SELECT name, series, last_value,
               CASE WHEN last_value >= 5 THEN 'red' WHEN last_value >= 1 THEN 'yellow' ELSE 'green' END AS status
        FROM latest""",
    "metric_range": f"WITH {_GRID_SQL} SELECT name, series, ts_ms, value FROM grid",
    "counter_increase": f"WITH {_INCREASE_SQL} SELECT name, series, ts_ms, event_id, value, increase FROM increases",
    "metric_rate": f"""WITH {_INCREASE_SQL}
        SELECT name, series, CAST({_START} + {_RATE_STEP * 1000} * p AS BIGINT) AS ts_ms,
               {a.sql_six_digits("sum(increase) / 60")} AS rate
        FROM increases JOIN range(0, {(_END - _START) // (_RATE_STEP * 1000) + 1}) r(p)
          ON ts_ms <= {_START} + {_RATE_STEP * 1000} * p AND ts_ms > {_START} + {_RATE_STEP * 1000} * p - 60000
        GROUP BY ALL""",
    "metric_rate_day": f"""WITH {_INCREASE_SQL}
        SELECT name, series, CAST({_DAY_START} + {_DAY_STEP * 1000} * p AS BIGINT) AS ts_ms,
               {a.sql_six_digits(f"sum(increase) / {_DAY_WINDOW}")} AS rate
        FROM increases JOIN range(0, {(_DAY_END - _DAY_START) // (_DAY_STEP * 1000) + 1}) r(p)
          ON ts_ms <= {_DAY_START} + {_DAY_STEP * 1000} * p AND ts_ms > {_DAY_START - _DAY_WINDOW * 1000} + {_DAY_STEP * 1000} * p
        GROUP BY ALL""",
    "series_minus_series": f"""WITH {_GRID_SQL}
        SELECT h.series, h.ts_ms, {a.sql_six_digits("h.value - l.value")} AS value
        FROM grid h JOIN grid l ON h.series = l.series AND h.ts_ms = l.ts_ms
        WHERE h.name = 'heap_usage_percent' AND l.name = 'latency_ms'""",
}
