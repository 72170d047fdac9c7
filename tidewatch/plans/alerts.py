"""Alert queries and their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import detect
from tidewatch.plans.adapters import TELEMETRY_SQL, six_digits, sql_six_digits, telemetry


def rounded(alerts: DataFrame) -> DataFrame:
    """Baselines agree to rounding of the last digits only."""
    return alerts.withColumn("threshold", six_digits("threshold")).withColumn("actual", six_digits("actual"))


def threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(detect.threshold_alerts(telemetry(spark, sf_dir, "metric")))


def ewma_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.ewma_baseline(telemetry(spark, sf_dir, "metric")).select(
        "event_id",
        "series_key",
        "samples",
        six_digits("mean").alias("mean"),
        six_digits("variance").alias("variance"),
    )


def deviation_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(detect.deviation_alerts(telemetry(spark, sf_dir, "metric")))


def log_error_rate_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(detect.log_error_rate_alerts(telemetry(spark, sf_dir, "log")))


def all_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(detect.detect_alerts(telemetry(spark, sf_dir)))


def alert_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.alert_json(detect.detect_alerts(telemetry(spark, sf_dir)))


def alerts_per_component_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = detect.alerts_per_component_hour(detect.detect_alerts(telemetry(spark, sf_dir)))
    return hourly.withColumn("max_actual", six_digits("max_actual"))


THRESHOLD_SQL = """
threshold_alerts AS (
  SELECT event_id, metric_name || '_threshold' AS rule, source AS component,
         CASE metric_name WHEN 'latency_ms' THEN 2e2 ELSE 8.5e1 END AS threshold, value AS actual, timestamp_ms,
         'CRITICAL' AS severity
  FROM telemetry
  WHERE metric_name IS NOT NULL AND value > CASE metric_name WHEN 'latency_ms' THEN 2e2 ELSE 8.5e1 END)"""

EWMA_SQL = """
m AS (
  SELECT event_id, timestamp_ms, source, metric_name, value, source || '|' || metric_name AS series_key,
         row_number() OVER (PARTITION BY source, metric_name ORDER BY timestamp_ms, event_id) AS rn
  FROM telemetry WHERE metric_name IS NOT NULL),
ewma AS (
  SELECT series_key, rn, event_id, timestamp_ms, source, metric_name, value,
         value AS mean, 0e0 AS variance, CAST(NULL AS DOUBLE) AS old_mean, CAST(NULL AS DOUBLE) AS old_variance
  FROM m WHERE rn = 1
  UNION ALL
  SELECT m.series_key, m.rn, m.event_id, m.timestamp_ms, m.source, m.metric_name, m.value,
         e.mean + 1e-1 * (m.value - e.mean),
         9e-1 * (e.variance + 1e-1 * (m.value - e.mean) * (m.value - e.mean)), e.mean, e.variance
  FROM ewma e JOIN m ON m.series_key = e.series_key AND m.rn = e.rn + 1)"""

DEVIATION_SQL = """
deviation_alerts AS (
  SELECT event_id, metric_name || '_baseline_deviation' AS rule, source AS component, old_mean AS threshold,
         value AS actual, timestamp_ms, 'WARNING' AS severity
  FROM ewma
  WHERE rn > 20 AND sqrt(old_variance) > 1e-9 AND abs(value - old_mean) > 3e0 * sqrt(old_variance))"""

ERROR_RATE_SQL = """
error_rates AS (
  SELECT event_id, source, timestamp_ms, count(*) OVER w AS total,
         sum(CASE WHEN severity >= 3 THEN 1 ELSE 0 END) OVER w AS errors
  FROM telemetry WHERE severity IS NOT NULL
  WINDOW w AS (PARTITION BY source ORDER BY timestamp_ms, event_id ROWS UNBOUNDED PRECEDING)),
error_rate_alerts AS (
  SELECT event_id, 'error_rate_high' AS rule, source AS component, 2e-1 AS threshold,
         CAST(errors AS DOUBLE) / total AS actual, timestamp_ms, 'CRITICAL' AS severity
  FROM error_rates WHERE total > 10 AND CAST(errors AS DOUBLE) / total > 2e-1)"""

ALL_ALERTS_SQL = f"""{TELEMETRY_SQL},{THRESHOLD_SQL},{EWMA_SQL},{DEVIATION_SQL},{ERROR_RATE_SQL},
alerts AS (
  SELECT * FROM threshold_alerts UNION ALL SELECT * FROM deviation_alerts UNION ALL SELECT * FROM error_rate_alerts)"""

_ALERT_COLUMNS = f"""event_id, rule, component, {sql_six_digits("threshold")} AS threshold,
  {sql_six_digits("actual")} AS actual, timestamp_ms, severity"""


def sql_two_decimals(x: str) -> str:
    """Two decimals, half up on the shortest decimal form."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DECIMAL(38, 2))"


QUERIES = {
    "threshold_alerts": threshold_alerts,
    "ewma_baseline": ewma_baseline,
    "deviation_alerts": deviation_alerts,
    "log_error_rate_alerts": log_error_rate_alerts,
    "all_alerts": all_alerts,
    "alert_json": alert_json,
    "alerts_per_component_hour": alerts_per_component_hour,
}

ORACLES = {
    "threshold_alerts": f"WITH {TELEMETRY_SQL},{THRESHOLD_SQL} SELECT {_ALERT_COLUMNS} FROM threshold_alerts",
    "ewma_baseline": f"""WITH RECURSIVE {TELEMETRY_SQL},{EWMA_SQL}
        SELECT event_id, series_key, rn AS samples, {sql_six_digits("mean")} AS mean,
               {sql_six_digits("variance")} AS variance FROM ewma""",
    "deviation_alerts": f"""WITH RECURSIVE {TELEMETRY_SQL},{EWMA_SQL},{DEVIATION_SQL}
        SELECT {_ALERT_COLUMNS} FROM deviation_alerts""",
    "log_error_rate_alerts": f"""WITH {TELEMETRY_SQL},{ERROR_RATE_SQL}
        SELECT {_ALERT_COLUMNS} FROM error_rate_alerts""",
    "all_alerts": f"WITH RECURSIVE {ALL_ALERTS_SQL} SELECT {_ALERT_COLUMNS} FROM alerts",
    "alert_json": f"""WITH RECURSIVE {ALL_ALERTS_SQL}
        SELECT component AS "key",
               '{{"rule":"' || rule || '","component":"' || component || '","threshold":'
               || {sql_two_decimals("threshold")} || ',"actual":' || {sql_two_decimals("actual")}
               || ',"timestamp_ms":' || timestamp_ms || ',"severity":"' || severity || '"}}' AS value
        FROM alerts""",
    "alerts_per_component_hour": f"""WITH RECURSIVE {ALL_ALERTS_SQL}
        SELECT timestamp_ms // 3600000 AS hour, component, rule, severity, count(*) AS alerts,
               {sql_six_digits("max(actual)")} AS max_actual
        FROM alerts GROUP BY ALL""",
}
