"""Incident tracking queries and their SQL checks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import detect, guidance, incidents
from tidewatch.plans.adapters import telemetry
from tidewatch.plans.alerts import ALL_ALERTS_SQL, sql_two_decimals
from tidewatch.rules import Rules

# The events span a month, so a cycle is an hour here.
RULES = replace(Rules(), interval_seconds=3600)


def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.anomalies_from_alerts(detect.detect_alerts(telemetry(spark, sf_dir), RULES), RULES)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anomalies(spark, sf_dir).withColumn("delivered", F.col("cycle") % 5 != 0)


def _all_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles that end a day: the check runs then even when nothing is found."""
    cycle = F.floor(F.col("timestamp_ms") / (RULES.interval_seconds * 1000)).cast("long").alias("cycle")
    return telemetry(spark, sf_dir).select(cycle).distinct().filter(F.col("cycle") % 24 == 23)


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anomalies(spark, sf_dir).withColumn("source_signal_ids", F.array_join("source_signal_ids", ","))


def incident_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.track_incidents(detections(spark, sf_dir), RULES).select(
        "cycle", "fingerprint", "observed_value", "value", "status", "occurrences", "should_report"
    )


def incident_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.resolved_incidents(detections(spark, sf_dir), RULES, _all_clear(spark, sf_dir))


def incident_carryover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.carried_over(detections(spark, sf_dir), RULES)


def hypothesis_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = guidance.hypothesis_plan(_anomalies(spark, sf_dir), replace(RULES, diagnostic_forks=3))
    return planned.select("cycle", "anomaly_type", "affected_component", "fork", "cause")


def hypothesis_plan_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same generic causes for every type, more forks than there are causes."""
    rules = replace(RULES, diagnostic_forks=9, hypothesis_mode="static")
    planned = guidance.hypothesis_plan(_anomalies(spark, sf_dir), rules)
    return planned.select("cycle", "anomaly_type", "affected_component", "fork", "cause")


ANOMALIES_SQL = f"""{ALL_ALERTS_SQL},
measured AS (
  SELECT *, timestamp_ms // 3600000 AS cycle, regexp_replace(rule, '_(threshold|baseline_deviation)$', '') AS metric,
         actual / threshold AS excess
  FROM alerts),
anomalies AS (
  SELECT cycle, CASE metric WHEN 'latency_ms' THEN 'latency_spike' WHEN 'heap_usage_percent' THEN 'memory_pressure'
                     ELSE 'error_burst' END AS anomaly_type,
         component AS affected_component, metric, rule, actual, threshold AS lim, timestamp_ms, event_id,
         {sql_two_decimals("actual")} || CASE metric WHEN 'latency_ms' THEN 'ms' WHEN 'heap_usage_percent' THEN '%'
                                         ELSE '' END AS observed_value
  FROM measured
  QUALIFY row_number() OVER (PARTITION BY cycle, metric, component
                             ORDER BY excess DESC, actual DESC, timestamp_ms DESC, event_id DESC) = 1)"""

_TRACKED_SQL = f"""{ANOMALIES_SQL},
seen AS (
  SELECT cycle, anomaly_type, affected_component, anomaly_type || ':' || affected_component AS fingerprint,
         observed_value, cycle % 5 <> 0 AS delivered,
         TRY_CAST(regexp_extract(replace(observed_value, ',', ''), '[-+]?\\d*\\.?\\d+') AS DOUBLE) AS value
  FROM anomalies),
marked AS (
  SELECT *, lag(value) OVER w AS prior, lead(cycle) OVER w AS next_cycle,
         coalesce(cycle - lag(cycle) OVER w > 1, true) AS is_new
  FROM seen WINDOW w AS (PARTITION BY fingerprint ORDER BY cycle)),
islands AS (
  SELECT *, sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (PARTITION BY fingerprint ORDER BY cycle) AS island
  FROM marked),
tracked AS (
  SELECT *, CASE WHEN is_new THEN 'new' WHEN prior > 0 AND (value - prior) / prior >= 25e-2 THEN 'worsening'
                 ELSE 'ongoing' END AS status,
         row_number() OVER (PARTITION BY fingerprint, island ORDER BY cycle) AS occurrences,
         coalesce(bool_or(delivered) OVER (PARTITION BY fingerprint, island ORDER BY cycle
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS reported
  FROM islands)"""

_CAUSES_SQL = "(VALUES " + ", ".join(
    f"('{kind}', {i}, '{cause}')" for kind, causes in guidance.CAUSES.items() for i, cause in enumerate(causes)
) + ") c(kind, fork, cause)"

_GENERIC_SQL = "(VALUES " + ", ".join(f"({i}, '{cause}')" for i, cause in enumerate(guidance.GENERIC_CAUSES)) + ") c(fork, cause)"

QUERIES = {
    "anomalies_from_alerts": anomalies,
    "incident_lifecycle": incident_lifecycle,
    "incident_resolved": incident_resolved,
    "incident_carryover": incident_carryover,
    "hypothesis_plan": hypothesis_plan,
    "hypothesis_plan_static": hypothesis_plan_static,
}

ORACLES = {
    "anomalies_from_alerts": f"""WITH RECURSIVE {ANOMALIES_SQL}
        SELECT cycle, anomaly_type,
               metric || ' ' || observed_value || CASE WHEN actual < lim THEN ' below ' ELSE ' above ' END
                 || {sql_two_decimals("lim")} || ' on ' || affected_component AS summary,
               strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS detected_at,
               metric, observed_value,
               CASE WHEN rule LIKE '%deviation' THEN CAST({sql_two_decimals("lim")} AS VARCHAR) END AS baseline,
               CASE WHEN rule NOT LIKE '%deviation' THEN CAST({sql_two_decimals("lim")} AS VARCHAR) END AS threshold,
               CASE WHEN actual < lim THEN 'below' ELSE 'above' END AS breach_direction,
               affected_component, CAST(event_id AS VARCHAR) AS source_signal_ids
        FROM anomalies""",
    "incident_lifecycle": f"""WITH RECURSIVE {_TRACKED_SQL}
        SELECT cycle, fingerprint, observed_value, value, status, occurrences,
               status IN ('new', 'worsening') OR NOT reported AS should_report
        FROM tracked""",
    "incident_resolved": f"""WITH RECURSIVE {_TRACKED_SQL},
        cycles AS (SELECT cycle FROM seen UNION
                   SELECT timestamp_ms // 3600000 FROM telemetry WHERE (timestamp_ms // 3600000) % 24 = 23)
        SELECT c.cycle, t.fingerprint FROM tracked t JOIN cycles c
          ON c.cycle > t.cycle AND c.cycle - 1 - t.cycle <= 1 AND (t.next_cycle IS NULL OR c.cycle < t.next_cycle)""",
    "incident_carryover": f"""WITH RECURSIVE {_TRACKED_SQL}
        SELECT cycle + 1 AS before_cycle, fingerprint, anomaly_type, affected_component AS component, occurrences,
               value AS last_value
        FROM tracked""",
    "hypothesis_plan": f"""WITH RECURSIVE {ANOMALIES_SQL}
        SELECT cycle, anomaly_type, affected_component, CAST(fork AS INTEGER) AS fork, cause
        FROM anomalies JOIN {_CAUSES_SQL} ON kind = anomaly_type""",
    "hypothesis_plan_static": f"""WITH RECURSIVE {ANOMALIES_SQL}
        SELECT cycle, anomaly_type, affected_component, CAST(fork AS INTEGER) AS fork, cause
        FROM anomalies, {_GENERIC_SQL}""",
}
