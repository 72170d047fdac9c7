"""Spark schemas of the records the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "binary": T.BinaryType(),
    "strings": T.ArrayType(T.StringType()),
    "labels": T.MapType(T.StringType(), T.StringType()),
}


def record(fields: str) -> T.StructType:
    """'name type, name type, ...' as a schema, without needing a session."""
    out = T.StructType()
    for f in fields.split(","):
        name, kind = f.split()
        out = out.add(name, _TYPES[kind])
    return out


METRIC = record("metric_name string, value double, unit string, component string, tags labels")
LOG = record(
    "severity int, message string, component string, logger_name string, stack_trace string, "
    "context labels"
)
PROTO_ALERT = record(
    "alert_id string, severity string, rule_name string, description string, component string, "
    "threshold double, actual_value double, window_start_ms long, window_end_ms long, "
    "labels labels"
)
HEARTBEAT = record("component string, status string, uptime_ms long, metadata labels")

EVENT = (
    T.StructType()
    .add("event_id", T.StringType())
    .add("timestamp_ms", T.LongType())
    .add("source", T.StringType())
    .add("metric", METRIC)
    .add("log", LOG)
    .add("alert", PROTO_ALERT)
    .add("heartbeat", HEARTBEAT)
)

ALERT = record(
    "rule string, component string, threshold double, actual double, timestamp_ms long, severity string"
)

ANOMALY = record(
    "anomaly_type string, summary string, detected_at string, metric string, observed_value string, "
    "baseline string, threshold string, breach_direction string, affected_component string, "
    "source_signal_ids strings"
)

SOURCE = record("source_id string, tool_name string, retrieved_at string, raw_output string")
CLAIM = record("claim_id string, text string, source_id string, confidence string")
CONFLICT = record(
    "conflict_id string, topic string, claim_a_id string, claim_b_id string, resolution string, notes string"
)
COMPONENT = record("name string, role string, status string, evidence string")
ROOT_CAUSE = record("summary string, confidence string, reasoning string, supporting_metrics strings")
ACTION = record("action string, rationale string, risk string, requires_downtime boolean")

DIAGNOSIS = (
    T.StructType()
    .add("anomaly_type", T.StringType())
    .add("detected_at", T.StringType())
    .add("sources", T.ArrayType(SOURCE))
    .add("claims", T.ArrayType(CLAIM))
    .add("conflicts", T.ArrayType(CONFLICT))
    .add("affected_components", T.ArrayType(COMPONENT))
    .add("root_cause", ROOT_CAUSE)
    .add("tools_used", T.ArrayType(T.StringType()))
    .add("raw_evidence", T.ArrayType(T.StringType()))
)

INCIDENT = (
    T.StructType()
    .add("incident_id", T.StringType())
    .add("title", T.StringType())
    .add("severity", T.StringType())
    .add("summary", T.StringType())
    .add("anomaly_type", T.StringType())
    .add("root_cause", T.StringType())
    .add("affected_components", T.ArrayType(T.StringType()))
    .add("timeline", T.ArrayType(T.StringType()))
    .add("recommended_actions", T.ArrayType(ACTION))
    .add("low_confidence_claims", T.ArrayType(T.StringType()))
    .add("requires_human_approval", T.BooleanType())
    .add("monitoring_notes", T.StringType())
    .add("sources", T.ArrayType(SOURCE))
    .add("supporting_claims", T.ArrayType(CLAIM))
)

AUDIT = (
    T.StructType()
    .add("timestamp", T.StringType())
    .add("incident_id", T.StringType())
    .add("title", T.StringType())
    .add("severity", T.StringType())
    .add("anomaly_type", T.StringType())
    .add("root_cause", T.StringType())
    .add("summary", T.StringType())
    .add("affected_components", T.ArrayType(T.StringType()))
    .add("recommended_actions", T.ArrayType(ACTION))
    .add("low_confidence_claims", T.ArrayType(T.StringType()))
    .add("requires_human_approval", T.BooleanType())
    .add("human_approved", T.BooleanType())
    .add("unresolved_conflict_count", T.LongType())
    .add("conflicts_acknowledged", T.BooleanType())
    .add(
        "diagnosis",
        record("sources_consulted strings, claim_count int, conflict_count int, tools_used strings"),
    )
)

OFFSETS = record("group string, topic string, partition int, committed long, low long, high long")
SAMPLE = record("ts timestamp, name string, labels labels, value double")
