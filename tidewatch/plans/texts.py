"""Text queries and their SQL checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import text as t
from tidewatch.operators import diagnosis, guidance, routing
from tidewatch.operators.ordered import checkpoint_dir
from tidewatch.plans import adapters as a
from tidewatch.rules import Rules
from tidewatch.sources import audit, responses, runbooks

RULES = Rules()
_NOW = "1970-01-01T00:00:00Z"
# Kinds of source, in turn over the documents.
_KINDS = ["log", "event", "metric", "exception"]


def _hashed(df: DataFrame, column: str) -> DataFrame:
    """Whole text as digest and length, which is enough to compare it."""
    c = F.col(column)
    return df.withColumn(f"{column}_chars", F.length(c)).withColumn(column, F.md5(c))


def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("doc_id") % 4 + 1).cast("int"))
    trusted = a.texts(spark, sf_dir).withColumn("trust", t.source_trust(kind))
    clean = t.sanitize(F.col("text"), RULES.sanitize_max_chars, F.col("trust"))
    return _hashed(trusted.select("doc_id", "trust", clean.alias("clean")), "clean")


def leading_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.texts(spark, sf_dir).select("doc_id", t.leading_number(F.col("text")).alias("number"))


def json_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(a.texts(spark, sf_dir).select("doc_id", t.json_block(F.col("text")).alias("block")), "block")


def anomaly_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.texts(spark, sf_dir).select("doc_id", t.mentions_anomaly(F.col("text")).alias("mentions_anomaly"))


def runbook_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runbooks.runbook_index(a.runbook_files(spark, sf_dir)).select("anomaly_type", "title", "body", "path")


def runbook_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = runbooks.runbook_index(a.runbook_files(spark, sf_dir))
    matched = guidance.match_runbooks(a.texts(spark, sf_dir), index)
    return matched.select("doc_id", "type_pos", "anomaly_type", "title")


def runbook_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.array_join(guidance.runbook_types(F.col("text")), ",")
    return a.texts(spark, sf_dir).select("doc_id", types.alias("types"))


def parse_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = responses.parse_anomalies(a.detection_responses(spark, sf_dir), now=F.lit(_NOW))
    return parsed.select(
        "doc_id", "anomaly.anomaly_type", "anomaly.summary", "anomaly.detected_at", "anomaly.metric",
        "anomaly.observed_value", "anomaly.affected_component",
    )


def detection_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = responses.parse_anomalies(a.detection_responses(spark, sf_dir), now=F.lit(_NOW))
    anomalies = parsed.select(F.col("doc_id").alias("diagnosis_id"), "anomaly.*")
    found = diagnosis.diagnosis_from_anomaly(diagnosis.cut_summaries(anomalies, RULES))
    return found.select(
        "diagnosis_id", "anomaly_type", "detected_at", F.size("claims").alias("claims"),
        F.col("root_cause.summary").alias("root_cause"), F.col("root_cause.confidence").alias("confidence"),
        F.array_join("root_cause.supporting_metrics", ",").alias("supporting_metrics"),
    )


def _diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.parse_diagnoses(a.diagnosis_responses(spark, sf_dir), now=F.lit(_NOW))


def parse_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diagnoses(spark, sf_dir).select(
        "doc_id", "diagnosis.anomaly_type", "diagnosis.detected_at",
        F.size("diagnosis.sources").alias("sources"), F.size("diagnosis.claims").alias("claims"),
        F.col("diagnosis.root_cause.summary").alias("root_cause"),
        F.md5("diagnosis.root_cause.reasoning").alias("reasoning"),
        F.array_join("diagnosis.tools_used", ",").alias("tools_used"),
        F.md5(F.array_join(F.transform("diagnosis.claims", lambda c: c["text"]), ",")).alias("claim_texts"),
    )


def attach_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    diagnoses = _diagnoses(spark, sf_dir).select(F.col("doc_id").alias("diagnosis_id"), "diagnosis")
    own = F.when(F.col("diagnosis_id") % 8 == 2, F.array(F.lit("known"))).otherwise(F.array().cast("array<string>"))
    incidents = diagnoses.select(
        "diagnosis_id",
        own.alias("low_confidence_claims"),
        F.col("diagnosis.sources").alias("sources"),
    )
    out = diagnosis.attach_attribution(incidents, diagnoses)
    return out.select(
        "diagnosis_id", F.size("sources").alias("sources"), F.size("supporting_claims").alias("claims"),
        F.array_join("low_confidence_claims", ",").alias("low_confidence_claims"),
    )


def _incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    diagnoses = _diagnoses(spark, sf_dir).select(F.col("doc_id").alias("diagnosis_id"), "diagnosis.*")
    reports = responses.parse_incidents(a.report_responses(spark, sf_dir)).withColumnRenamed("doc_id", "diagnosis_id")
    return diagnosis.with_fallback(reports, diagnoses)


def audit_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents and their diagnoses, routed, written to an audit trail with all fields, and read back."""
    whole = _diagnoses(spark, sf_dir).select(F.col("doc_id").alias("diagnosis_id"), "diagnosis")
    routed = routing.route_incidents(_incidents(spark, sf_dir).join(whole, "diagnosis_id"))
    path = f"{checkpoint_dir(spark)}/audit-{uuid.uuid4().hex}"
    audit.append_audit(routing.audit_entries(routed, F.lit(_NOW)), path)
    return audit.read_audit(spark, path).select(
        "timestamp", "incident_id", "title", "severity", "anomaly_type", "root_cause", F.md5("summary").alias("summary"),
        F.array_join("affected_components", ",").alias("components"),
        F.array_join(F.transform("recommended_actions", lambda x: F.concat_ws("/", x.action, x.risk, x.requires_downtime.cast("string"))), ",").alias("actions"),
        F.md5(F.array_join("low_confidence_claims", ",")).alias("low_confidence_claims"), "requires_human_approval",
        "human_approved", "unresolved_conflict_count", "conflicts_acknowledged",
        F.array_join("diagnosis.sources_consulted", ",").alias("sources_consulted"),
        F.col("diagnosis.claim_count").alias("claim_count"), F.col("diagnosis.conflict_count").alias("conflict_count"),
        F.array_join("diagnosis.tools_used", ",").alias("tools_used"),
    )


def incident_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report texts as incidents, with the fallback where one does not parse."""
    return _incidents(spark, sf_dir).select(
        "diagnosis_id", "parsed", "incident_id", "title", "severity", F.md5("summary").alias("summary"), "anomaly_type",
        "root_cause", F.array_join("affected_components", ",").alias("components"),
        F.array_join("timeline", ",").alias("timeline"), F.size("recommended_actions").alias("actions"),
        F.md5(F.array_join("low_confidence_claims", ",")).alias("low_confidence_claims"), "requires_human_approval",
        "monitoring_notes", F.size("sources").alias("sources"), F.size("supporting_claims").alias("claims"),
    )


def size_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = a.texts(spark, sf_dir).select("doc_id", F.col("text").alias("diagnosis_json"))
    return diagnosis.size_check(named, RULES).select("doc_id", "chars", "reject_reason")


QUERIES = {
    "sanitize_text": sanitize_text,
    "leading_number": leading_number,
    "json_block": json_block,
    "anomaly_text": anomaly_text,
    "runbook_index": runbook_index,
    "runbook_match": runbook_match,
    "runbook_types": runbook_types,
    "parse_detections": parse_detections,
    "detection_diagnoses": detection_diagnoses,
    "parse_diagnoses": parse_diagnoses,
    "attach_attribution": attach_attribution,
    "incident_records": incident_records,
    "audit_round_trip": audit_round_trip,
    "size_check": size_check,
}


def _any_word(words: list[str], text: str = "text") -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


_TYPES_SQL = ", ".join(
    f"({i}, '{kind}')" for i, kind in enumerate(guidance.RUNBOOK_WORDS)
)
_HIT_SQL = " ".join(
    f"WHEN '{kind}' THEN {_any_word(words)}" for kind, words in guidance.RUNBOOK_WORDS.items()
)
_MATCHED_SQL = f"""
hits AS (
  SELECT doc_id, kind, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS type_pos
  FROM texts, (VALUES {_TYPES_SQL}) k(i, kind) WHERE CASE kind {_HIT_SQL} END)"""

_REDACTED_SQL = "text"
for _pattern in t.INJECTION_PATTERNS:
    _REDACTED_SQL = f"regexp_replace({_REDACTED_SQL}, '{_pattern}', '{t.REDACTED}', 'gi')"

_DETECTED_SQL = f"""
detected AS (
  SELECT doc_id, doc_id % 5 IN (0, 1) AS sound, coalesce(text, '') AS whole,
         CASE doc_id % 5 WHEN 2 THEN '{{"anomaly_type":"latency_spike","summary":' || to_json(coalesce(text, '')) || '}}'
              WHEN 3 THEN '```json ' || coalesce(text, '') ELSE coalesce(text, '') END AS quoted
  FROM documents),
anomalies AS (
  SELECT doc_id, CASE WHEN sound THEN 'latency_spike' ELSE 'unknown' END AS anomaly_type,
         CASE WHEN sound THEN whole ELSE quoted END AS summary,
         CASE WHEN sound THEN '2024-01-01T00:00:00Z' ELSE '{_NOW}' END AS detected_at,
         CASE WHEN sound THEN 'latency_ms' END AS metric, CASE WHEN sound THEN doc_id || 'ms' END AS observed_value,
         CAST(NULL AS VARCHAR) AS affected_component
  FROM detected)"""

_RECORD = (
    '{"anomaly_type":"backpressure","detected_at":"2024-01-01T00:00:00Z","sources":[{"source_id":"s1",'
    '"tool_name":"query_metrics","retrieved_at":"2024-01-01","raw_output":"x"}],"claims":[{"claim_id":"c1",'
    '"text":\' || to_json(coalesce(text, \'\')) || \',"source_id":"s1","confidence":"LEVEL"}],'
    '"affected_components":[{"name":"svc-\' || (doc_id % 8) || \'","role":"sink","status":"slow","evidence":"lag"}],'
)
_CERTAIN = (
    _RECORD.replace("LEVEL", "CERTAIN")
    + '"root_cause":{"summary":"slow sink \' || doc_id || \'","confidence":"high","reasoning":"seen"},'
    + '"tools_used":["query_metrics"]}'
)
_NO_CAUSE = _RECORD.replace("LEVEL", "LOW") + '"tools_used":["query_metrics"]}'
_DIAGNOSED_SQL = f"""
diagnosed AS (
  SELECT doc_id, doc_id % 4 = 0 AS sound, coalesce(text, '') AS whole,
         CASE doc_id % 4 WHEN 1 THEN '{_CERTAIN}' WHEN 2 THEN '{_NO_CAUSE}' ELSE coalesce(text, '') END AS quoted,
         CASE WHEN doc_id % 4 = 0 THEN 'slow sink ' || doc_id
              ELSE 'Agent response could not be parsed as structured output' END AS cause
  FROM documents)"""

_INCIDENTS_SQL = f"""{_DIAGNOSED_SQL},
reports AS (
  SELECT *, doc_id % 6 < 2 AS parsed, CASE WHEN sound THEN '2024-01-01T00:00:00Z' ELSE '{_NOW}' END AS detected_at,
         CASE WHEN doc_id % 8 = 4 THEN whole ELSE '' END AS low FROM diagnosed),
incidents AS (
  SELECT doc_id AS diagnosis_id, parsed, sound,
         CASE WHEN parsed THEN 'inc-' || doc_id ELSE substr(sha256(doc_id || chr(31) || detected_at), 1, 8) END AS incident_id,
         CASE WHEN parsed THEN 'Incident ' || doc_id WHEN sound THEN 'Anomaly: backpressure' ELSE 'Anomaly: parse_error' END
           AS title,
         CASE WHEN NOT parsed THEN 'MEDIUM' WHEN doc_id % 6 = 0 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
         md5(CASE WHEN parsed THEN whole ELSE cause END) AS summary,
         CASE WHEN parsed OR sound THEN 'backpressure' ELSE 'parse_error' END AS anomaly_type,
         CASE WHEN parsed THEN 'slow sink' ELSE cause END AS root_cause,
         CASE WHEN parsed THEN 'a,b' WHEN sound THEN 'svc-' || (doc_id % 8) ELSE '' END AS components,
         CASE WHEN parsed THEN 'first,then' ELSE 'Detected at ' || detected_at END AS timeline,
         md5(CASE WHEN doc_id % 6 = 1 THEN 'own' ELSE low END) AS low_confidence_claims,
         NOT parsed OR doc_id % 6 <> 1 AS requires_human_approval,
         CASE WHEN parsed THEN 'watch' ELSE 'Monitor after remediation' END AS monitoring_notes
  FROM reports)"""

_BLOCK_SQL = """
fenced AS (
  SELECT doc_id, text, contains(text, '```') AS fence,
         CASE WHEN contains(text, '```json') THEN substr(text, strpos(text, '```json') + 7)
              WHEN contains(text, '```') THEN substr(text, strpos(text, '```') + 3) END AS rest
  FROM texts),
blocks AS (
  SELECT doc_id,
         CASE WHEN fence AND strpos(rest, '```') = 0 THEN NULL
              WHEN fence THEN trim(substr(rest, 1, strpos(rest, '```') - 1), E' \\n\\t\\r\\f\\x0b')
              WHEN regexp_matches(text, '\\{.*\\}', 's') THEN regexp_extract(text, '\\{.*\\}', 0, 's')
              ELSE text END AS block
  FROM fenced)"""

ORACLES = {
    "sanitize_text": f"""WITH {a.TEXTS_SQL},
        cleaned AS (
          SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'semi-trusted' WHEN 2 THEN 'trusted' ELSE 'untrusted' END AS trust,
                 CASE WHEN doc_id % 4 IN (0, 3) THEN {_REDACTED_SQL} ELSE text END AS clean
          FROM texts)
        SELECT doc_id, trust, md5(clean) AS clean, CAST(length(clean) AS INTEGER) AS clean_chars FROM cleaned""",
    "leading_number": f"""WITH {a.TEXTS_SQL}
        SELECT doc_id, TRY_CAST(nullif(regexp_extract(replace(text, ',', ''), '[-+]?\\d*\\.?\\d+'), '') AS DOUBLE)
          AS number FROM texts""",
    "json_block": f"""WITH {a.TEXTS_SQL},{_BLOCK_SQL}
        SELECT doc_id, md5(block) AS block, CAST(length(block) AS INTEGER) AS block_chars FROM blocks""",
    "anomaly_text": f"WITH {a.TEXTS_SQL} SELECT doc_id, {_any_word(t.ANOMALY_WORDS)} AS mentions_anomaly FROM texts",
    "runbook_index": f"WITH {a.RUNBOOKS_SQL} SELECT anomaly_type, title, body, path FROM runbooks",
    "runbook_match": f"""WITH {a.TEXTS_SQL},{a.RUNBOOKS_SQL},{_MATCHED_SQL}
        SELECT doc_id, type_pos, anomaly_type, title FROM hits JOIN runbooks ON anomaly_type = kind""",
    "runbook_types": f"""WITH {a.TEXTS_SQL},{_MATCHED_SQL}
        SELECT doc_id, coalesce(string_agg(kind, ',' ORDER BY type_pos), '') AS types
        FROM texts LEFT JOIN hits USING (doc_id) GROUP BY doc_id""",
    "parse_detections": f"WITH {_DETECTED_SQL} SELECT * FROM anomalies",
    "detection_diagnoses": f"""WITH {_DETECTED_SQL}
        SELECT doc_id AS diagnosis_id, anomaly_type, detected_at, CAST(0 AS INTEGER) AS claims, summary AS root_cause,
               'medium' AS confidence, coalesce(metric || ',' || observed_value, '') AS supporting_metrics
        FROM anomalies""",
    "parse_diagnoses": f"""WITH {_DIAGNOSED_SQL}
        SELECT doc_id, CASE WHEN sound THEN 'backpressure' ELSE 'parse_error' END AS anomaly_type,
               CASE WHEN sound THEN '2024-01-01T00:00:00Z' ELSE '{_NOW}' END AS detected_at,
               CAST(sound AS INTEGER) AS sources, CAST(sound AS INTEGER) AS claims,
               cause AS root_cause, md5(CASE WHEN sound THEN 'seen' ELSE quoted END) AS reasoning,
               CASE WHEN sound THEN 'query_metrics' ELSE '' END AS tools_used,
               md5(CASE WHEN sound THEN whole ELSE '' END) AS claim_texts
        FROM diagnosed""",
    "attach_attribution": """
        SELECT doc_id AS diagnosis_id, CAST(doc_id % 4 = 0 AS INTEGER) AS sources, CAST(doc_id % 4 = 0 AS INTEGER) AS claims,
               CASE WHEN doc_id % 8 = 2 THEN 'known' WHEN doc_id % 8 = 4 THEN coalesce(text, '') ELSE '' END
                 AS low_confidence_claims
        FROM documents""",
    "incident_records": f"""WITH {_INCIDENTS_SQL}
        SELECT diagnosis_id, parsed, incident_id, title, severity, summary, anomaly_type, root_cause, components, timeline,
               CAST(parsed AS INTEGER) AS actions, low_confidence_claims, requires_human_approval, monitoring_notes,
               CAST(sound AS INTEGER) AS sources, CAST(sound AS INTEGER) AS claims
        FROM incidents""",
    "audit_round_trip": f"""WITH {_INCIDENTS_SQL}
        SELECT '{_NOW}' AS timestamp, incident_id, title, severity, anomaly_type, root_cause, summary, components,
               CASE WHEN parsed THEN 'restart/low/true' ELSE '' END AS actions, low_confidence_claims, requires_human_approval,
               CAST(NULL AS BOOLEAN) AS human_approved, CAST(0 AS BIGINT) AS unresolved_conflict_count,
               CAST(NULL AS BOOLEAN) AS conflicts_acknowledged,
               CASE WHEN sound THEN 'query_metrics' ELSE '' END AS sources_consulted, CAST(sound AS INTEGER) AS claim_count,
               CAST(0 AS INTEGER) AS conflict_count, CASE WHEN sound THEN 'query_metrics' ELSE '' END AS tools_used
        FROM incidents""",
    "size_check": f"""WITH {a.TEXTS_SQL}
        SELECT doc_id, length(text) AS chars,
               CASE WHEN length(text) > 50000 THEN 'DiagnosisReport JSON exceeds max handoff size (' || length(text)
                 || ' > 50000 chars)' END AS reject_reason
        FROM texts""",
}
