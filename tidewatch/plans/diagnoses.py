"""Diagnosis, merge, routing and audit queries, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import diagnosis as d
from tidewatch.operators import routing
from tidewatch.plans import adapters as a
from tidewatch.rules import Rules


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = d.duplicate_ids(a.diagnosis_sources(spark, sf_dir), "source_id")
    claims = d.duplicate_ids(a.diagnosis_claims(spark, sf_dir), "claim_id")
    return sources.withColumn("kind", F.lit("source")).union(claims.withColumn("kind", F.lit("claim")))


def dangling_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = d.dangling_claims(a.diagnosis_claims(spark, sf_dir), a.diagnosis_sources(spark, sf_dir))
    return found.select("diagnosis_id", "pos", "claim_id", "source_id", "confidence")


def dangling_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.dangling_conflicts(a.diagnosis_conflicts(spark, sf_dir), a.diagnosis_claims(spark, sf_dir))


def integrity_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.integrity_errors(
        a.diagnosis_sources(spark, sf_dir), a.diagnosis_claims(spark, sf_dir), a.diagnosis_conflicts(spark, sf_dir)
    )


def incident_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.integrity_errors(a.incident_sources(spark, sf_dir), a.incident_claims(spark, sf_dir), key="incident_id")


def confidence_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.confidence_distribution(a.diagnosis_headers(spark, sf_dir), a.diagnosis_claims(spark, sf_dir))


def low_conf_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.low_confidence_claims(a.diagnosis_claims(spark, sf_dir)).select("diagnosis_id", "pos", "text")


def report_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.report_gate(a.diagnosis_headers(spark, sf_dir), a.diagnosis_claims(spark, sf_dir))


def representative_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.representative_claims(a.diagnosis_claims(spark, sf_dir))


def _forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.forks(a.fork_headers(spark, sf_dir), a.diagnosis_claims(spark, sf_dir))


def fork_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forks(spark, sf_dir).filter(F.col("fork") == F.col("primary.fork")).select(
        "incident_id", "fork", "diagnosis_id", "rep_claim_id", "rank", "fork_count"
    )


def fork_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.cross_fork_conflicts(_forks(spark, sf_dir))


def fork_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = d.merged_headers(_forks(spark, sf_dir))
    return merged.withColumn("tools_used", F.array_join("tools_used", ","))


def fork_merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.merged_children(_forks(spark, sf_dir), a.diagnosis_sources(spark, sf_dir), ["source_id"])


def fork_merge_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.merged_children(_forks(spark, sf_dir), a.diagnosis_claims(spark, sf_dir), ["claim_id", "source_id"])


def fork_merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.merged_conflicts(_forks(spark, sf_dir), a.diagnosis_conflicts(spark, sf_dir))


def fork_merge_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.merged_children(_forks(spark, sf_dir), a.diagnosis_components(spark, sf_dir), [])


def fork_merge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.merged_children(_forks(spark, sf_dir), a.diagnosis_evidence(spark, sf_dir), [])


_SIZE_RULES = Rules(handoff_max_chars=1_500)


def diagnosis_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every diagnosis with all its children, against a limit that some are over."""
    cause = F.struct(
        "summary", F.lit("medium").alias("confidence"), F.lit("seen").alias("reasoning"),
        F.array("anomaly_type").alias("supporting_metrics"),
    )
    headers = a.diagnosis_headers(spark, sf_dir).withColumn("root_cause", cause)
    output = F.concat_ws(" ", "tool_name", "retrieved_at")
    children = {
        "sources": a.diagnosis_sources(spark, sf_dir).withColumn("raw_output", output),
        "claims": a.diagnosis_claims(spark, sf_dir),
        "conflicts": a.diagnosis_conflicts(spark, sf_dir),
        "affected_components": a.diagnosis_components(spark, sf_dir),
        "raw_evidence": a.diagnosis_evidence(spark, sf_dir),
    }
    return d.diagnosis_size(headers, children, _SIZE_RULES)


def fallback_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = a.diagnosis_headers(spark, sf_dir).withColumn(
        "root_cause", F.struct(F.col("summary").alias("summary"))
    )
    return d.fallback_incidents(headers).select(
        "incident_id", "diagnosis_id", "title", "severity", "summary", "anomaly_type", "root_cause",
        F.array_join("timeline", ",").alias("timeline"), F.size("recommended_actions").alias("actions"),
        "requires_human_approval", "monitoring_notes",
    )


def unresolved_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.unresolved_conflicts(a.diagnosis_conflicts(spark, sf_dir)).select(
        "diagnosis_id", "conflict_id", "topic", "claim_a_id", "claim_b_id"
    )


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route_incidents(
        a.incident_reports(spark, sf_dir), a.diagnosis_conflicts(spark, sf_dir), a.human_decisions(spark, sf_dir)
    )


def route_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select(
        "incident_id", "severity", "unresolved_conflict_count", "route", "lists_actions", "needs_approval",
        "needs_conflict_ack", "human_approved", "conflicts_acknowledged",
    )


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with the claim and conflict counts of their diagnosis."""
    reports = _routed(spark, sf_dir)
    claims = d.claim_stats(reports.select("diagnosis_id"), a.diagnosis_claims(spark, sf_dir))
    conflicts = a.diagnosis_conflicts(spark, sf_dir).groupBy("diagnosis_id").agg(
        F.count("*").alias("conflict_count")
    )
    headers = a.diagnosis_headers(spark, sf_dir).select("diagnosis_id", "tools_used")
    counted = (
        reports.join(claims.select("diagnosis_id", F.col("claims").alias("claim_count")), "diagnosis_id")
        .join(conflicts, "diagnosis_id", "left")
        .join(headers, "diagnosis_id")
        .fillna(0, ["conflict_count"])
        .withColumn("sources_consulted", F.array(F.lit("query_metrics"), F.lit("search_logs")))
    )
    return routing.audit_entries(counted, F.col("reported_at"))


def _flat_audit(entries: DataFrame) -> DataFrame:
    return entries.select(
        "timestamp", "incident_id", "title", "severity", "anomaly_type", "root_cause", "human_approved",
        "unresolved_conflict_count", "conflicts_acknowledged",
        F.col("diagnosis.claim_count").alias("claim_count"),
        F.col("diagnosis.conflict_count").alias("conflict_count"),
        F.array_join("diagnosis.tools_used", ",").alias("tools_used"),
    )


def audit_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_audit(_audit(spark, sf_dir))


def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_audit(routing.audit_query(_audit(spark, sf_dir), "CRITICAL", "backpressure", 20))


QUERIES = {
    "dup_ids": duplicate_ids,
    "dangling_claims": dangling_claims,
    "dangling_conflicts": dangling_conflicts,
    "integrity_errors": integrity_errors,
    "incident_integrity": incident_integrity,
    "confidence_distribution": confidence_distribution,
    "low_conf_claims": low_conf_claims,
    "report_gate": report_gate,
    "representative_claims": representative_claims,
    "fork_primary": fork_primary,
    "fork_conflicts": fork_conflicts,
    "fork_merge": fork_merge,
    "fork_merge_sources": fork_merge_sources,
    "fork_merge_claims": fork_merge_claims,
    "fork_merge_conflicts": fork_merge_conflicts,
    "fork_merge_components": fork_merge_components,
    "fork_merge_evidence": fork_merge_evidence,
    "diagnosis_size": diagnosis_size,
    "fallback_incidents": fallback_incidents,
    "unresolved_conflicts": unresolved_conflicts,
    "route_incidents": route_incidents,
    "audit_entries": audit_entries,
    "audit_query": audit_query,
}

_RECORDS = f"{a.HEADERS_SQL},{a.SOURCES_SQL},{a.CLAIMS_SQL},{a.CONFLICTS_SQL}"

_DUPLICATES_SQL = """
duplicates AS (
  SELECT diagnosis_id, source_id AS id, count(*) AS copies, 'source' AS kind FROM sources GROUP BY ALL HAVING count(*) > 1
  UNION ALL
  SELECT diagnosis_id, claim_id, count(*), 'claim' FROM claims GROUP BY ALL HAVING count(*) > 1)"""

_DANGLING_SQL = """
dangling_claims AS (
  SELECT * FROM claims c WHERE confidence <> 'UNSOURCED' AND NOT EXISTS (
    SELECT 1 FROM sources s WHERE s.diagnosis_id = c.diagnosis_id AND s.source_id = c.source_id)),
dangling_conflicts AS (
  SELECT * FROM (SELECT diagnosis_id, conflict_id, 'a' AS side, claim_a_id AS claim_id FROM conflicts
                 UNION ALL SELECT diagnosis_id, conflict_id, 'b', claim_b_id FROM conflicts) x
  WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.diagnosis_id = x.diagnosis_id AND c.claim_id = x.claim_id))"""

_STATS_SQL = """
stats AS (
  SELECT h.diagnosis_id, h.anomaly_type, count(*) FILTER (WHERE confidence = 'HIGH') AS high,
         count(*) FILTER (WHERE confidence = 'MEDIUM') AS medium, count(*) FILTER (WHERE confidence = 'LOW') AS low,
         count(*) FILTER (WHERE confidence = 'UNSOURCED') AS unsourced, count(claim_id) AS claims
  FROM headers h LEFT JOIN claims c ON c.diagnosis_id = h.diagnosis_id GROUP BY ALL)"""

_REPS_SQL = """
ranked AS (
  SELECT *, CAST(CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS INTEGER) AS rank
  FROM claims),
reps AS (
  SELECT diagnosis_id, claim_id, rank FROM ranked
  QUALIFY row_number() OVER (PARTITION BY diagnosis_id ORDER BY rank DESC, pos) = 1)"""

_FORKS_SQL = f"""{_RECORDS},{a.FORKS_SQL},{_REPS_SQL},
forks AS (
  SELECT f.*, r.claim_id AS rep_claim_id, coalesce(r.rank, -1) AS rank,
         count(*) OVER (PARTITION BY incident_id) AS fork_count,
         row_number() OVER (PARTITION BY incident_id ORDER BY coalesce(r.rank, -1) DESC, fork) AS preference,
         CASE WHEN count(*) OVER (PARTITION BY incident_id) > 1 THEN 'f' || fork || ':' ELSE '' END AS prefix
  FROM fork_headers f LEFT JOIN reps r ON r.diagnosis_id = f.diagnosis_id),
cross_conflicts AS (
  SELECT f.incident_id, f.fork, 'xf-' || p.fork || '-' || f.fork AS conflict_id,
         'cross-fork root-cause disagreement' AS topic, p.prefix || p.rep_claim_id AS claim_a_id,
         f.prefix || f.rep_claim_id AS claim_b_id, 'unresolved' AS resolution,
         'Fork ' || p.fork || ' concluded ''' || p.anomaly_type || ''' (' || p.summary || '); fork ' || f.fork
           || ' concluded ''' || f.anomaly_type || ''' (' || f.summary || ')' AS notes
  FROM forks f JOIN forks p ON p.incident_id = f.incident_id AND p.preference = 1 AND f.preference > 1
  WHERE f.anomaly_type <> p.anomaly_type AND f.rep_claim_id IS NOT NULL AND p.rep_claim_id IS NOT NULL)"""

_ROUTED_SQL = f"""{_RECORDS},{a.REPORTS_SQL},{a.DECISIONS_SQL},
routed AS (
  SELECT r.*, coalesce(c.n, 0) AS unresolved_conflict_count,
         CASE severity WHEN 'LOW' THEN 'log' WHEN 'MEDIUM' THEN 'notify' WHEN 'HIGH' THEN 'alert' ELSE 'human_gate' END
           AS route,
         severity IN ('HIGH', 'CRITICAL') AS lists_actions, severity = 'CRITICAL' AS needs_approval,
         severity <> 'CRITICAL' AND coalesce(c.n, 0) > 0 AS needs_conflict_ack,
         CASE WHEN severity = 'CRITICAL' THEN accepted END AS human_approved,
         CASE WHEN severity <> 'CRITICAL' AND coalesce(c.n, 0) > 0 THEN accepted END AS conflicts_acknowledged
  FROM reports r
  LEFT JOIN (SELECT diagnosis_id, count(*) AS n FROM conflicts WHERE resolution = 'unresolved' GROUP BY ALL) c
    ON c.diagnosis_id = r.diagnosis_id
  LEFT JOIN decisions d ON d.incident_id = r.incident_id)"""

_AUDIT_SQL = f"""{_ROUTED_SQL},
audit AS (
  SELECT reported_at AS timestamp, r.incident_id, title, severity, r.anomaly_type, root_cause, human_approved,
         unresolved_conflict_count, conflicts_acknowledged, CAST(coalesce(cl.n, 0) AS INTEGER) AS claim_count,
         CAST(coalesce(co.n, 0) AS INTEGER) AS conflict_count, array_to_string(h.tools_used, ',') AS tools_used
  FROM routed r JOIN headers h ON h.diagnosis_id = r.diagnosis_id
  LEFT JOIN (SELECT diagnosis_id, count(*) AS n FROM claims GROUP BY ALL) cl ON cl.diagnosis_id = r.diagnosis_id
  LEFT JOIN (SELECT diagnosis_id, count(*) AS n FROM conflicts GROUP BY ALL) co ON co.diagnosis_id = r.diagnosis_id)"""

ORACLES = {
    "dup_ids": f"WITH {_RECORDS},{_DUPLICATES_SQL} SELECT diagnosis_id, id, copies, kind FROM duplicates",
    "dangling_claims": f"""WITH {_RECORDS},{_DANGLING_SQL}
        SELECT diagnosis_id, pos, claim_id, source_id, confidence FROM dangling_claims""",
    "dangling_conflicts": f"""WITH {_RECORDS},{_DANGLING_SQL}
        SELECT diagnosis_id, claim_id, conflict_id, side FROM dangling_conflicts""",
    "integrity_errors": f"""WITH {_RECORDS},{_DUPLICATES_SQL},{_DANGLING_SQL}
        SELECT diagnosis_id, CAST(min(check_no) AS INTEGER) AS "check" FROM (
          SELECT diagnosis_id, CASE kind WHEN 'source' THEN 1 ELSE 2 END AS check_no FROM duplicates
          UNION ALL SELECT diagnosis_id, 3 FROM dangling_claims
          UNION ALL SELECT diagnosis_id, 4 FROM dangling_conflicts) GROUP BY diagnosis_id""",
    "incident_integrity": f"""WITH {a.INCIDENT_SQL}
        SELECT incident_id, CAST(min(check_no) AS INTEGER) AS "check" FROM (
          SELECT incident_id, 1 AS check_no FROM incident_sources GROUP BY incident_id, source_id HAVING count(*) > 1
          UNION ALL SELECT incident_id, 2 FROM incident_claims GROUP BY incident_id, claim_id HAVING count(*) > 1
          UNION ALL SELECT incident_id, 3 FROM incident_claims WHERE confidence <> 'UNSOURCED'
            AND (incident_id, source_id) NOT IN (SELECT incident_id, source_id FROM incident_sources))
        GROUP BY incident_id""",
    "confidence_distribution": f"""WITH {_RECORDS},{_STATS_SQL}
        SELECT diagnosis_id, high, medium, low, unsourced FROM stats""",
    "low_conf_claims": f"""WITH {_RECORDS}
        SELECT diagnosis_id, pos, text FROM claims WHERE confidence IN ('LOW', 'UNSOURCED')""",
    "report_gate": f"""WITH {_RECORDS},{_STATS_SQL}
        SELECT diagnosis_id, anomaly_type, claims,
               CASE WHEN anomaly_type = 'parse_error' THEN 'diagnosis is a parse-error fallback (unstructured)'
                    WHEN claims = 0 THEN 'diagnosis has no claims to report on'
                    WHEN low + unsourced = claims
                    THEN 'all ' || claims || ' claims are LOW or UNSOURCED confidence' END AS reason
        FROM stats""",
    "representative_claims": f"WITH {_RECORDS},{_REPS_SQL} SELECT diagnosis_id, claim_id, rank FROM reps",
    "fork_primary": f"""WITH {_FORKS_SQL}
        SELECT incident_id, fork, diagnosis_id, rep_claim_id, rank, fork_count FROM forks WHERE preference = 1""",
    "fork_conflicts": f"WITH {_FORKS_SQL} SELECT * FROM cross_conflicts",
    "fork_merge": f"""WITH {_FORKS_SQL}
        SELECT p.incident_id, p.fork AS primary_fork, p.diagnosis_id AS primary_diagnosis_id, p.anomaly_type,
               p.summary AS root_cause, m.detected_at, m.fork_count, m.tools_used
        FROM forks p JOIN (
          SELECT incident_id, min(detected_at) AS detected_at, count(*) AS fork_count,
                 array_to_string(list_sort(list_distinct(flatten(list(tools_used)))), ',') AS tools_used
          FROM forks GROUP BY incident_id) m ON m.incident_id = p.incident_id
        WHERE p.preference = 1""",
    "fork_merge_sources": f"""WITH {_FORKS_SQL}
        SELECT incident_id, fork, pos, prefix || source_id AS source_id, tool_name, retrieved_at
        FROM sources s JOIN forks f ON f.diagnosis_id = s.diagnosis_id""",
    "fork_merge_claims": f"""WITH {_FORKS_SQL}
        SELECT incident_id, fork, pos, prefix || claim_id AS claim_id, text, prefix || source_id AS source_id, confidence
        FROM claims c JOIN forks f ON f.diagnosis_id = c.diagnosis_id""",
    "fork_merge_conflicts": f"""WITH {_FORKS_SQL}
        SELECT incident_id, fork, pos, prefix || conflict_id AS conflict_id, topic, prefix || claim_a_id AS claim_a_id,
               prefix || claim_b_id AS claim_b_id, resolution, notes, false AS between_forks
        FROM conflicts c JOIN forks f ON f.diagnosis_id = c.diagnosis_id
        UNION ALL
        SELECT incident_id, fork, 0 AS pos, conflict_id, topic, claim_a_id, claim_b_id, resolution, notes, true
        FROM cross_conflicts""",
    "fork_merge_components": f"""WITH {_FORKS_SQL},{a.COMPONENTS_SQL}
        SELECT incident_id, fork, pos, name, role, status, c.evidence
        FROM components c JOIN forks f ON f.diagnosis_id = c.diagnosis_id""",
    "fork_merge_evidence": f"""WITH {_FORKS_SQL},{a.EVIDENCE_SQL}
        SELECT incident_id, fork, pos, evidence FROM evidence e JOIN forks f ON f.diagnosis_id = e.diagnosis_id""",
    "diagnosis_size": f"""WITH {_RECORDS},{a.COMPONENTS_SQL},{a.EVIDENCE_SQL},
        s AS (SELECT diagnosis_id, list({{source_id: source_id, tool_name: tool_name, retrieved_at: retrieved_at,
                     raw_output: tool_name || ' ' || retrieved_at}}) AS l FROM sources GROUP BY ALL),
        c AS (SELECT diagnosis_id, list({{claim_id: claim_id, text: text, source_id: source_id, confidence: confidence}}) AS l
              FROM claims GROUP BY ALL),
        k AS (SELECT diagnosis_id, list({{conflict_id: conflict_id, topic: topic, claim_a_id: claim_a_id, claim_b_id: claim_b_id,
                     resolution: resolution, notes: notes}}) AS l FROM conflicts GROUP BY ALL),
        p AS (SELECT diagnosis_id, list({{name: name, role: role, status: status, evidence: evidence}}) AS l
              FROM components GROUP BY ALL),
        e AS (SELECT diagnosis_id, list(evidence) AS l FROM evidence GROUP BY ALL),
        sized AS (
          SELECT h.diagnosis_id, CAST(length(CAST(to_json({{
                   anomaly_type: anomaly_type, detected_at: detected_at, sources: coalesce(s.l, []), claims: coalesce(c.l, []),
                   conflicts: coalesce(k.l, []), affected_components: coalesce(p.l, []),
                   root_cause: {{summary: summary, confidence: 'medium', reasoning: 'seen', supporting_metrics: [anomaly_type]}},
                   tools_used: tools_used, raw_evidence: coalesce(e.l, [])}}) AS VARCHAR)) AS BIGINT) AS chars
          FROM headers h LEFT JOIN s USING (diagnosis_id) LEFT JOIN c USING (diagnosis_id) LEFT JOIN k USING (diagnosis_id)
          LEFT JOIN p USING (diagnosis_id) LEFT JOIN e USING (diagnosis_id))
        SELECT diagnosis_id, chars, CASE WHEN chars > 1500 THEN 'DiagnosisReport JSON exceeds max handoff size (' || chars
                 || ' > 1500 chars)' END AS reject_reason
        FROM sized""",
    "fallback_incidents": f"""WITH {a.HEADERS_SQL}
        SELECT substr(sha256(diagnosis_id || chr(31) || detected_at), 1, 8) AS incident_id, diagnosis_id,
               'Anomaly: ' || anomaly_type || ' (report agent unavailable)' AS title, 'MEDIUM' AS severity, summary,
               anomaly_type, summary AS root_cause, 'Detected at ' || detected_at AS timeline,
               CAST(0 AS INTEGER) AS actions, true AS requires_human_approval,
               'Report agent was unavailable; review diagnosis data directly' AS monitoring_notes
        FROM headers""",
    "unresolved_conflicts": f"""WITH {a.CONFLICTS_SQL}
        SELECT diagnosis_id, conflict_id, topic, claim_a_id, claim_b_id FROM conflicts
        WHERE resolution = 'unresolved'""",
    "route_incidents": f"""WITH {_ROUTED_SQL}
        SELECT incident_id, severity, unresolved_conflict_count, route, lists_actions, needs_approval,
               needs_conflict_ack, human_approved, conflicts_acknowledged FROM routed""",
    "audit_entries": f"WITH {_AUDIT_SQL} SELECT * FROM audit",
    "audit_query": f"""WITH {_AUDIT_SQL}
        SELECT * FROM audit WHERE severity = 'CRITICAL' AND anomaly_type = 'backpressure'
        ORDER BY timestamp, incident_id LIMIT 20""",
}
