"""Severity routing, approval gates and audit entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.keys import utc_now_iso
from tidewatch.rules import Rules

UNRESOLVED = "unresolved"


def unresolved_conflicts(conflicts: DataFrame) -> DataFrame:
    return conflicts.filter(F.col("resolution") == UNRESOLVED)


def accepted(answer: Column) -> Column:
    """True for y or yes, false for any other answer, null for none."""
    return F.lower(F.btrim(answer, F.lit(" \n\t\r"))).isin("y", "yes")


def route_incidents(
    incidents: DataFrame, conflicts: DataFrame | None = None, decisions: DataFrame | None = None
) -> DataFrame:
    """Where each incident goes, and which human gate it waits at.

    ``incidents`` is (incident_id, diagnosis_id, severity, ...), ``conflicts``
    the conflicts of the diagnoses, ``decisions`` (incident_id, answer), of
    which the latest by ``decided_at`` counts. Short incident ids may collide:
    decisions that carry a diagnosis_id are matched by that instead. A CRITICAL incident has one gate, for approval; below that, unresolved
    conflicts call for their own acknowledgement.
    """
    out = incidents
    if conflicts is None:
        out = out.withColumn("unresolved_conflict_count", F.lit(0).cast("long"))
    else:
        open_conflicts = (
            unresolved_conflicts(conflicts)
            .groupBy("diagnosis_id")
            .agg(F.count("*").alias("unresolved_conflict_count"))
        )
        out = out.join(open_conflicts, "diagnosis_id", "left").fillna(0, ["unresolved_conflict_count"])
    if decisions is None:
        out = out.withColumn("answer", F.lit(None).cast("string"))
    else:
        key = "diagnosis_id" if "diagnosis_id" in decisions.columns else "incident_id"
        when = "decided_at" if "decided_at" in decisions.columns else "answer"
        last = decisions.groupBy(key).agg(F.max_by("answer", F.struct(when, "answer")).alias("answer"))
        out = out.join(last, key, "left")
    severity = F.col("severity")
    critical = severity == "CRITICAL"
    route = (
        F.when(severity == "LOW", "log")
        .when(severity == "MEDIUM", "notify")
        .when(severity == "HIGH", "alert")
        .when(critical, "human_gate")
    )
    needs_ack = ~critical & (F.col("unresolved_conflict_count") > 0)
    answer = accepted(F.col("answer"))
    return (
        out.withColumn("route", route)
        .withColumn("lists_actions", severity.isin("HIGH", "CRITICAL"))
        .withColumn("needs_approval", critical)
        .withColumn("needs_conflict_ack", needs_ack)
        .withColumn("human_approved", F.when(critical, answer))
        .withColumn("conflicts_acknowledged", F.when(needs_ack, answer))
        .drop("answer")
    )


def audit_entries(routed: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """AUDIT rows of routed incidents.

    A ``diagnosis`` struct column, or the columns ``sources_consulted``,
    ``claim_count``, ``conflict_count`` and ``tools_used``, fill the diagnosis
    block; without them it is null.
    """
    block_type = "struct<sources_consulted:array<string>,claim_count:int,conflict_count:int,tools_used:array<string>>"
    if "diagnosis" in routed.columns:
        d = F.col("diagnosis")
        block = F.when(
            d.isNotNull(),
            F.struct(
                F.transform(d["sources"], lambda s: s["tool_name"]).alias("sources_consulted"),
                F.size(d["claims"]).alias("claim_count"),
                F.size(d["conflicts"]).alias("conflict_count"),
                d["tools_used"].alias("tools_used"),
            ),
        )
    elif "sources_consulted" in routed.columns:
        block = F.struct(
            "sources_consulted",
            F.col("claim_count").cast("int").alias("claim_count"),
            F.col("conflict_count").cast("int").alias("conflict_count"),
            "tools_used",
        )
    else:
        block = F.lit(None).cast(block_type)

    def own(name: str, kind: str) -> Column:
        return (F.col(name) if name in routed.columns else F.lit(None)).cast(kind).alias(name)

    actions = "array<struct<action:string,rationale:string,risk:string,requires_downtime:boolean>>"
    return routed.select(
        (utc_now_iso() if timestamp is None else timestamp).alias("timestamp"),
        F.col("incident_id").cast("string").alias("incident_id"),
        own("title", "string"),
        "severity",
        own("anomaly_type", "string"),
        own("root_cause", "string"),
        own("summary", "string"),
        own("affected_components", "array<string>"),
        own("recommended_actions", actions),
        own("low_confidence_claims", "array<string>"),
        own("requires_human_approval", "boolean"),
        "human_approved",
        "unresolved_conflict_count",
        "conflicts_acknowledged",
        block.alias("diagnosis"),
    )


def audit_query(
    audit: DataFrame,
    severity: str | None = None,
    anomaly_type: str | None = None,
    limit: int | None = None,
    rules: Rules = Rules(),
) -> DataFrame:
    """All matching entries in time order; with a limit the first ones, at least one even for a limit of 0."""
    out = audit
    if severity:
        out = out.filter(F.col("severity") == severity)
    if anomaly_type:
        out = out.filter(F.col("anomaly_type") == anomaly_type)
    n = rules.audit_limit if limit is None else limit
    out = out.orderBy("timestamp", "incident_id")
    return out if n is None else out.limit(max(1, n))
