"""Typed records from free text that should hold JSON, with a fallback record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.keys import utc_now_iso
from tidewatch.functions.text import json_block, prefix
from tidewatch.schema import ANOMALY, DIAGNOSIS, INCIDENT

# What a record says that could not be parsed, and the levels of confidence and severity.
_UNPARSED_SUMMARY = "Agent response could not be parsed as structured output"
_CONFIDENCES = ["HIGH", "MEDIUM", "LOW", "UNSOURCED"]
_SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def _parsed(texts: DataFrame, text: str, schema: T.StructType) -> DataFrame:
    """Add ``_r``, the record of each text, in a projection of its own: it is parsed once."""
    wide = T.StructType(list(schema.fields)).add("_bad", T.StringType())
    options = {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}
    return texts.withColumn("_r", F.from_json(json_block(F.col(text)), wide, options))


def _all_set(items: Column, fields: list[str]) -> Column:
    def whole(item: Column) -> Column:
        ok = item.isNotNull()
        for f in fields:
            ok = ok & item[f].isNotNull()
        return ok

    return F.coalesce(F.forall(items, whole), F.lit(True))


def parse_anomalies(
    texts: DataFrame, text: str = "text", now: Column | None = None, quote_chars: int | None = None
) -> DataFrame:
    """Add ``anomaly``: the ANOMALY in each text, or one of type unknown that quotes the text.

    The whole text is quoted unless ``quote_chars`` cuts it.
    """
    c = F.col(text)
    a = F.col("_r")
    sound = a["_bad"].isNull() & a["anomaly_type"].isNotNull() & a["summary"].isNotNull() & a["detected_at"].isNotNull()
    blank = {f.name: F.lit(None).cast(f.dataType) for f in ANOMALY.fields}
    blank |= {
        "anomaly_type": F.lit("unknown"),
        "summary": prefix(c, quote_chars),
        "detected_at": utc_now_iso() if now is None else now,
        "source_signal_ids": F.array().cast("array<string>"),
    }
    fallback = F.struct(*[v.alias(k) for k, v in blank.items()])
    signals = F.coalesce(a["source_signal_ids"], blank["source_signal_ids"]).alias("source_signal_ids")
    kept = F.struct(*[a[n] for n in ANOMALY.names[:-1]], signals)
    chosen = F.when(sound, kept).otherwise(fallback)
    return _parsed(texts, text, ANOMALY).withColumn("anomaly", chosen).drop("_r")


def parse_diagnoses(
    texts: DataFrame, text: str = "text", now: Column | None = None, quote_chars: int | None = None
) -> DataFrame:
    """Add ``diagnosis``: the DIAGNOSIS in each text, or a parse_error one that quotes the text.

    A record is taken only with all its required fields; ids that do not refer
    to anything are left to the integrity checks.
    """
    c = F.col(text)
    d = F.col("_r")
    required = ["anomaly_type", "detected_at", "affected_components", "root_cause", "tools_used"]
    sound = d.isNotNull() & d["_bad"].isNull()
    for f in required:
        sound = sound & d[f].isNotNull()
    for f in ("summary", "confidence", "reasoning"):
        sound = sound & d["root_cause"][f].isNotNull()
    sound = (
        sound
        & _all_set(d["sources"], ["source_id", "tool_name", "retrieved_at", "raw_output"])
        & _all_set(d["claims"], ["claim_id", "text", "source_id", "confidence"])
        & _all_set(d["conflicts"], ["conflict_id", "topic", "claim_a_id", "claim_b_id"])
        & _all_set(d["affected_components"], ["name", "role", "status", "evidence"])
        & F.coalesce(F.forall(d["claims"], lambda x: x["confidence"].isin(*_CONFIDENCES)), F.lit(True))
    )

    def empty(name: str) -> Column:
        return F.array().cast(DIAGNOSIS[name].dataType)

    conflicts = F.transform(
        F.coalesce(d["conflicts"], empty("conflicts")),
        lambda x: x.withField("resolution", F.coalesce(x["resolution"], F.lit("unresolved"))).withField(
            "notes", F.coalesce(x["notes"], F.lit(""))
        ),
    )
    cause = d["root_cause"]
    metrics = F.coalesce(cause["supporting_metrics"], F.array().cast("array<string>"))
    changed = {
        "conflicts": conflicts,
        "root_cause": F.struct(
            cause["summary"], cause["confidence"], cause["reasoning"], metrics.alias("supporting_metrics")
        ),
    } | {n: F.coalesce(d[n], empty(n)) for n in ("sources", "claims", "raw_evidence")}
    kept = F.struct(*[changed.get(n, d[n]).alias(n) for n in DIAGNOSIS.names])
    fallback = F.struct(
        F.lit("parse_error").alias("anomaly_type"),
        (utc_now_iso() if now is None else now).alias("detected_at"),
        *[empty(n).alias(n) for n in ("sources", "claims", "conflicts", "affected_components")],
        F.struct(
            F.lit(_UNPARSED_SUMMARY).alias("summary"),
            F.lit("low").alias("confidence"),
            prefix(c, quote_chars).alias("reasoning"),
            F.array().cast("array<string>").alias("supporting_metrics"),
        ).alias("root_cause"),
        empty("tools_used").alias("tools_used"),
        F.array(prefix(c, quote_chars)).alias("raw_evidence"),
    )
    chosen = F.when(sound, kept).otherwise(fallback)
    return _parsed(texts, text, DIAGNOSIS).withColumn("diagnosis", chosen).drop("_r")


def parse_incidents(texts: DataFrame, text: str = "text") -> DataFrame:
    """Add ``incident``: the INCIDENT in each report text, null where there is no whole one.

    Without approval, claims or sources of its own a report gets the defaults:
    approval is required, the lists are empty. ``with_fallback`` of the
    diagnosis operators fills the gaps.
    """
    i = F.col("_r")
    required = [
        "incident_id", "title", "severity", "summary", "anomaly_type", "root_cause", "affected_components", "timeline",
        "recommended_actions", "monitoring_notes",
    ]
    sound = i.isNotNull() & i["_bad"].isNull() & i["severity"].isin(*_SEVERITIES)
    for f in required:
        sound = sound & i[f].isNotNull()
    sound = (
        sound
        & _all_set(i["recommended_actions"], ["action", "rationale", "risk", "requires_downtime"])
        & _all_set(i["sources"], ["source_id", "tool_name", "retrieved_at", "raw_output"])
        & _all_set(i["supporting_claims"], ["claim_id", "text", "source_id", "confidence"])
    )
    changed = {"requires_human_approval": F.coalesce(i["requires_human_approval"], F.lit(True))} | {
        n: F.coalesce(i[n], F.array().cast(INCIDENT[n].dataType))
        for n in ("low_confidence_claims", "sources", "supporting_claims")
    }
    record = F.struct(*[changed.get(n, i[n]).alias(n) for n in INCIDENT.names])
    return _parsed(texts, text, INCIDENT).withColumn("incident", F.when(sound, record)).drop("_r")
