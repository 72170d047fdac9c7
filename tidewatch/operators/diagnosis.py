"""Diagnosis records: integrity checks, confidence, gates and merging of forks.

Records are flat tables keyed by ``diagnosis_id``: a header per diagnosis, and
child tables of sources, claims and conflicts with their position ``pos``. A
merged diagnosis stays flat as well, so an incident with very many claims is
many rows, never one growing group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.keys import confidence_rank, is_low, short_id
from tidewatch.functions.text import prefix
from tidewatch.operators.numbering import numbered
from tidewatch.operators.skew import salted_join
from tidewatch.rules import Rules
from tidewatch.schema import DIAGNOSIS, INCIDENT

#: Forks of one incident that are joined with its primary fork in one task, as a power of two.
FORK_BLOCK_BITS = 16
CONFIDENCES = ["HIGH", "MEDIUM", "LOW", "UNSOURCED"]


# Nested records to flat tables, and records made from others.


def explode_diagnoses(diagnoses: DataFrame) -> dict[str, DataFrame]:
    """Split rows of (diagnosis_id, diagnosis) into header and child tables."""

    def child(name: str) -> DataFrame:
        return diagnoses.select(
            "diagnosis_id", F.posexplode(f"diagnosis.{name}").alias("pos", "r")
        ).select("diagnosis_id", "pos", "r.*")

    keys = [c for c in ("incident_id", "fork") if c in diagnoses.columns]
    header = diagnoses.select(
        "diagnosis_id",
        *keys,
        "diagnosis.anomaly_type",
        "diagnosis.detected_at",
        "diagnosis.root_cause",
        F.coalesce("diagnosis.tools_used", F.array().cast("array<string>")).alias("tools_used"),
    )
    return {
        "diagnoses": header,
        "sources": child("sources"),
        "claims": child("claims"),
        "conflicts": child("conflicts"),
        "components": child("affected_components"),
    }


def diagnosis_from_anomaly(anomalies: DataFrame) -> DataFrame:
    """Diagnosis of a bare anomaly: no claims, the summary as its root cause."""
    empty = F.array()
    root = F.struct(
        F.col("summary").alias("summary"),
        F.lit("medium").alias("confidence"),
        F.col("summary").alias("reasoning"),
        F.array_compact(F.array("metric", "observed_value")).alias("supporting_metrics"),
    )
    keys = [c for c in anomalies.columns if c in ("cycle", "diagnosis_id", "incident_id")]
    return anomalies.select(
        *keys,
        "anomaly_type",
        "detected_at",
        empty.cast("array<struct<source_id:string,tool_name:string,retrieved_at:string,raw_output:string>>").alias(
            "sources"
        ),
        empty.cast("array<struct<claim_id:string,text:string,source_id:string,confidence:string>>").alias("claims"),
        empty.cast(
            "array<struct<conflict_id:string,topic:string,claim_a_id:string,claim_b_id:string,"
            "resolution:string,notes:string>>"
        ).alias("conflicts"),
        empty.cast("array<struct<name:string,role:string,status:string,evidence:string>>").alias(
            "affected_components"
        ),
        root.alias("root_cause"),
        empty.cast("array<string>").alias("tools_used"),
        F.array("summary").alias("raw_evidence"),
    )


def fallback_incidents(diagnoses: DataFrame, parse_failure: bool = False) -> DataFrame:
    """MEDIUM incident for a diagnosis whose report is missing or did not parse.

    ``diagnoses`` are flat headers (diagnosis_id, anomaly_type, detected_at,
    root_cause), or rows of DIAGNOSIS, whose components, sources and claims the
    incident then carries along.
    """
    # The wording of a report that nobody wrote.
    suffix = "" if parse_failure else " (report agent unavailable)"
    notes = (
        "Monitor after remediation"
        if parse_failure
        else "Report agent was unavailable; review diagnosis data directly"
    )

    def own(name: str, kind: T.DataType, value: Column | None = None) -> Column:
        there = name in diagnoses.columns
        return F.coalesce((F.col(name) if value is None else value), F.array().cast(kind)) if there else F.array().cast(kind)

    names = F.transform("affected_components", lambda c: c["name"]) if "affected_components" in diagnoses.columns else None
    claims = own("claims", INCIDENT["supporting_claims"].dataType)
    return diagnoses.select(
        short_id(F.col("diagnosis_id"), F.col("detected_at")).alias("incident_id"),
        "diagnosis_id",
        F.concat(F.lit("Anomaly: "), "anomaly_type", F.lit(suffix)).alias("title"),
        F.lit("MEDIUM").alias("severity"),
        F.col("root_cause.summary").alias("summary"),
        "anomaly_type",
        F.col("root_cause.summary").alias("root_cause"),
        own("affected_components", INCIDENT["affected_components"].dataType, names).alias("affected_components"),
        F.array(F.concat(F.lit("Detected at "), "detected_at")).alias("timeline"),
        F.array().cast(INCIDENT["recommended_actions"].dataType).alias("recommended_actions"),
        low_claim_texts(claims).alias("low_confidence_claims"),
        F.lit(True).alias("requires_human_approval"),
        F.lit(notes).alias("monitoring_notes"),
        own("sources", INCIDENT["sources"].dataType).alias("sources"),
        claims.alias("supporting_claims"),
    )


def low_claim_texts(claims: Column) -> Column:
    """Texts of the LOW and UNSOURCED claims of an array."""
    return F.transform(F.filter(claims, lambda c: is_low(c["confidence"])), lambda c: c["text"])


def with_fallback(reports: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """(diagnosis_id, parsed, INCIDENT columns): the report on each diagnosis, or the fallback on it.

    ``reports`` is (diagnosis_id, incident), null where a report did not parse;
    ``diagnoses`` is (diagnosis_id, DIAGNOSIS columns). Either way sources and
    claims are those of the diagnosis.
    """
    spare = fallback_incidents(diagnoses, parse_failure=True)
    given = F.struct(*[F.col(f"incident.{n}").alias(n) for n in INCIDENT.names])
    both = reports.select("diagnosis_id", F.when(F.col("incident").isNotNull(), given).alias("_given")).join(
        spare.select("diagnosis_id", F.struct(*INCIDENT.names).alias("_spare")), "diagnosis_id"
    )
    chosen = both.select(
        "diagnosis_id",
        F.col("_given").isNotNull().alias("parsed"),
        F.coalesce("_given", "_spare").alias("i"),
        F.col("_spare.sources").alias("sources"),
        F.col("_spare.supporting_claims").alias("supporting_claims"),
        F.col("_spare.low_confidence_claims").alias("low"),
    )
    own = F.col("i.low_confidence_claims")
    replaced = {
        "sources": F.col("sources"),
        "supporting_claims": F.col("supporting_claims"),
        "low_confidence_claims": F.when(F.size(own) > 0, own).otherwise(F.col("low")),
    }
    return chosen.select(
        "diagnosis_id", "parsed", *[replaced.get(n, F.col(f"i.{n}")).alias(n) for n in INCIDENT.names]
    )


def attach_attribution(incidents: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Replace sources and claims of nested incidents by those of their diagnosis.

    The report's own low-confidence list stays, unless it is empty.
    """
    theirs = diagnoses.select(
        "diagnosis_id",
        F.col("diagnosis.sources").alias("sources"),
        F.col("diagnosis.claims").alias("supporting_claims"),
    )
    low = low_claim_texts(F.col("supporting_claims"))
    own = F.col("low_confidence_claims")
    return (
        incidents.drop("sources", "supporting_claims")
        .join(theirs, "diagnosis_id")
        .withColumn("low_confidence_claims", F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(low))
    )


def cut_summaries(anomalies: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Summaries as they are, or no longer than ``rules.summary_max_chars``."""
    return anomalies.withColumn("summary", prefix(F.col("summary"), rules.summary_max_chars))


def size_check(diagnoses: DataFrame, rules: Rules = Rules(), column: str = "diagnosis_json") -> DataFrame:
    """Length of each serialised diagnosis, and a reason where it is over the limit."""
    return _with_reason(diagnoses.withColumn("chars", F.length(column).cast("long")), rules)


def _with_reason(sized: DataFrame, rules: Rules) -> DataFrame:
    reason = F.concat(
        F.lit("DiagnosisReport JSON exceeds max handoff size ("),
        F.col("chars").cast("string"),
        F.lit(f" > {rules.handoff_max_chars} chars)"),
    )
    return sized.withColumn("reject_reason", F.when(F.col("chars") > rules.handoff_max_chars, reason))


def diagnosis_size(headers: DataFrame, children: dict[str, DataFrame], rules: Rules = Rules()) -> DataFrame:
    """(diagnosis_id, chars, reject_reason): length of each diagnosis as one compact JSON text.

    ``headers`` is (diagnosis_id, anomaly_type, detected_at, root_cause,
    tools_used); ``children`` holds the flat tables sources, claims, conflicts,
    affected_components, with the fields of DIAGNOSIS, and raw_evidence, with
    ``evidence``. The text is never made: each row adds its own length and a
    comma, so a diagnosis with very many claims is summed up like any other.
    """
    texts = {"ignoreNullFields": "false"}
    empty = [F.array().cast(DIAGNOSIS[n].dataType).alias(n) for n in children]
    given = {"root_cause", "tools_used", "anomaly_type", "detected_at"}
    by_name = {n: F.col(n) for n in given} | dict(zip(children, empty, strict=True))
    head = F.struct(*[by_name[n].alias(n) for n in DIAGNOSIS.names if n in by_name])
    # Every list, and the header, has a bit of its own.
    parts = headers.select("diagnosis_id", F.lit(1).alias("list"), (F.length(F.to_json(head, texts)) + 1).alias("chars"))
    for i, (name, table) in enumerate(children.items(), 1):
        kind = DIAGNOSIS[name].dataType.elementType
        if isinstance(kind, T.StructType):
            row = F.length(F.to_json(F.struct(*[F.col(f) for f in kind.names]), texts))
        else:
            # Quotes around a text, whose escapes show in an object that holds it.
            row = F.length(F.to_json(F.struct(F.col("evidence").alias("e")), texts)) - len('{"e":}')
        parts = parts.unionByName(table.select("diagnosis_id", F.lit(1 << i).alias("list"), (row + 1).alias("chars")))
    # The first row of each list has no comma before it, and neither has the header.
    sized = parts.groupBy("diagnosis_id").agg((F.sum("chars") - F.bit_count(F.bit_or("list"))).alias("chars"))
    return _with_reason(sized, rules)


# Integrity.


def duplicate_ids(children: DataFrame, id_column: str) -> DataFrame:
    """(diagnosis_id, id, copies) of ids that occur more than once in a diagnosis."""
    return (
        children.groupBy("diagnosis_id", F.col(id_column).alias("id"))
        .agg(F.count("*").alias("copies"))
        .filter(F.col("copies") > 1)
    )


def dangling_claims(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims whose source is not among those of their diagnosis; UNSOURCED ones are exempt."""
    known = sources.select("diagnosis_id", "source_id").distinct()
    return salted_join(
        claims.filter(F.col("confidence") != "UNSOURCED"), known, ["diagnosis_id", "source_id"], "left_anti"
    )


def dangling_conflicts(conflicts: DataFrame, claims: DataFrame) -> DataFrame:
    """(diagnosis_id, conflict_id, side, claim_id) for each side that names no claim."""
    sides = conflicts.select(
        "diagnosis_id",
        "conflict_id",
        F.explode(
            F.array(
                F.struct(F.lit("a").alias("side"), F.col("claim_a_id").alias("claim_id")),
                F.struct(F.lit("b").alias("side"), F.col("claim_b_id").alias("claim_id")),
            )
        ).alias("s"),
    ).select("diagnosis_id", "conflict_id", "s.side", "s.claim_id")
    known = claims.select("diagnosis_id", "claim_id").distinct()
    return salted_join(sides, known, ["diagnosis_id", "claim_id"], "left_anti")


def integrity_errors(
    sources: DataFrame, claims: DataFrame, conflicts: DataFrame | None = None, key: str = "diagnosis_id"
) -> DataFrame:
    """First failed check per record: 1, 2 duplicate source or claim ids, 3 claim without
    its source, 4 conflict without its claim. Records without a row are sound.

    Each row marks the ids that it defines and those that it cites. The marks of
    one id of one record are added up, so each table is read once, and a record
    with very many rows is spread by its ids.
    """

    def defined(df: DataFrame, is_source: bool, id_column: str) -> DataFrame:
        return df.select(key, F.lit(is_source).alias("is_source"), F.col(id_column).alias("id"), F.lit(1).alias("defined"))

    def cited(is_source: bool, id_column: str) -> Column:
        return F.struct(F.lit(is_source).alias("is_source"), F.col(id_column).alias("id"), F.lit(0).alias("defined"))

    own = F.struct(F.lit(False).alias("is_source"), F.col("claim_id").alias("id"), F.lit(1).alias("defined"))
    both = F.array(own, cited(True, "source_id"))
    each = F.when(F.col("confidence") != "UNSOURCED", both).otherwise(F.array(own))
    marks = defined(sources, True, "source_id").unionByName(claims.select(key, F.inline(each)))
    if conflicts is not None:
        sides = F.array(cited(False, "claim_a_id"), cited(False, "claim_b_id"))
        marks = marks.unionByName(conflicts.select(key, F.inline(sides)))
    copies, is_source = F.col("copies"), F.col("is_source")
    check = F.when(copies > 1, F.when(is_source, 1).otherwise(2)).when(copies == 0, F.when(is_source, 3).otherwise(4))
    return (
        marks.groupBy(key, "is_source", "id")
        .agg(F.sum("defined").alias("copies"))
        .select(key, check.alias("check"))
        .filter(F.col("check").isNotNull())
        .groupBy(key)
        .agg(F.min("check").alias("check"))
    )


# Confidence and gate.


def _claim_stats(claims: DataFrame) -> DataFrame:
    return claims.groupBy("diagnosis_id").agg(
        *[F.count_if(F.col("confidence") == c).alias(c.lower()) for c in CONFIDENCES],
        F.count("*").alias("claims"),
        F.count_if(is_low(F.col("confidence"))).alias("low_claims"),
    )


def claim_stats(diagnoses: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims per confidence level and in all, zeros included."""
    counts = [c.lower() for c in CONFIDENCES] + ["claims", "low_claims"]
    return diagnoses.join(_claim_stats(claims), "diagnosis_id", "left").fillna(0, counts)


def confidence_distribution(diagnoses: DataFrame, claims: DataFrame) -> DataFrame:
    counted = claim_stats(diagnoses.select("diagnosis_id"), claims)
    return counted.select("diagnosis_id", *[c.lower() for c in CONFIDENCES])


def all_claims_low() -> Column:
    """Over ``claim_stats``: there are claims, and all of them are LOW or UNSOURCED."""
    return (F.col("claims") > 0) & (F.col("claims") == F.col("low_claims"))


def low_confidence_claims(claims: DataFrame) -> DataFrame:
    return claims.filter(is_low(F.col("confidence")))


def report_gate(diagnoses: DataFrame, claims: DataFrame) -> DataFrame:
    """Reason not to report a diagnosis; null where it is fit to be reported."""
    reason = (
        F.when(
            F.col("anomaly_type") == "parse_error", "diagnosis is a parse-error fallback (unstructured)"
        )
        .when(F.col("claims") == 0, "diagnosis has no claims to report on")
        .when(
            all_claims_low(),
            F.concat(
                F.lit("all "), F.col("claims").cast("string"), F.lit(" claims are LOW or UNSOURCED confidence")
            ),
        )
    )
    counted = claim_stats(diagnoses.select("diagnosis_id", "anomaly_type"), claims)
    return counted.select("diagnosis_id", "anomaly_type", "claims", reason.alias("reason"))


# Forks.


def number_survivors(diagnoses: DataFrame) -> DataFrame:
    """Renumber the forks of each incident 0, 1, ... after some have failed."""
    kept = [c for c in diagnoses.columns if c != "fork"]
    return numbered(diagnoses, "incident_id", "fork", "_fork").select(*kept, F.col("_fork").alias("fork"))


def representative_claims(claims: DataFrame) -> DataFrame:
    """(diagnosis_id, claim_id, rank): the claim of highest confidence, the first on ties."""
    rank = confidence_rank(F.col("confidence"))
    best = F.max(F.struct(rank.alias("rank"), (-F.col("pos")).alias("back"), F.col("claim_id").alias("id")))
    return claims.groupBy("diagnosis_id").agg(best.alias("b")).select(
        "diagnosis_id", F.col("b.id").alias("claim_id"), F.col("b.rank").alias("rank")
    )


def forks(diagnoses: DataFrame, claims: DataFrame) -> DataFrame:
    """Diagnosis headers with their representative claim, and the primary fork of the incident.

    The primary fork has the claim of highest confidence; no claim ranks below
    any; the lowest fork wins ties.
    """
    reps = representative_claims(claims)
    ranked = diagnoses.join(
        reps.select("diagnosis_id", F.col("claim_id").alias("rep_claim_id"), "rank"), "diagnosis_id", "left"
    ).withColumn("rank", F.coalesce("rank", F.lit(-1)))
    best = F.max(
        F.struct(
            "rank",
            (-F.col("fork")).alias("back"),
            F.col("fork").alias("fork"),
            F.col("diagnosis_id").alias("diagnosis_id"),
            F.col("rep_claim_id").alias("rep_claim_id"),
            F.col("anomaly_type").alias("anomaly_type"),
            F.col("summary").alias("summary"),
        )
    )
    # Reduced before the shuffle, and joined back by blocks of forks: no task holds a whole incident.
    block = F.shiftright("fork", FORK_BLOCK_BITS)
    partial = ranked.groupBy("incident_id", block.alias("_block")).agg(best.alias("best"), F.count("*").alias("n"))
    primaries = partial.groupBy("incident_id").agg(
        F.max("best").alias("primary"), F.sum("n").alias("fork_count"), F.collect_set("_block").alias("_blocks")
    )
    spread = primaries.select("incident_id", "primary", "fork_count", F.explode("_blocks").alias("_block"))
    return ranked.withColumn("_block", block).join(spread, ["incident_id", "_block"]).drop("_block")


def fork_prefix() -> Column:
    """'f<fork>:' over ``forks``; an incident with one fork keeps its ids."""
    many = F.col("fork_count") > 1
    return F.when(many, F.concat(F.lit("f"), F.col("fork").cast("string"), F.lit(":"))).otherwise("")


def cross_fork_conflicts(forked: DataFrame) -> DataFrame:
    """Unresolved conflict of the primary fork with each fork of another anomaly type."""
    differs = (
        (F.col("fork") != F.col("primary.fork"))
        & (F.col("anomaly_type") != F.col("primary.anomaly_type"))
        & F.col("rep_claim_id").isNotNull()
        & F.col("primary.rep_claim_id").isNotNull()
    )
    p, i = F.col("primary.fork").cast("string"), F.col("fork").cast("string")
    return forked.filter(differs).select(
        "incident_id",
        "fork",
        F.concat(F.lit("xf-"), p, F.lit("-"), i).alias("conflict_id"),
        F.lit("cross-fork root-cause disagreement").alias("topic"),
        F.concat(F.lit("f"), p, F.lit(":"), F.col("primary.rep_claim_id")).alias("claim_a_id"),
        F.concat(F.lit("f"), i, F.lit(":"), F.col("rep_claim_id")).alias("claim_b_id"),
        F.lit("unresolved").alias("resolution"),
        F.concat(
            F.lit("Fork "), p, F.lit(" concluded '"), F.col("primary.anomaly_type"), F.lit("' ("),
            F.col("primary.summary"), F.lit("); fork "), i, F.lit(" concluded '"), F.col("anomaly_type"),
            F.lit("' ("), F.col("summary"), F.lit(")"),
        ).alias("notes"),
    )


def merged_headers(forked: DataFrame) -> DataFrame:
    """One diagnosis per incident: type and cause of the primary fork, earliest time, all tools."""
    tools = F.explode_outer("tools_used").alias("tool")
    # Tools are few distinct names: reduce to those before they are gathered.
    per_tool = (
        forked.select("incident_id", tools).filter(F.col("tool").isNotNull()).distinct()
        .groupBy("incident_id").agg(F.array_sort(F.collect_set("tool")).alias("tools_used"))
    )
    heads = forked.groupBy("incident_id").agg(
        F.first("primary").alias("p"), F.min("detected_at").alias("detected_at"),
        F.count("*").alias("fork_count"),
    )
    return heads.join(per_tool, "incident_id", "left").select(
        "incident_id",
        F.col("p.fork").alias("primary_fork"),
        F.col("p.diagnosis_id").alias("primary_diagnosis_id"),
        F.col("p.anomaly_type").alias("anomaly_type"),
        F.col("p.summary").alias("root_cause"),
        "detected_at",
        "fork_count",
        F.coalesce("tools_used", F.array().cast("array<string>")).alias("tools_used"),
    )


def merged_children(forked: DataFrame, children: DataFrame, ids: list[str]) -> DataFrame:
    """Child rows of all forks under their incident, ids prefixed by the fork.

    The order of the merged list is (fork, pos).
    """
    head = forked.select("incident_id", "fork", "diagnosis_id", fork_prefix().alias("_prefix"))
    joined = salted_join(children, head, ["diagnosis_id"], "inner")
    for c in ids:
        joined = joined.withColumn(c, F.concat("_prefix", c))
    rest = [c for c in children.columns if c not in ("diagnosis_id", "pos")]
    return joined.select("incident_id", "fork", "pos", *rest)


def merged_conflicts(forked: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The forks' own conflicts, followed by those between forks."""
    own = merged_children(forked, conflicts, ["conflict_id", "claim_a_id", "claim_b_id"])
    own = own.withColumn("between_forks", F.lit(False))
    new = cross_fork_conflicts(forked).withColumn("pos", F.lit(0)).withColumn("between_forks", F.lit(True))
    return own.unionByName(new.select(*own.columns))
