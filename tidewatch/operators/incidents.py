"""Incident tracking over monitoring cycles.

Detections hold at most one row per (cycle, fingerprint). The rows of one
fingerprint are therefore bounded by the number of cycles, not by the volume of
telemetry, which is what lets a plain window order them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.keys import fingerprint, utc_iso, worsened
from tidewatch.functions.text import leading_number, two_decimals
from tidewatch.rules import Rules

# Anomaly type of each alerting metric, and the unit shown after its value.
METRIC_ANOMALY = {
    "latency_ms": "latency_spike",
    "records_per_second": "throughput_drop",
    "consumer_lag": "throughput_drop",
    "backpressure_ratio": "backpressure",
    "checkpoint_duration_ms": "checkpoint_failure",
    "heap_usage_percent": "memory_pressure",
    "error_rate_high": "error_burst",
}
UNITS = {"latency_ms": "ms", "checkpoint_duration_ms": "ms", "heap_usage_percent": "%"}


def _literal_lookup(table: dict[str, str], key: Column, default: str) -> Column:
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(literal, key), F.lit(default))


def anomalies_from_alerts(alerts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """At most one anomaly per (cycle, type, component): the alert furthest over its limit."""
    cycle = F.floor(F.col("timestamp_ms") / (rules.interval_seconds * 1000)).cast("long")
    metric = F.regexp_replace("rule", "_(threshold|baseline_deviation)$", "")
    excess = F.col("actual") / F.when(F.col("threshold") != 0, F.col("threshold"))
    best = F.max(
        F.struct(
            excess.alias("excess"), "actual", "timestamp_ms", "event_id", "metric", "threshold", "rule"
        )
    )
    worst = (
        alerts.withColumn("metric", metric)
        .withColumn("cycle", cycle)
        .withColumn("anomaly_type", _literal_lookup(METRIC_ANOMALY, F.col("metric"), "unknown"))
        .groupBy("cycle", "anomaly_type", F.col("component").alias("affected_component"))
        .agg(best.alias("a"))
    )
    observed = F.concat(
        two_decimals(F.col("a.actual")), _literal_lookup(UNITS, F.col("a.metric"), "")
    )
    direction = F.when(F.col("a.actual") < F.col("a.threshold"), "below").otherwise("above")
    limit = two_decimals(F.col("a.threshold"))
    is_deviation = F.endswith("a.rule", F.lit("_baseline_deviation"))
    return worst.select(
        "cycle",
        "anomaly_type",
        F.concat_ws(" ", "a.metric", observed, direction, limit, F.lit("on"), "affected_component").alias(
            "summary"
        ),
        utc_iso(F.timestamp_millis("a.timestamp_ms")).alias("detected_at"),
        F.col("a.metric").alias("metric"),
        observed.alias("observed_value"),
        F.when(is_deviation, limit).alias("baseline"),
        F.when(~is_deviation, limit).alias("threshold"),
        direction.alias("breach_direction"),
        "affected_component",
        F.array(F.col("a.event_id").cast("string")).alias("source_signal_ids"),
    )


def track_incidents(detections: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Status, occurrences and reporting decision of every detection.

    Needs (cycle, anomaly_type, affected_component, observed_value, delivered);
    ``delivered`` tells whether a report of that cycle reached its reader, if
    one was due.
    """
    own = Window.partitionBy("fingerprint").orderBy("cycle")
    island = Window.partitionBy("fingerprint", "_island").orderBy("cycle")
    earlier = island.rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("cycle") - F.lag("cycle").over(own)
    marked = (
        detections.withColumn("fingerprint", fingerprint(F.col("anomaly_type"), F.col("affected_component")))
        .withColumn("value", leading_number(F.col("observed_value")))
        .withColumn("_new", F.coalesce(gap > rules.ongoing_gap, F.lit(True)))
        .withColumn("_prior", F.lag("value").over(own))
        .withColumn("_island", F.sum(F.col("_new").cast("int")).over(own))
    )
    status = (
        F.when(F.col("_new"), "new")
        .when(worsened(F.col("_prior"), F.col("value"), rules.worsen_pct), "worsening")
        .otherwise("ongoing")
    )
    reported = F.coalesce(F.max("delivered").over(earlier), F.lit(False))
    return (
        marked.withColumn("status", status)
        .withColumn("occurrences", F.row_number().over(island).cast("long"))
        .withColumn("_reported", reported)
        .withColumn(
            "should_report",
            F.col("status").isin("new", "worsening") | F.lit(not rules.dedup) | ~F.col("_reported"),
        )
        .drop("_new", "_prior", "_island", "_reported")
    )


def _with_next_cycle(detections: DataFrame) -> DataFrame:
    own = Window.partitionBy("fingerprint").orderBy("cycle")
    return detections.withColumn("_next", F.lead("cycle").over(own))


def resolved_incidents(
    detections: DataFrame, rules: Rules = Rules(), all_clear: DataFrame | None = None
) -> DataFrame:
    """(cycle, fingerprint) of incidents that a cycle finds resolved.

    Checked at each cycle with a detection, and at the ``all_clear`` cycles. A
    resolved incident is listed for gap + 1 cycles, or until it is back; one
    that is detected in the cycle itself is not resolved.
    """
    seen = detections.select(
        "cycle", fingerprint(F.col("anomaly_type"), F.col("affected_component")).alias("fingerprint")
    )
    cycles = seen.select("cycle")
    if all_clear is not None:
        cycles = cycles.union(all_clear.select("cycle"))
    last = F.col("cycle") + 1 + rules.ongoing_gap
    until = F.least(last, F.coalesce(F.col("_next") - 1, last))
    listed = (
        _with_next_cycle(seen)
        .withColumn("_until", until)
        .filter(F.col("_until") > F.col("cycle"))
        .select(F.explode(F.sequence(F.col("cycle") + 1, F.col("_until"))).alias("cycle"), "fingerprint")
    )
    return listed.join(cycles.distinct(), "cycle", "left_semi")


def carried_over(detections: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Incidents still active before each cycle, as they stood at their last sighting.

    One row per (cycle, fingerprint) for every cycle an incident reaches into.
    """
    tracked = _with_next_cycle(track_incidents(detections, rules))
    last = F.col("cycle") + rules.ongoing_gap
    until = F.least(last, F.coalesce(F.col("_next"), last))
    return (
        tracked.withColumn("_until", until)
        .filter(F.col("_until") > F.col("cycle"))
        .select(
            F.explode(F.sequence(F.col("cycle") + 1, F.col("_until"))).alias("before_cycle"),
            "fingerprint",
            "anomaly_type",
            F.coalesce(F.nullif("affected_component", F.lit("")), F.lit("unknown")).alias("component"),
            "occurrences",
            F.col("value").alias("last_value"),
        )
    )


def carryover_before(detections: DataFrame, cycle: int, rules: Rules = Rules()) -> DataFrame:
    """Incidents carried into one cycle, sorted by fingerprint."""
    return (
        carried_over(detections.filter(F.col("cycle") < cycle), rules)
        .filter(F.col("before_cycle") == cycle)
        .orderBy("fingerprint")
    )
