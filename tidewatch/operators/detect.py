"""Alerts from metric and log events: thresholds, baselines, error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import json_escape, two_decimals
from tidewatch.operators.baseline import AlertKernel, StateKernel
from tidewatch.operators.ordered import ordered_scan
from tidewatch.rules import Rules

EVENT_TYPES = ("metric", "log", "alert", "heartbeat")


def has_metric() -> Column:
    return F.col("metric").isNotNull()


def has_log() -> Column:
    """A log payload on an event that carries no metric."""
    return F.col("metric").isNull() & F.col("log").isNotNull()


def series_key() -> Column:
    """'source|metric name', 'source|log' or 'source|other'."""
    source = F.coalesce(F.col("source"), F.lit(""))
    name = F.coalesce(F.col("metric.metric_name"), F.lit(""))
    tail = F.when(has_metric(), name).when(has_log(), F.lit("log")).otherwise(F.lit("other"))
    return F.concat(source, F.lit("|"), tail)


def typed_series_key() -> Column:
    """Key that keeps apart what the plain key can merge (a metric named 'log', a '|' in a source)."""
    kind = F.when(has_metric(), "m").when(has_log(), "l").otherwise("o")
    name = F.coalesce(F.col("metric.metric_name"), F.lit(""))
    source = F.coalesce(F.col("source"), F.lit(""))
    return F.concat(kind, F.length(source).cast("string"), F.lit("|"), source, F.lit("|"), name)


def limit_for(metric_name: Column, rules: Rules) -> Column:
    """Absolute limit of a metric, null when it has none."""
    out = F.lit(None).cast("double")
    for name, limit in rules.limits.items():
        out = F.when(metric_name == name, F.lit(float(limit))).otherwise(out)
    return out


def _event_columns(events: DataFrame) -> list[str]:
    """Position columns of a partitioned log, where the events carry them."""
    return [c for c in ("partition", "offset") if c in events.columns]


def threshold_alerts(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One CRITICAL alert per metric sample above its limit; stateless, no shuffle."""
    name = F.col("metric.metric_name")
    value = F.coalesce(F.col("metric.value"), F.lit(0.0))
    lowest = min(rules.limits.values(), default=float("inf"))
    samples = events.filter(has_metric() & name.isin(*rules.limits))
    if lowest >= 0:
        # Implied by the filter on the limits, but simple enough to reach the scan. A missing value
        # counts as 0, so it may pass a limit below 0 only.
        samples = samples.filter(F.col("metric.value") > lowest)
    return (
        samples.withColumn("_limit", limit_for(name, rules))
        # NaN sorts above every number in Spark, but is above no limit.
        .filter((value > F.col("_limit")) & ~F.isnan(value))
        .select(
            "event_id",
            F.concat(name, F.lit("_threshold")).alias("rule"),
            F.coalesce(F.col("metric.component"), F.lit("")).alias("component"),
            F.col("_limit").alias("threshold"),
            value.alias("actual"),
            "timestamp_ms",
            F.lit("CRITICAL").alias("severity"),
        )
    )


def keyed_rows(events: DataFrame, key: Column | None = None, keep: list[str] = ()) -> DataFrame:
    """The flat rows the baselines read: metric and log events, other payloads dropped."""
    return events.filter(has_metric() | has_log()).select(
        *keep,
        (series_key() if key is None else key).alias("series_key"),
        "timestamp_ms",
        "event_id",
        *_event_columns(events),
        has_metric().alias("is_metric"),
        F.coalesce(F.col("metric.metric_name"), F.lit("")).alias("metric_name"),
        F.when(has_metric(), F.coalesce(F.col("metric.value"), F.lit(0.0))).alias("value"),
        F.when(has_log(), F.coalesce(F.col("log.severity"), F.lit(0))).alias("severity"),
        F.when(has_metric(), F.coalesce(F.col("metric.component"), F.lit("")))
        .otherwise(F.coalesce(F.col("source"), F.lit("")))
        .alias("component"),
    )


def scan_order(rows: DataFrame, by_offset: bool = False) -> list[str]:
    """Order within a series: event time, or arrival where the log position is known."""
    if by_offset:
        return ["partition", "offset"]
    return ["timestamp_ms", "event_id"]


def baseline_alerts(
    events: DataFrame, rules: Rules = Rules(), key: Column | None = None, by_offset: bool = False
) -> DataFrame:
    """Deviation and error-rate alerts, which depend on the rows before them."""
    rows = keyed_rows(events, key)
    found = ordered_scan(
        rows,
        "series_key",
        scan_order(rows, by_offset),
        AlertKernel(rules),
        ["event_id", "timestamp_ms", "metric_name", "component"],
    )
    return name_baseline_alerts(found)


def name_baseline_alerts(found: DataFrame) -> DataFrame:
    deviation = F.col("deviation")
    return found.select(
        "event_id",
        F.when(deviation, F.concat("metric_name", F.lit("_baseline_deviation")))
        .otherwise(F.lit("error_rate_high"))
        .alias("rule"),
        "component",
        "threshold",
        "actual",
        "timestamp_ms",
        F.when(deviation, "WARNING").otherwise("CRITICAL").alias("severity"),
    )


def deviation_alerts(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """WARNING alerts for samples far from the moving baseline of their own series."""
    return baseline_alerts(events.filter(has_metric()), rules)


def log_error_rate_alerts(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """CRITICAL alert on every log event while the source's error share is too high."""
    return baseline_alerts(events.filter(has_log()), rules)


def detect_alerts(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """All alerts. A sample may raise both a threshold and a deviation alert."""
    return threshold_alerts(events, rules).unionByName(baseline_alerts(events, rules))


def ewma_baseline(events: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Sample count, EWMA mean and variance of each series after each sample."""
    rows = keyed_rows(events.filter(has_metric()))
    return ordered_scan(
        rows, "series_key", scan_order(rows), StateKernel(rules), ["event_id", "series_key", "value"]
    )


def alert_json(alerts: DataFrame) -> DataFrame:
    """Six-field JSON text per alert, for a text or Kafka sink.

    A NaN or infinite number has no JSON form; it is written as null.
    """

    def number(column: str) -> Column:
        finite = F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(F.col(column)) != float("inf"))
        return F.coalesce(F.when(finite, two_decimals(F.col(column))), F.lit("null"))

    value = F.concat(
        F.lit('{"rule":"'),
        json_escape(F.col("rule")),
        F.lit('","component":"'),
        json_escape(F.col("component")),
        F.lit('","threshold":'),
        number("threshold"),
        F.lit(',"actual":'),
        number("actual"),
        F.lit(',"timestamp_ms":'),
        F.col("timestamp_ms").cast("string"),
        F.lit(',"severity":"'),
        F.col("severity"),
        F.lit('"}'),
    )
    return alerts.select(F.col("component").alias("key"), value.alias("value"))


def alerts_per_component_hour(alerts: DataFrame) -> DataFrame:
    hour = F.floor(F.col("timestamp_ms") / 3_600_000).cast("long")
    return alerts.groupBy(
        hour.alias("hour"), "component", "rule", "severity"
    ).agg(F.count("*").alias("alerts"), F.max("actual").alias("max_actual"))
