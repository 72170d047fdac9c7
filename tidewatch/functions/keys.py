"""Column functions for keys, ranks, names and incident arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Log severity ordinals, confidence ranks.
SEVERITY_NAMES = {0: "SEVERITY_UNSPECIFIED", 1: "DEBUG", 2: "INFO", 3: "WARN", 4: "ERROR", 5: "FATAL"}
CONFIDENCE_RANK = {"HIGH": 3, "MEDIUM": 2, "LOW": 1, "UNSOURCED": 0}


def _lookup(table: dict, key: Column) -> Column:
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(literal, key)


def severity_name(ordinal: Column) -> Column:
    return _lookup(SEVERITY_NAMES, ordinal)


def severity_ordinal(name: Column) -> Column:
    return _lookup({v: k for k, v in SEVERITY_NAMES.items()}, name)


def confidence_rank(confidence: Column) -> Column:
    return _lookup(CONFIDENCE_RANK, confidence)


def is_low(confidence: Column) -> Column:
    return confidence.isin("LOW", "UNSOURCED")


def fingerprint(anomaly_type: Column, component: Column) -> Column:
    """Identity of an anomaly across cycles: its type on its component."""
    return F.concat(anomaly_type, F.lit(":"), known_component(component))


def known_component(component: Column) -> Column:
    return F.coalesce(F.nullif(component, F.lit("")), F.lit("unknown"))


def worsened(prior: Column, current: Column, worsen_pct: float) -> Column:
    """The value rose by at least ``worsen_pct`` of a positive prior value."""
    ratio = (current - prior) / F.when(prior > 0, prior)
    return F.coalesce(ratio >= worsen_pct, F.lit(False))


def short_id(*keys: Column) -> Column:
    """Eight hex digits that depend only on the keys, so a retried task repeats them."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *[k.cast("string") for k in keys]), 256), 1, 8)


def cycle_id(*keys: Column) -> Column:
    """'cyc-' and twelve hex digits: one id for all that a monitoring cycle puts out."""
    digest = F.sha2(F.concat_ws("\u001f", *[k.cast("string") for k in keys]), 256)
    return F.concat(F.lit("cyc-"), F.substring(digest, 1, 12))


def utc_iso(instant: Column) -> Column:
    """ISO-8601 text in UTC, to the millisecond, whatever the session's zone."""
    wall_clock = F.to_utc_timestamp(instant, F.current_timezone())
    return F.date_format(wall_clock, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def utc_now_iso() -> Column:
    """Time of the query as ISO-8601 text."""
    return utc_iso(F.current_timestamp())
