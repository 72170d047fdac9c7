"""Recent events and log search over a partitioned log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.keys import severity_name
from tidewatch.operators.detect import EVENT_TYPES
from tidewatch.rules import Rules

#: The order in which a search reads a log.
SCAN_ORDER = ["timestamp_ms", "partition", "offset"]


def watermarks(events: DataFrame) -> DataFrame:
    """(partition, low, high) of a log: first offset, and the one after the last.

    One row per partition of the topic, whatever the number of events.
    """
    return events.groupBy("partition").agg(
        F.min("offset").alias("low"), (F.max("offset") + 1).alias("high")
    )


def last_per_partition(
    events: DataFrame, total: int, extra: int = 0, offsets: DataFrame | None = None
) -> DataFrame:
    """The last ``total div partitions + extra`` offsets of every partition.

    ``offsets`` supplies (partition, high) when the broker's watermarks are at
    hand; otherwise they come from one narrow scan of the events. The lowest
    start goes to the main scan as a scalar filter, which parquet uses to skip
    row groups. Every partition has its last rows behind that start, so the
    exact starts come from what is left, one row per partition of the topic.
    """
    bounds = watermarks(events) if offsets is None else offsets.select("partition", "high")

    def start(high: Column, share: Column) -> Column:
        return F.greatest(F.lit(0), high - share).cast("long")

    share = (F.floor(F.lit(total) / F.count("*")) + extra).alias("_share")
    lowest = bounds.agg(F.min("high").alias("high"), share).select(start(F.col("high"), F.col("_share"))).scalar()
    near = events.filter(F.col("offset") >= lowest)
    if offsets is None:
        bounds = near.groupBy("partition").agg((F.max("offset") + 1).alias("high"))
    starts = bounds.select(
        F.col("partition").alias("_partition"), start(F.col("high"), bounds.agg(share).scalar()).alias("_start")
    )
    return near.join(
        F.broadcast(starts),
        (F.col("partition") == F.col("_partition")) & (F.col("offset") >= F.col("_start")),
    ).drop("_partition", "_start")


def is_type(event_type: str) -> Column:
    """The event carries this payload: metric, log, alert or heartbeat."""
    kind = event_type.lower()
    if kind not in EVENT_TYPES:
        raise ValueError(f"event type must be one of {', '.join(EVENT_TYPES)}")
    return F.col(kind).isNotNull()


def _at_most(count: int, limit: int | None) -> int:
    return max(0, count if limit is None else min(count, limit))


def recent_events(
    events: DataFrame,
    count: int | None = None,
    event_type: str | None = None,
    rules: Rules = Rules(),
    offsets: DataFrame | None = None,
) -> DataFrame:
    """Up to ``count`` latest events; ``rules.events_max_count`` may set a limit to that.

    The type filter applies to the tail already taken, so a rare type may give
    fewer rows than ``count``.
    """
    n = _at_most(rules.events_default_count if count is None else count, rules.events_max_count)
    tail = last_per_partition(events, n, 1, offsets)
    if event_type:
        tail = tail.filter(is_type(event_type))
    order = [F.col(c).desc() for c in ("timestamp_ms", "partition", "offset")]
    return tail.orderBy(*order).limit(n)


def log_matches(pattern: str, severity: str | None = None, component: str | None = None) -> Column:
    """Literal, case-insensitive: part of the message, whole severity name, whole component."""

    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    match = F.contains(F.lower(text(F.col("log.message"))), F.lower(F.lit(pattern)))
    if severity:
        match = match & (F.upper(text(severity_name(F.col("log.severity")))) == severity.upper())
    if component:
        match = match & (F.lower(text(F.col("log.component"))) == F.lower(F.lit(component)))
    return F.col("log").isNotNull() & match


def _searched(
    events: DataFrame,
    pattern: str,
    severity: str | None,
    component: str | None,
    rules: Rules,
    offsets: DataFrame | None,
) -> DataFrame:
    """What a search may read, with ``is_match``: the whole log, or its end if the rules set a depth."""
    depth = rules.log_scan_depth
    if depth is not None:
        events = last_per_partition(events, depth, 0, offsets).orderBy(*SCAN_ORDER).limit(depth)
    return events.withColumn("is_match", log_matches(pattern, severity, component))


def search_logs(
    events: DataFrame,
    pattern: str,
    count: int | None = 20,
    severity: str | None = None,
    component: str | None = None,
    rules: Rules = Rules(),
    offsets: DataFrame | None = None,
) -> DataFrame:
    """Matching log events in the order of the log, the first ``count`` of them; all of them if that is None.

    Each task keeps its first ``count`` matches and these are merged, so one
    scan is enough and nothing but matches is ordered.
    """
    found = (
        _searched(events, pattern, severity, component, rules, offsets)
        .filter("is_match")
        .select("partition", "offset", "timestamp_ms", "source", "log.*")
        .orderBy(*SCAN_ORDER)
    )
    return found if count is None else found.limit(_at_most(count, rules.events_max_count))


def search_summary(
    events: DataFrame,
    pattern: str,
    count: int | None = 20,
    severity: str | None = None,
    component: str | None = None,
    rules: Rules = Rules(),
    offsets: DataFrame | None = None,
) -> DataFrame:
    """One row: messages scanned and matches found by a search that stops at its last match.

    ``partial`` tells that there may be more: the search stopped at ``count``
    matches, or the rules set a depth. The last match is the greatest of the
    first ``count``; what is scanned is counted up to it, without any order.
    """
    scanned = _searched(events, pattern, severity, component, rules, offsets)
    position = F.struct(*SCAN_ORDER)
    if count is None:
        stops, read = F.lit(False), scanned
    else:
        n = _at_most(count, rules.events_max_count)
        first = scanned.filter("is_match").select(*SCAN_ORDER).orderBy(*SCAN_ORDER).limit(n)
        stop = first.agg(F.when(F.count("*") >= n, F.max(position))).scalar()
        read = scanned.filter(F.coalesce(position <= stop, F.lit(n > 0)))
        stops = F.col("match_count") >= n
    return read.agg(
        F.count("*").alias("messages_scanned"), F.count_if("is_match").alias("match_count")
    ).select(
        F.lit(pattern).alias("pattern"),
        "messages_scanned",
        "match_count",
        (stops | F.lit(rules.log_scan_depth is not None)).alias("partial"),
    )


def logs(events: DataFrame) -> DataFrame:
    """The log payloads, one row per log event."""
    return events.filter(F.col("log").isNotNull()).select("event_id", "timestamp_ms", "source", "log.*")
