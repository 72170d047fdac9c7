"""Metric samples: latest values, bands, range queries, counter rates, differences.

Samples are (name, labels, ts_ms, value) with a map of labels. Everything is an
aggregate with map-side combining, or the segmented scan for counters, so one
busy series does not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.baseline import CounterKernel
from tidewatch.operators.ordered import ordered_scan

# Colour steps of the panels, lowest first; the first has no lower bound.
BANDS: dict[str, list[tuple[float | None, str]]] = {
    "job_uptime_ms": [(None, "red"), (60000, "green")],
    "restarts": [(None, "green"), (1, "yellow"), (5, "red")],
    "completed_checkpoints": [(None, "green")],
    "failed_checkpoints": [(None, "green"), (1, "red")],
    "task_slots": [(None, "blue")],
    "task_managers": [(None, "green"), (0, "red")],
    "backpressure_ms_per_second": [(None, "green"), (100, "yellow"), (500, "red")],
    "checkpoint_duration_ms": [(None, "green"), (5000, "yellow"), (30000, "red")],
}
STALE_SECONDS = 300


def label_key(labels: Column) -> Column:
    """Labels as canonical text: maps have no equality in Spark."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def with_series(samples: DataFrame) -> DataFrame:
    return samples.withColumn("series", label_key(F.col("labels")))


def metric_latest(samples: DataFrame) -> DataFrame:
    """Last non-null value and maximum of each series."""
    known = F.col("value").isNotNull()
    return (
        with_series(samples)
        .groupBy("name", "series")
        .agg(
            F.max_by("value", F.when(known, F.struct("ts_ms", "value"))).alias("last_value"),
            F.max(F.when(known, F.col("ts_ms"))).alias("last_ts_ms"),
            F.max("value").alias("max_value"),
        )
    )


def band(value: Column, steps: list[tuple[float | None, str]]) -> Column:
    """Colour of the last step that is not above the value."""
    base = [colour for bound, colour in steps if bound is None]
    out = F.lit(base[0]) if base else F.lit(None).cast("string")
    for bound, colour in steps:
        if bound is not None:
            out = F.when(value >= bound, F.lit(colour)).otherwise(out)
    return F.when(value.isNotNull(), out)


def metric_bands(latest: DataFrame, panel: str) -> DataFrame:
    return latest.withColumn("status", band(F.col("last_value"), BANDS[panel]))


def _first_point(ts: Column, start_ms: int, step_ms: int) -> Column:
    """Number of the first grid point at or after a time."""
    return F.greatest(F.lit(0), F.ceil((ts - start_ms) / step_ms)).cast("long")


def metric_range(
    samples: DataFrame,
    start_ms: int,
    end_ms: int,
    step_seconds: int,
    stale_seconds: int = STALE_SECONDS,
) -> DataFrame:
    """Value of each series at each step of [start, end]: its last sample, if not stale.

    Samples are first reduced to the last one before each point; only those are
    carried on to the later points they still serve.
    """
    step = step_seconds * 1000
    stale = stale_seconds * 1000
    last_point = (end_ms - start_ms) // step
    kept = (
        with_series(samples)
        .filter(F.col("value").isNotNull())
        .filter((F.col("ts_ms") <= end_ms) & (F.col("ts_ms") >= start_ms - stale))
        .withColumn("point", _first_point(F.col("ts_ms"), start_ms, step))
        .groupBy("name", "series", "point")
        .agg(F.max(F.struct("ts_ms", "value")).alias("last"))
    )
    until = F.least(F.lit(last_point), F.floor((F.col("last.ts_ms") + stale - start_ms) / step)).cast("long")
    return (
        kept.withColumn("until", until)
        .filter(F.col("until") >= F.col("point"))
        .select("name", "series", "last", F.explode(F.sequence("point", "until")).alias("point"))
        .groupBy("name", "series", "point")
        .agg(F.max("last").alias("last"))
        .select(
            "name",
            "series",
            (F.lit(start_ms) + F.col("point") * step).alias("ts_ms"),
            F.col("last.value").alias("value"),
        )
    )


def counter_increase(
    samples: DataFrame, order: list[str] | None = None, after_ms: int | None = None, until_ms: int | None = None
) -> DataFrame:
    """Increase of each counter sample over the previous one of its series.

    A value below the previous one means the counter restarted from zero.
    ``order`` must end in a unique column for a series to be split over tasks.
    With ``after_ms`` and ``until_ms`` only samples in between are ordered: the
    time reaches the scan, and of what came before only the last sample of each
    series is kept, by an aggregate.
    """
    columns = order or ["ts_ms"]
    key = F.concat_ws("\u001f", F.col("name"), label_key(F.col("labels")))
    known = samples.filter(F.col("value").isNotNull())
    if until_ms is not None:
        known = known.filter(F.col("ts_ms") <= until_ms)

    def rows(df: DataFrame) -> DataFrame:
        return df.select(key.alias("_series"), "name", label_key(F.col("labels")).alias("series"), "value", *columns)

    if after_ms is None:
        needed = rows(known)
    else:
        before = rows(known.filter(F.col("ts_ms") <= after_ms))
        place = F.struct(*columns)
        last = before.groupBy("_series", "name", "series").agg(F.max(F.struct(place.alias("at"), "value")).alias("b"))
        last = last.select("_series", "name", "series", "b.value", "b.at.*")
        needed = rows(known.filter(F.col("ts_ms") > after_ms)).unionByName(last)
    out = ordered_scan(needed, "_series", columns, CounterKernel(), ["name", "series", *columns, "value"])
    return out if after_ms is None else out.filter(F.col("ts_ms") > after_ms)


def metric_rate(
    increases: DataFrame, start_ms: int, end_ms: int, step_seconds: int, window_seconds: int = 60
) -> DataFrame:
    """Increase per second over the window before each step of [start, end].

    A point without a sample in its window has no row. Each increase counts
    towards the at most ``window / step + 1`` points whose window holds it.
    Samples that serve the same points are added up first, so what is spread
    over the points depends on the grid, not on the number of samples.
    """
    step, window = step_seconds * 1000, window_seconds * 1000
    first = _first_point(F.col("ts_ms"), start_ms, step)
    # Points p with p - window < ts <= p.
    last = F.least(
        F.lit((end_ms - start_ms) // step),
        F.ceil((F.col("ts_ms") + window - start_ms) / step) - 1,
    ).cast("long")
    return (
        increases.filter((F.col("ts_ms") <= end_ms) & (F.col("ts_ms") > start_ms - window))
        .groupBy("name", "series", first.alias("_first"), last.alias("_last"))
        .agg(F.sum("increase").alias("increase"))
        .filter(F.col("_first") <= F.col("_last"))
        .select("name", "series", "increase", F.explode(F.sequence("_first", "_last")).alias("point"))
        .groupBy("name", "series", "point")
        .agg((F.sum("increase") / window_seconds).alias("rate"))
        .select("name", "series", (F.lit(start_ms) + F.col("point") * step).alias("ts_ms"), "rate")
    )


def series_minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Difference of two metrics where labels and time agree.

    Both sides come from ``metric_range`` with the same grid, and hold one row
    per series and point.
    """
    a = left.select("series", "ts_ms", F.col("value").alias("_a"))
    b = right.select("series", "ts_ms", F.col("value").alias("_b"))
    return a.join(b, ["series", "ts_ms"]).select(
        "series", "ts_ms", (F.col("_a") - F.col("_b")).alias("value")
    )
