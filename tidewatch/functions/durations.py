"""Durations such as '5m': plan a range query before it is built."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per suffix, and the range for an unknown suffix.
UNIT_SECONDS = {"s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}
DEFAULT_RANGE_SECONDS = 900.0


def duration_seconds(text: str) -> float:
    """Seconds of a duration argument; raises on a number that does not parse."""
    unit = UNIT_SECONDS.get(text[-1:])
    return DEFAULT_RANGE_SECONDS if unit is None else float(text[:-1]) * unit


def step_seconds(text: str) -> int | None:
    """Step of a range query; None for minutes that are not whole."""
    unit = text[-1:]
    if unit == "m":
        try:
            minutes = int(text[:-1])
        except ValueError:
            return None
        return 5 if minutes <= 5 else 15 if minutes <= 30 else 60
    return {"h": 60, "d": 300}.get(unit, 15)


def duration_seconds_column(c: Column) -> Column:
    """The same over a column; a number that does not parse gives null."""
    number = F.left(c, F.length(c) - 1).try_cast("double")
    out = F.lit(None).cast("double")
    for unit, seconds in UNIT_SECONDS.items():
        out = F.when(F.endswith(c, F.lit(unit)), number * seconds).otherwise(out)
    known = F.right(c, F.lit(1)).isin(*UNIT_SECONDS)
    return F.when(known, out).when(c.isNotNull(), F.lit(DEFAULT_RANGE_SECONDS))


def step_seconds_column(c: Column) -> Column:
    unit = F.right(c, F.lit(1))
    minutes = F.left(c, F.length(c) - 1).try_cast("int")
    exact = F.left(c, F.length(c) - 1).rlike(r"^\s*[-+]?\d+\s*$")
    return (
        F.when(unit == "m", F.when(exact, F.when(minutes <= 5, 5).when(minutes <= 30, 15).otherwise(60)))
        .when(unit == "h", 60)
        .when(unit == "d", 300)
        .when(c.isNotNull(), 15)
    )
