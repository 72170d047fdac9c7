"""Incident memory as keyed state: the batch tracker, one cycle at a time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions.keys import fingerprint
from tidewatch.functions.text import leading_number
from tidewatch.rules import Rules
from tidewatch.schema import record
from tidewatch.streaming.detector import use_spilling_state

STATE = record("last_cycle long, last_value double, occurrences long, reported boolean")
OUTPUT = record(
    "fingerprint string, cycle long, observed_value string, value double, status string, occurrences long, "
    "should_report boolean"
)


class IncidentProcessor(StatefulProcessor):
    """Last sighting of one fingerprint."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("incident_v1", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # One row per cycle, so the rows of a micro-batch are as few as its cycles.
        seen = pd.concat(list(rows), ignore_index=True).sort_values("cycle", kind="stable")
        memory = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for row in seen.itertuples(index=False):
            value = None if pd.isna(row.value) else float(row.value)
            status, occurrences, reported = self._classify(memory, int(row.cycle), value)
            should_report = status != "ongoing" or not self.rules.dedup or not reported
            out.append((key[0], int(row.cycle), row.observed_value, value, status, occurrences, should_report))
            memory = (int(row.cycle), value, occurrences, reported or bool(row.delivered))
        self.state.update(memory)
        yield pd.DataFrame(out, columns=OUTPUT.names)

    def _classify(self, memory: tuple | None, cycle: int, value: float | None) -> tuple[str, int, bool]:
        if memory is None or cycle - memory[0] > self.rules.ongoing_gap:
            return "new", 1, False
        prior = memory[1]
        worse = (
            prior is not None
            and not pd.isna(prior)
            and value is not None
            and prior > 0
            and (value - prior) / prior >= self.rules.worsen_pct
        )
        return "worsening" if worse else "ongoing", memory[2] + 1, memory[3]

    def close(self) -> None:
        pass


def track_incidents_stream(detections: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Status and reporting decision per detection, as ``track_incidents`` gives in a batch."""
    use_spilling_state(detections)
    keyed = detections.select(
        fingerprint(F.col("anomaly_type"), F.col("affected_component")).alias("fingerprint"),
        "cycle",
        "observed_value",
        leading_number(F.col("observed_value")).alias("value"),
        F.coalesce("delivered", F.lit(False)).alias("delivered"),
    )
    return keyed.groupBy("fingerprint").transformWithStateInPandas(
        statefulProcessor=IncidentProcessor(rules),
        outputStructType=OUTPUT,
        outputMode="append",
        timeMode="none",
    )
