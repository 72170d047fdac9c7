"""Alert detection with keyed state.

The arithmetic is that of the batch scan. Rows of a series are taken in order
within a micro-batch and in arrival order across batches; nothing is dropped
for being late, so the detector runs without a watermark and without timers.
Rows come in packs (``streaming.packs``), and those of one series in one
micro-batch are held in memory: bound the micro-batch at the source (``maxBytesPerTrigger``, ``maxOffsetsPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.baseline import AlertKernel
from tidewatch.operators.detect import keyed_rows, scan_order
from tidewatch.rules import Rules
from tidewatch.schema import ALERT, record
from tidewatch.session import STREAM_STATE_PROVIDER
from tidewatch.streaming.packs import pack, read_rows

STATE = record("seeded double, mean double, variance double, count double, errors double")
STATE_NAME = "baseline_v1"


class AlertProcessor(StatefulProcessor):
    """Baseline and error counts of one series; emits all three kinds of alert."""

    def __init__(self, rules: Rules, order: list[str], ttl_ms: int | None) -> None:
        self.kernel = AlertKernel(rules)
        self.order = order
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        if self.ttl_ms is None:
            self.state = handle.getValueState(STATE_NAME, STATE)
        else:
            self.state = handle.getValueState(STATE_NAME, STATE, self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        yield self._scan(read_rows([bytes(p) for packs in rows for p in packs["rows"]]))

    def _scan(self, rows: pa.Table) -> pd.DataFrame:
        """The alerts of rows of the series, which move its state on."""
        batch = rows.to_pandas().sort_values(self.order, kind="stable", ignore_index=True)
        before = list(self.state.get()) if self.state.exists() else None
        columns = {c: batch[c].to_numpy() for c in self.kernel.columns}
        columns["severity"] = batch["severity"].to_numpy(dtype=float, na_value=np.nan)
        at, deviates, threshold, actual, after = self.kernel.alerts(before, columns)
        self.state.update(tuple(after))
        found = batch.iloc[at]
        name = found["metric_name"] + "_baseline_deviation"
        alerts = pd.DataFrame(
            {
                "event_id": found["event_id"],
                "rule": np.where(deviates, name, "error_rate_high"),
                "component": found["component"],
                "threshold": threshold,
                "actual": actual,
                "timestamp_ms": found["timestamp_ms"],
                "severity": np.where(deviates, "WARNING", "CRITICAL"),
            }
        )
        return pd.concat([self._over_limit(batch), alerts], ignore_index=True)

    def _over_limit(self, batch: pd.DataFrame) -> pd.DataFrame:
        limit = batch["metric_name"].map(self.kernel.rules.limits).to_numpy(dtype=float)
        over = batch[batch["is_metric"].to_numpy(dtype=bool) & (batch["value"].to_numpy(dtype=float) > limit)]
        return pd.DataFrame(
            {
                "event_id": over["event_id"],
                "rule": over["metric_name"] + "_threshold",
                "component": over["component"],
                "threshold": limit[over.index],
                "actual": over["value"],
                "timestamp_ms": over["timestamp_ms"],
                "severity": "CRITICAL",
            }
        )

    def close(self) -> None:
        pass


def use_spilling_state(df: DataFrame) -> None:
    """Keyed state processors need the RocksDB store, which keeps state off the heap."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STREAM_STATE_PROVIDER)


def alert_schema(events: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("event_id", events.schema["event_id"].dataType), *ALERT.fields])


def detect_alerts_stream(
    events: DataFrame, rules: Rules = Rules(), by_offset: bool = False, ttl_ms: int | None = None
) -> DataFrame:
    """Alerts of a stream of EVENT records: one shuffle of packs by series, one stateful operator.

    A series without rows for ``ttl_ms`` starts anew; by default state is kept for good.
    With a time to live the stream follows the clock and has no end, so a trigger that
    waits for the end (``availableNow``) would not return.
    """
    use_spilling_state(events)
    rows = keyed_rows(events)
    return pack(rows).groupBy("series_key").transformWithStateInPandas(
        statefulProcessor=AlertProcessor(rules, scan_order(rows, by_offset), ttl_ms),
        outputStructType=alert_schema(events),
        outputMode="append",
        timeMode="none" if ttl_ms is None else "processingTime",
    )
