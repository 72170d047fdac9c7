"""Alert detection in event time: rows wait in state until the watermark has passed them.

The detector of ``streaming.detector`` takes rows of different micro-batches in
the order of their arrival. Here each series keeps its rows, in packs of one
cell of time each, until a timer fires behind the watermark, and takes them in
the order of the batch scan then: cell by cell, so that a row is written and
read once, but for those of the cell that the watermark stands in. A row may
come as late as the watermark allows. Of what is later, packs are dropped by
Spark, which counts them (``numRowsDroppedByWatermark``); a late row in a pack
with others is still taken unless its series was scanned beyond it, and dropped
and counted in ``dropped`` if it was. Where nothing may be dropped, use the
detector in arrival order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from tidewatch.operators.detect import keyed_rows, scan_order
from tidewatch.rules import Rules
from tidewatch.schema import record
from tidewatch.streaming.detector import AlertProcessor, alert_schema, use_spilling_state
from tidewatch.streaming.packs import pack, read_rows, write_rows

#: Packs that wait, by the time of their first row and a number of their own.
BUFFER_NAME = "waiting_v2"
PLACE, WAITING = record("from_ms long, number long"), record("rows binary")
#: The next pack's number, and the watermark up to which the series was scanned.
PROGRESS_NAME, PROGRESS = "progress_v1", record("number long, done_ms long")
#: A delay is cut into this many cells of time, of a minute at least.
CELLS, LEAST_CELL_MS = 32, 60_000
_NEVER = -(2**63)
_TIME = "event_time"


class ReorderingAlertProcessor(AlertProcessor):
    """An AlertProcessor that is fed behind the watermark only.

    Memory: the rows of one series in one cell of time.
    """

    def __init__(self, rules: Rules, order: list[str], cell_ms: int, dropped: Accumulator | None = None) -> None:
        super().__init__(rules, order, None)
        self.cell_ms, self.dropped = cell_ms, dropped

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.buffer = handle.getMapState(BUFFER_NAME, PLACE, WAITING)
        self.progress = handle.getValueState(PROGRESS_NAME, PROGRESS)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        number, done = self._progress()
        first = []
        for packs in rows:
            for from_ms, body in zip(packs["from_ms"].tolist(), packs["rows"], strict=True):
                self.buffer.updateValue((from_ms, number), (bytes(body),))
                number += 1
                first.append(from_ms)
        self.progress.update((number, done))
        self._wake_at(min(first))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        number, done = self._progress()
        places = sorted((int(p[0]), int(p[1])) for p in self.buffer.keys())
        left = [p[0] for p in places if p[0] > watermark]
        for _, cell in groupby((p for p in places if p[0] <= watermark), key=lambda p: p[0] // self.cell_ms):
            cell = list(cell)
            waiting = read_rows([bytes(self.buffer.getValue(p)[0]) for p in cell])
            for place in cell:
                self.buffer.removeKey(place)
            time = waiting["timestamp_ms"].to_numpy()
            if len(later := time[time > watermark]):
                left.append(int(later.min()))
                self.buffer.updateValue((left[-1], number), (write_rows(waiting.filter(pa.array(time > watermark))),))
                number += 1
            if self.dropped is not None and (late := int((time <= done).sum())):
                self.dropped.add(late)
            if len(ready := waiting.filter(pa.array((time <= watermark) & (time > done)))):
                yield self._scan(ready)
        self.progress.update((number, max(done, watermark)))
        if left:
            # The timer that fired is still listed, but gone once this returns.
            self.handle.registerTimer(min(left))

    def _progress(self) -> tuple[int, int]:
        return tuple(map(int, self.progress.get())) if self.progress.exists() else (0, _NEVER)

    def _wake_at(self, time_ms: int) -> None:
        """One timer per series: at the earliest row that waits."""
        for timer in list(self.handle.listTimers()):
            if timer <= time_ms:
                return
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(time_ms)


def detect_alerts_in_order(events: DataFrame, delay: str, rules: Rules = Rules(), dropped: Accumulator | None = None) -> DataFrame:
    """Alerts of a stream of EVENT records, as the batch gives them if no row is later than ``delay``.

    Rows are held back by as much, so the last ones of a stream that ends come
    out only when a later event of any series has moved the watermark past them.
    ``dropped`` counts late rows that came in one pack with rows in time.
    """
    use_spilling_state(events)
    rows = keyed_rows(events)
    delay_ms = events.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + CAST('{delay}' AS INTERVAL))").first()[0]
    cell_ms = max(LEAST_CELL_MS, delay_ms // CELLS)
    packs = pack(rows, cell_ms).withColumn(_TIME, F.timestamp_millis("to_ms")).withWatermark(_TIME, delay)
    return packs.groupBy("series_key").transformWithStateInPandas(
        statefulProcessor=ReorderingAlertProcessor(rules, scan_order(rows), cell_ms, dropped),
        outputStructType=alert_schema(events),
        outputMode="append",
        timeMode="eventTime",
    )
