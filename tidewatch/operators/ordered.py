"""Order-dependent scans over keyed rows, split by rows rather than by key.

A running fold per key (a baseline, a running count, the previous value of a
counter) would put all rows of one key into one task if it were written as a
window. Here the rows are range-partitioned by (key, order), so a key with a
third of all rows is spread over a third of the tasks, and the fold is done in
three steps:

1. each segment (= range partition) is summarised for its first and its last
   key, the only keys that can reach over a segment boundary;
2. the at most two summaries per segment are folded per key into the state in
   which each segment starts;
3. each segment is scanned from its starting state, batch by batch.

The segments are checkpointed once, so steps 1 and 3 see the same rows even
after an executor is lost, and the data is shuffled once.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = "_segment"
CARRY = "_carry"
_HEAD = "_head"
_ROWS_IN_PARTITION = (1 << 33) - 1


class Kernel(Protocol):
    """What a scan has to supply. Summaries and states are flat lists of floats."""

    columns: list[str]
    """Columns the kernel reads."""

    output: T.StructType
    """Columns the scan adds to, or takes from, the rows it emits."""

    def summarize(self, rows: dict[str, np.ndarray]) -> list[float]:
        """Summary of the rows of one key, whatever the state before them."""

    def combine(self, left: list[float], right: list[float]) -> list[float]:
        """Summary of two adjacent runs of rows of one key."""

    def advance(self, state: list[float] | None, summary: list[float]) -> list[float]:
        """State after a summarised run; None is the state of a new key."""

    def scan(
        self, state: list[float] | None, batch: pa.RecordBatch, rows: dict[str, np.ndarray]
    ) -> tuple[pa.RecordBatch | None, list[float]]:
        """Rows to emit for one run, and the state after it."""


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one gets its own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def ordered_segments(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Range-partition by (key, order), sort, number the segments and checkpoint.

    ``order`` should end in a unique column: rows that tie on (key, order)
    cannot be split over segments.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    position = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROWS_IN_PARTITION))
    return (
        df.repartitionByRange(n, key, *order)
        .sortWithinPartitions(key, *order)
        .withColumn(SEGMENT, F.spark_partition_id())
        .withColumn(_HEAD, position == 0)
        .checkpoint()
    )


def _runs(batch: pa.RecordBatch, key: str) -> Iterator[tuple[Any, pa.RecordBatch]]:
    """The runs of equal keys in a batch that is sorted by key."""
    keys = batch.column(key)
    if len(keys) == 0:
        return
    changed = pc.fill_null(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)), True)
    cuts = np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1
    start = 0
    for stop in [*cuts.tolist(), len(keys)]:
        yield keys[start].as_py(), batch.slice(start, stop - start)
        start = stop


def _arrays(batch: pa.RecordBatch, columns: list[str]) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}


def _summaries(segments: DataFrame, key: str, kernel: Kernel) -> DataFrame:
    columns = kernel.columns
    schema = pa.schema(
        [("segment", pa.int32()), ("key", pa.string()), ("summary", pa.list_(pa.float64()))]
    )

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # First key of the segment, then the key in hand: memory does not grow with the segment.
        segment = None
        first: tuple[str, list[float]] | None = None
        held: tuple[str, list[float]] | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            segment = batch.column(SEGMENT)[0].as_py()
            for name, run in _edge_runs(batch, key):
                summary = kernel.summarize(_arrays(run, columns))
                if held is not None and held[0] == name:
                    held = (name, kernel.combine(held[1], summary))
                    continue
                if first is None:
                    first = held
                held = (name, summary)
        rows = [e for e in (first, held) if e is not None]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([segment] * len(rows), pa.int32()),
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.list_(pa.float64())),
                ],
                schema=schema,
            )

    # A key reaches over a boundary only if a segment starts with it, so the rows of all other
    # keys need not leave the JVM. There is at most one such key per segment.
    leading = segments.filter(F.col(_HEAD)).select(key).distinct()
    return (
        segments.select(SEGMENT, key, *columns)
        .join(F.broadcast(leading), key, "left_semi")
        .select(SEGMENT, key, *columns)
        .mapInArrow(edges, "segment int, key string, summary array<double>")
    )


def _edge_runs(batch: pa.RecordBatch, key: str) -> Iterator[tuple[Any, pa.RecordBatch]]:
    """First and last run of a batch; the keys between them lie wholly inside it."""
    first = last = None
    for run in _runs(batch, key):
        if first is None:
            first = run
            yield first
        else:
            last = run
    if last is not None:
        yield last


def _pack(state: list[float]) -> str:
    """State as text, exact to the bit: Arrow moves a column of null texts much faster than null lists."""
    return ",".join(repr(float(v)) for v in state)


def _starting_states(segments: DataFrame, key: str, kernel: Kernel) -> DataFrame:
    """(segment, carry) for segments whose first key began in an earlier segment.

    The input has at most two rows per segment, so neither a group here nor the
    result can grow beyond the number of shuffle partitions.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment", kind="stable")
        state: list[float] | None = None
        out: list[tuple[int, str]] = []
        for segment, summary in zip(pdf["segment"], pdf["summary"]):
            if state is not None:
                out.append((segment, _pack(state)))
            state = kernel.advance(state, [float("nan") if v is None else v for v in summary])
        return pd.DataFrame(out, columns=["segment", "carry"])

    return (
        _summaries(segments, key, kernel)
        .groupBy("key")
        .applyInPandas(fold, "segment int, carry string")
    )


def ordered_scan(
    df: DataFrame, key: str, order: list[str], kernel: Kernel, keep: list[str]
) -> DataFrame:
    """Run ``kernel`` over the rows of each key in order.

    Emits the ``keep`` columns of the rows the kernel selects, followed by the
    columns of ``kernel.output``.
    """
    wanted = list(dict.fromkeys([key, *order, *kernel.columns, *keep]))
    segments = ordered_segments(df.select(*wanted), key, order)
    carry = _starting_states(segments, key, kernel).select(
        F.col("segment").alias("_from"), F.col("carry").alias(CARRY)
    )
    rows = segments.join(
        F.broadcast(carry), F.col(_HEAD) & (F.col(SEGMENT) == F.col("_from")), "left"
    ).select(*wanted, CARRY)
    out = T.StructType([rows.schema[c] for c in keep] + list(kernel.output.fields))
    columns = kernel.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: Any = None
        state: list[float] | None = None
        opened = False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if not opened:
                opened = True
                current = batch.column(key)[0].as_py()
                carried = batch.column(CARRY)[0].as_py()
                if carried is not None:
                    state = [float(v) for v in carried.split(",")]
            slim = batch.select(wanted)
            for name, part in _runs(slim, key):
                if name != current:
                    current, state = name, None
                emitted, state = kernel.scan(state, part, _arrays(part, columns))
                if emitted is not None and emitted.num_rows:
                    yield emitted.select(out.names)

    return rows.mapInArrow(run, out)
