"""Whitening of embeddings with a covariance weighted by multiplicity.

Vectors are put on a grid of whole numbers, so equal ones can be grouped exactly. Each distinct vector is weighted by how
often it occurs (or by one): tasks add up weighted, centred products of their distinct vectors, the cluster adds up the
tasks' sums row by row, and the driver gets one matrix whose size depends on the dimensions alone. Each distinct vector is
then whitened once, and joined back to the rows that hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Grid numbers beyond this are held there, so that they stay exact in a double.
BOUND = 2**53
#: Components whose variance is below this share of the largest have none.
RANK_TOLERANCE = 1e-12
_WIDTHS = (np.int16, np.int32, np.int64)


def usable(vector: Column) -> Column:
    """The vector is not null and holds finite numbers only."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))


def pack(rows: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes of the narrowest width that holds them; equal rows give equal bytes."""
    wide = np.abs(rows).max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(rows)
    level = np.searchsorted([2**15 - 1, 2**31 - 1], wide)
    for i, kind in enumerate(_WIDTHS):
        at = np.flatnonzero(level == i)
        for j, row in zip(at.tolist(), rows[at].astype(np.dtype(kind).newbyteorder("<")), strict=True):
            out[j] = bytes([i]) + row.tobytes()
    return out


def unpack(packed: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(packed), dims), np.int64)
    for i, kind in enumerate(_WIDTHS):
        at = [j for j, p in enumerate(packed) if p[0] == i]
        if at:
            out[at] = np.frombuffer(b"".join(packed[j][1:] for j in at), np.dtype(kind).newbyteorder("<")).reshape(-1, dims)
    return out


def _gridded(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[pa.RecordBatch]:
    """The distinct vectors of each batch, with the ids of their rows. Packed without the shift, which costs nothing."""
    for batch in batches:
        if batch.num_rows:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            with np.errstate(over="ignore"):
                grid = np.clip(np.floor(scale * flat), -BOUND, BOUND).astype(np.int64)
            places: dict[bytes, list[int]] = {}
            for i, key in enumerate(pack(grid)):
                places.setdefault(key, []).append(i)
            ids = batch.column("id").to_pylist()
            yield pa.record_batch(
                [pa.array(list(places), pa.binary()), pa.array([[ids[i] for i in p] for p in places.values()], pa.list_(pa.int64()))], ["x", "ids"]
            )


@dataclass
class Centre:
    """Exact number and sums of the fit list, without the shift."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.whole = [s // self.n for s in self.sums]
        self.rest = [s - self.n * m for s, m in zip(self.sums, self.whole, strict=True)]

    def apart(self, x: np.ndarray) -> np.ndarray:
        """x less the mean; the whole part is taken off exactly first."""
        return (x - np.array(self.whole, np.int64)).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - sums) squared, exact; null where a long can't hold it."""
        whole, rest = np.array(self.whole, np.int64), np.array(self.rest, np.int64)
        rough = (self.n * self.apart(x)) ** 2
        if rough.sum(axis=1).max(initial=0) < 2**62 and self.n * float(np.abs(x - whole).max(initial=0)) < 2**62:
            return (((x - whole) * self.n - rest) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * (int(c) - m) - r) ** 2 for c, m, r in zip(row, self.whole, self.rest, strict=True)) for row in x]
        return [e if e < 2**63 else None for e in exact]


def _products(batches: Iterator[pa.RecordBatch], size: int, of) -> Iterator[pa.RecordBatch]:
    """A task's sum of weight * row^T row, one row of the matrix per output row. of(batch): its rows."""
    total = np.zeros((size, size))
    for batch in batches:
        if batch.num_rows:
            rows, weight = of(batch), batch.column("w").to_numpy().astype(np.float64)
            total += rows.T @ (rows * weight[:, None])
    yield pa.record_batch([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])


def _added(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    rows: dict[int, np.ndarray] = {}
    for batch in batches:
        values = batch.column("row").flatten().to_numpy().reshape(-1, size)
        for i, value in zip(batch.column("i").to_pylist(), values, strict=True):
            rows[i] = rows[i] + value if i in rows else value.copy()
    yield pa.record_batch([pa.array(list(rows), pa.int32()), pa.array(list(rows.values()), pa.list_(pa.float64()))], ["i", "row"])


def _matrix(df: DataFrame, size: int, of) -> np.ndarray:
    """Sum over df of weight * row^T row. Tasks' matrices are added up over the cluster, dealt by row; the driver gets one."""
    kind = "i int, row array<double>"
    parts = df.mapInArrow(lambda it: _products(it, size, of), kind)
    summed = parts.repartition("i").mapInArrow(lambda it: _added(it, size), kind)
    out = np.zeros((size, size))
    for r in summed.collect():
        out[r.i] += r.row
    return out


def _sums(df: DataFrame, dims: int) -> list[int]:
    """Exact sums per dimension: per task first, then over the cluster."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for batch in batches:
            if batch.num_rows:
                x, w = unpack(batch.column("x").to_pylist(), dims), batch.column("w").to_numpy()
                small = float(np.abs(x).max(initial=0)) * float(w.sum()) < 2**62
                rows = (x * w[:, None]).sum(axis=0).tolist() if small else (x.astype(object) * w[:, None].astype(object)).sum(axis=0)
                total = [a + int(b) for a, b in zip(total, rows, strict=True)]
        yield pa.record_batch([pa.array(range(dims), pa.int32()), pa.array(list(map(str, total)))], ["i", "s"])

    parts = df.mapInArrow(summed, "i int, s string")
    out = [0] * dims
    for r in parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        out[r.i] = int(r.s)
    return out


def _whitened(batches: Iterator[pa.RecordBatch], centre: Centre, project: np.ndarray) -> Iterator[pa.RecordBatch]:
    dims = len(centre.sums)
    for batch in batches:
        if batch.num_rows:
            x = unpack(batch.column("x").to_pylist(), dims)
            z = pa.array(list(centre.apart(x) @ project), pa.list_(pa.float64()))
            yield pa.record_batch([batch.column("x"), batch.column("w"), pa.array(centre.deviations(x), pa.int64()), z], ["x", "w", "deviation", "z"])


def _values(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("z").flatten().to_numpy().reshape(-1, size)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000, components: int = 32, weighted: bool = True) -> DataFrame:
    """Per usable row and component: id, component, n, deviation, whitened, explained, identity_error.

    An entry c becomes x = floor(scale * c) + shift (the shift changes no column, so it is never added). weighted: each
    distinct vector counts as often as it occurs, else once; n is the sum of these weights. Components are numbered by
    falling variance, at most as many as there are dimensions; one without variance gets whitened and explained 0 and is
    left out of identity_error. The sign of a component is that of its largest entry, made positive.

    Null vectors, vectors with null or non-finite entries, and vectors whose length is not the commonest one (of equally
    common ones the greatest) give no rows; neither do empty vectors. Null ids stay, repeated rows stay repeated. Grid
    numbers are held within 2^53; a deviation that a long can't hold is null. An empty table gives an empty one. Other
    columns of vectors are not read.
    """
    spark = vectors.sparkSession
    kind = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    common = plain.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None or common["dims"] == 0:
        return spark.createDataFrame([], kind)
    dims = common["dims"]
    scratch = Scratch(spark)
    rows = scratch.table(plain.where(F.size("vector") == dims).mapInArrow(lambda it: _gridded(it, dims, scale), "x binary, ids array<long>"), passing=False)
    weight = F.sum(F.size("ids")) if weighted else F.lit(1)
    distinct = scratch.table(rows.groupBy("x").agg(weight.cast("long").alias("w")), passing=True)
    centre = Centre(int(distinct.agg(F.sum("w")).first()[0]), _sums(distinct, dims))

    covariance = _matrix(distinct, dims, lambda b: centre.apart(unpack(b.column("x").to_pylist(), dims))) / centre.n
    values, vectors_of = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[: min(components, dims)]
    total = float(np.trace(covariance))
    spread = np.where(values[order] > max(RANK_TOLERANCE * max(values.max(), 0.0), 0.0), values[order], 0.0)
    axes = vectors_of[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))])
    project = axes / np.sqrt(np.where(spread > 0, spread, np.inf))
    explained = [float(e / total) if total > 0 else 0.0 for e in spread]

    size = len(order)
    done = scratch.table(distinct.mapInArrow(lambda it: _whitened(it, centre, project), "x binary, w long, deviation long, z array<double>"), passing=False)
    entry = done.select(F.posexplode("z").alias("i", "z"), "w").groupBy("i").agg(F.sum(F.col("z") * F.col("w")).alias("s"))
    mean = np.zeros(size)
    for r in entry.collect():
        mean[r.i] = r.s / centre.n
    achieved = _matrix(done, size, lambda b: _values(b, size) - mean) / centre.n
    real = spread > 0
    error = float(np.abs(achieved - np.eye(size))[np.ix_(real, real)].max(initial=0.0))
    scratch.clear()

    # A frequent vector has one row per batch that holds it, not one per row of the table.
    both = rows.join(done.select("x", "deviation", "z"), "x").select(F.explode("ids").alias("id"), "deviation", "z")
    shares = F.array(*map(F.lit, explained))
    return both.select("id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        "id", (F.col("at") + 1).alias("component"), F.lit(centre.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
