"""Document quality from random Fourier features of document statistics.

Statistics of the text alone (shares of kinds of characters, word and line shapes, repetition) are standardised and
mapped to random Fourier features, which approximate a Gaussian kernel. Ridge regression on them needs only the sums of
the features' products, which tasks add up for their rows. The raw scores are then calibrated by isotonic regression on
rows that the ridge fit didn't see, over a bounded number of score bins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, texts

#: Random features, and the width of the kernel in units of the standardised statistics.
FEATURES, WIDTH, RIDGE = 256, 4.0, 1e-2
#: Labelled rows that are fitted at most (in expectation): those whose hashed ids fall into as large a share.
MAX_LABELLED = 200_000
#: Score bins of the calibration.
BINS = 512
STATISTICS = 22
_CLASSES = np.zeros(256, np.uint8)
for _chars, _kind in ((b" \t\r\n\x0b\x0c", 1), (b"0123456789", 2), (b".,;:'\"-?()", 3), (b"!#$%&*+/<=>@[\\]^_`{|}~", 4)):
    _CLASSES[list(_chars)] = _kind
_CLASSES[65:91], _CLASSES[97:123], _CLASSES[128:] = 5, 6, 7
_TAIL = re.compile(rb"[^\w\s]{2,}(?=\s|$)")


def statistics(text: bytes) -> list[float]:
    """Statistics of a UTF-8 text; of an empty one they are all 0."""
    if not text:
        return [0.0] * STATISTICS
    size = len(text)
    kinds = np.bincount(_CLASSES[np.frombuffer(text, np.uint8)], minlength=8)
    letters = max(1, int(kinds[5] + kinds[6] + kinds[7]))
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    counts = Counter(words)
    filled = [line for line in lines if line.strip()]
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    distinct_lines = len(set(filled)) / max(1, len(filled))
    return [
        np.log1p(size), np.log1p(len(words)), np.log1p(len(lines)),
        *(kinds[1:5] / size), kinds[5] / letters, kinds[7] / letters, letters / size,
        float(lengths.mean()), float(lengths.std()), float(lengths.max() > 40),
        len(counts) / n, len(counts) / n**0.8, counts.most_common(1)[0][1] / n if words else 0.0,
        distinct_lines, len(words) / max(1, len(filled)),
        text.count(b"|") / n, text.count(b"!") / n, len(_TAIL.findall(text)) / n, sum(line.rstrip().endswith((b".", b"!", b"?")) for line in filled) / max(1, len(filled)),
    ]


@dataclass
class QualityModel:
    """score(statistics) -> calibrated chance of label 1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return fourier(rows, self.mean, self.scale) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(rows), self.knots, self.values), 0.0, 1.0)


def fourier(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features [row, FEATURES + 1]: cosines of random projections, and a constant."""
    rng = np.random.default_rng(17)
    project, phase = rng.normal(size=(STATISTICS, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.sqrt(2 / FEATURES) * np.cos(np.clip((rows - mean) / scale, -8, 8) @ project + phase)
    return np.hstack([z, np.ones((len(rows), 1))])


def isotonic(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rising means of labels in the order of scores, weighted by counts (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for i in np.argsort(scores, kind="stable"):
        blocks.append([labels[i], counts[i], 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            value, weight, members = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[1] + value * weight) / (last[1] + weight)
            last[1] += weight
            last[2] += members
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _matrix(documents: list[bytes]) -> np.ndarray:
    return np.array([statistics(text) for text in documents], np.float64).reshape(-1, STATISTICS)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, documents in texts(batches, "text"):
        yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array([statistics(t) for t in documents], pa.list_(pa.float64()))], ["id", "label", "x"])


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(batch.column("x").to_pylist(), np.float64).reshape(-1, STATISTICS)
    return x, batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((3, STATISTICS))
    for batch in batches:
        x, _ = _rows(batch)
        total += np.stack([np.full(STATISTICS, len(x)), x.sum(axis=0), (x**2).sum(axis=0)])
    yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])


def _products(batches: Iterator[pa.RecordBatch], mean: np.ndarray, scale: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The normal equations of a task's rows; both labels weigh the same in the end, so each has sums of its own."""
    total = np.zeros((2, FEATURES + 1, FEATURES + 2))
    for batch in batches:
        x, y = _rows(batch)
        z = fourier(x, mean, scale)
        for label in (0, 1):
            own = z[y == label]
            total[label, :, :-1] += own.T @ own
            total[label, :, -1] += own.sum(axis=0)
    yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])


def _binned(batches: Iterator[pa.RecordBatch], model: QualityModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = _rows(batch)
        raw = model.raw(x)
        place = np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
        yield pa.record_batch([pa.array(place), pa.array(raw), pa.array(y)], ["bin", "raw", "label"])


def _added(df: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of the tasks' arrays, added up over the cluster first so that the driver gets a few."""

    def plus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for x in batch.column("sums").to_pylist():
                total += np.frombuffer(x).reshape(shape)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])

    few = df.repartition(8).mapInArrow(plus, "sums binary")
    return sum((np.frombuffer(bytes(r.sums)).reshape(shape) for r in few.collect()), np.zeros(shape))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> QualityModel:
    """Fit on the labelled documents. Of more than max_labelled labels a hash of the id picks about that many.

    One in four of the labelled ids (by hash) calibrates, the others fit. Labels other than 0 and 1 and null ids are left
    out; repeated labels of an id count as often as they stand there. Without any labelled document every score is 0.5.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    count = known.count()
    chosen = known if count <= max_labelled else known.where(F.pmod(F.xxhash64("id"), F.lit(count)) < max_labelled)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # About max_labelled rows of an id and a label: safe to broadcast.
    rows = settle(rows.join(F.broadcast(chosen), "id").mapInArrow(_measured, "id long, label int, x array<double>"))
    calibrates = F.pmod(F.xxhash64(F.lit("calibrate"), "id"), F.lit(4)) == 0
    n, sums, squares = _added(rows.where(~calibrates).mapInArrow(_moments, "sums binary"), (3, STATISTICS))
    mean = sums / np.maximum(n, 1)
    scale = np.sqrt(np.maximum(squares / np.maximum(n, 1) - mean**2, 0)) + 1e-6
    products = _added(rows.where(~calibrates).mapInArrow(lambda it: _products(it, mean, scale), "sums binary"), (2, FEATURES + 1, FEATURES + 2))
    weight = 1 / np.maximum(products[:, -1, -1], 1)
    gram = np.tensordot(weight, products[:, :, :-1], 1) + RIDGE / FEATURES * np.eye(FEATURES + 1)
    weights = np.linalg.solve(gram, weight[1] * products[1, :, -1])
    model = QualityModel(mean, scale, weights, np.array([0.0]), np.array([0.5]))
    bins = rows.where(calibrates).mapInArrow(lambda it: _binned(it, model), "bin long, raw double, label double")
    found = bins.groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("label").alias("label"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    if found:
        raw, label, count = (np.array([r[c] for r in found], np.float64) for c in ("raw", "label", "n"))
        model.knots, model.values = raw, isotonic(raw, label, count)
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: object) -> Iterator[pa.RecordBatch]:
    fitted = model.value
    for batch, documents in texts(batches, "text"):
        scores = fitted.score(_matrix(documents))
        names = [n for n in batch.schema.names]
        yield pa.record_batch([*batch.columns, pa.array(scores)], [*names, "score"])


def score(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """docs with score, the chance that a text's label is 1; null and empty texts get the score of an empty text.

    Only the text is read for it. A column of docs named score is replaced. Repeated rows get equal scores.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in (text_col, "score")]
    plain = docs.select(F.col(text_col).cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    out = plain.mapInArrow(lambda it: _scored(it, fitted), f"{schema}, score double")
    back = {text_col: F.col("text")} | {c: F.col(f"_{i}") for i, c in enumerate(others)}
    return out.select(*(back[c].alias(c) for c in docs.columns if c in back), "score")
