"""Arithmetic of the running baselines: EWMA mean and variance, log error rate.

The same functions serve the batch scan and the streaming state. A state is the
list ``[seeded, mean, variance, count, errors]``.

The variance recursion v' = (1-a)(v + a*d*d) is the variance of a mixture that
gives the newest sample weight a and everything before it weight 1-a. A run of k
samples is therefore a distribution (weight 1-(1-a)^k, mean, variance), and runs
compose as mixtures, without the cancellation of a form in squared means.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T

from tidewatch.rules import MIN_STDDEV, Rules
from tidewatch.schema import record

NEW = [0.0, 0.0, 0.0, 0.0, 0.0]
_SMALL = 48


def ewma(
    x: np.ndarray, mean: float | None, variance: float, alpha: float
) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Mean and variance *before* each sample, and after the last one.

    With no mean yet, the first sample seeds it; its own "before" is NaN. From
    the sample after a NaN or infinite one, the baseline is NaN for good.
    """
    n = len(x)
    before_mean = np.full(n, np.nan)
    before_var = np.full(n, np.nan)
    if n == 0:
        return before_mean, before_var, math.nan if mean is None else mean, variance
    begin = 0
    if mean is None:
        mean, variance, begin = float(x[0]), 0.0, 1
    bad = np.flatnonzero(~np.isfinite(x))
    stop = n if not len(bad) else max(int(bad[0]), begin)
    if not math.isfinite(mean):
        if begin < n:
            before_mean[begin] = mean
            before_var[begin] = variance
            mean = variance = math.nan
        return before_mean, before_var, mean, variance
    if stop - begin <= _SMALL or alpha == 0.0:
        for i in range(begin, stop):
            before_mean[i] = mean
            before_var[i] = variance
            delta = float(x[i]) - mean
            mean += alpha * delta
            variance = (1.0 - alpha) * (variance + alpha * delta * delta)
    else:
        means = _decay(mean, x[begin:stop], alpha)
        delta = x[begin:stop] - means[:-1]
        variances = _decay(variance, (1.0 - alpha) * delta * delta, alpha)
        before_mean[begin:stop] = means[:-1]
        before_var[begin:stop] = variances[:-1]
        mean, variance = float(means[-1]), float(variances[-1])
    if stop < n:
        before_mean[stop] = mean
        before_var[stop] = variance
        mean = float(x[stop]) if stop == n - 1 else math.nan
        variance = math.nan if stop < n - 1 or math.isnan(mean) else math.inf
    return before_mean, before_var, mean, variance


def _decay(start: float, x: np.ndarray, alpha: float) -> np.ndarray:
    """y0 = start, y[i+1] = (1-alpha) y[i] + alpha x[i]."""
    return pd.Series(np.concatenate(([start], x))).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def _mix(
    n1: float, m1: float, v1: float, n2: float, m2: float, v2: float, alpha: float
) -> tuple[float, float, float]:
    """Distribution of n1 samples followed by n2 samples."""
    if n1 == 0:
        return n2, m2, v2
    if n2 == 0:
        return n1, m1, v1
    keep = (1.0 - alpha) ** n2
    w1 = keep * (1.0 - (1.0 - alpha) ** n1)
    w2 = 1.0 - keep
    total = w1 + w2
    if total == 0.0:
        return n1 + n2, 0.0, 0.0
    w1, w2 = w1 / total, w2 / total
    return n1 + n2, w1 * m1 + w2 * m2, w1 * v1 + w2 * v2 + w1 * w2 * (m1 - m2) ** 2


class BaselineKernel:
    """Base of the two scans over (kind, value, severity) rows of one series.

    ``is_metric`` rows move the EWMA, the others are logs and move the error
    count. Both share one row count, which the first metric restarts at 1.
    """

    columns = ["is_metric", "value", "severity"]
    output: T.StructType

    def __init__(self, rules: Rules) -> None:
        self.rules = rules

    # A summary is [rows, rows from the first metric on, errors, first value,
    # samples after it, their mean, their variance]; no metric: rows from = 0.
    def summarize(self, rows: dict[str, np.ndarray]) -> list[float]:
        metric = rows["is_metric"].astype(bool)
        n = len(metric)
        errors = float(np.count_nonzero(~metric & (rows["severity"] >= self.rules.error_severity)))
        at = np.flatnonzero(metric)
        if not len(at):
            return [float(n), 0.0, errors, 0.0, 0.0, 0.0, 0.0]
        x = rows["value"][at].astype(float)
        rest = x[1:]
        k, mean, var = 0.0, 0.0, 0.0
        if len(rest):
            a = self.rules.ema_alpha
            weights = a * (1.0 - a) ** np.arange(len(rest) - 1, -1, -1.0)
            total = weights.sum()
            k = float(len(rest))
            if total > 0.0:
                with np.errstate(invalid="ignore", over="ignore"):
                    mean = float(weights @ rest / total)
                    var = float(weights @ (rest - mean) ** 2 / total)
        return [float(n), float(n - at[0]), errors, float(x[0]), k, mean, var]

    def combine(self, left: list[float], right: list[float]) -> list[float]:
        n, tail, errors, first, k, mean, var = left
        n2, tail2, errors2, first2, k2, mean2, var2 = right
        if tail2 == 0:
            return [n + n2, tail + n2 if tail else 0.0, errors + errors2, first, k, mean, var]
        if tail == 0:
            return [n + n2, tail2, errors + errors2, first2, k2, mean2, var2]
        a = self.rules.ema_alpha
        joined = _mix(*_mix(k, mean, var, 1.0, first2, 0.0, a), k2, mean2, var2, a)
        return [n + n2, tail + n2, errors + errors2, first, *joined]

    def advance(self, state: list[float] | None, summary: list[float]) -> list[float]:
        seeded, mean, var, count, errors = state or NEW
        n, tail, more, first, k, k_mean, k_var = summary
        if tail == 0:
            return [seeded, mean, var, count + n, errors + more]
        a = self.rules.ema_alpha
        if seeded:
            _, _, mean, var = ewma(np.array([first]), mean, var, a)
            count += n
        else:
            mean, var, count = first, 0.0, tail
        if k:
            keep = (1.0 - a) ** k
            gap = mean - k_mean
            mean, var = (
                keep * mean + (1.0 - keep) * k_mean,
                keep * var + (1.0 - keep) * k_var + keep * (1.0 - keep) * gap * gap,
            )
        return [1.0, mean, var, count, errors + more]

    def walk(
        self, state: list[float] | None, rows: dict[str, np.ndarray]
    ) -> tuple[dict[str, np.ndarray], list[float]]:
        """Per-row state: mean and variance before, count and errors after."""
        seeded, mean, var, count, errors = state or NEW
        metric = rows["is_metric"].astype(bool)
        n = len(metric)
        counts = count + np.arange(1, n + 1, dtype=float)
        at = np.flatnonzero(metric)
        if len(at) and not seeded:
            counts[at[0] :] = np.arange(1, n - at[0] + 1, dtype=float)
        bad = ~metric & (rows["severity"] >= self.rules.error_severity)
        error_counts = errors + np.cumsum(bad)
        before_mean = np.full(n, np.nan)
        before_var = np.full(n, np.nan)
        if len(at):
            x = rows["value"][at].astype(float)
            with np.errstate(invalid="ignore", over="ignore"):
                before_mean[at], before_var[at], mean, var = ewma(
                    x, mean if seeded else None, var, self.rules.ema_alpha
                )
            seeded = 1.0
        after = [seeded, mean, var, float(counts[-1]), float(error_counts[-1])]
        return {
            "metric": metric,
            "count": counts,
            "errors": error_counts,
            "mean": before_mean,
            "variance": before_var,
        }, after


class AlertKernel(BaselineKernel):
    """Rows that deviate from their baseline or follow too many errors."""

    output = record("deviation boolean, threshold double, actual double")

    def alerts(
        self, state: list[float] | None, rows: dict[str, np.ndarray]
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[float]]:
        """(row positions, is deviation, threshold, actual, state after)."""
        r = self.rules
        walked, after = self.walk(state, rows)
        metric, value = walked["metric"], rows["value"].astype(float)
        with np.errstate(invalid="ignore", over="ignore"):
            sd = np.sqrt(walked["variance"])
            deviates = (
                metric
                & (walked["count"] - 1 >= r.warmup_samples)
                & (sd > MIN_STDDEV)
                & (np.abs(value - walked["mean"]) > r.sigma * sd)
            )
            rate = walked["errors"] / walked["count"]
        erring = ~metric & (walked["count"] > r.error_rate_min_events) & (rate > r.error_rate_limit)
        at = np.flatnonzero(deviates | erring)
        is_deviation = deviates[at]
        threshold = np.where(is_deviation, walked["mean"][at], r.error_rate_limit)
        actual = np.where(is_deviation, value[at], rate[at])
        return at, is_deviation, threshold, actual, after

    def scan(
        self, state: list[float] | None, batch: pa.RecordBatch, rows: dict[str, np.ndarray]
    ) -> tuple[pa.RecordBatch | None, list[float]]:
        at, is_deviation, threshold, actual, after = self.alerts(state, rows)
        if not len(at):
            return None, after
        added = [pa.array(is_deviation), pa.array(threshold), pa.array(actual)]
        return _emit(batch.take(pa.array(at)), self.output, added), after


class StateKernel(BaselineKernel):
    """The baseline after each metric sample."""

    output = record("samples long, mean double, variance double")

    def scan(
        self, state: list[float] | None, batch: pa.RecordBatch, rows: dict[str, np.ndarray]
    ) -> tuple[pa.RecordBatch | None, list[float]]:
        walked, after = self.walk(state, rows)
        at = np.flatnonzero(walked["metric"])
        if not len(at):
            return None, after
        mean = np.append(walked["mean"][at][1:], after[1])
        var = np.append(walked["variance"][at][1:], after[2])
        added = [pa.array(walked["count"][at].astype("int64")), pa.array(mean), pa.array(var)]
        return _emit(batch.take(pa.array(at)), self.output, added), after


def _emit(kept: pa.RecordBatch, output: T.StructType, added: list[pa.Array]) -> pa.RecordBatch:
    names = [*kept.schema.names, *output.names]
    return pa.RecordBatch.from_arrays([*kept.columns, *added], names=names)


class CounterKernel:
    """Increase of a counter since its previous sample; a drop is a restart."""

    columns = ["value"]
    output = record("increase double")

    # Summary [first, last]; state [last].
    def summarize(self, rows: dict[str, np.ndarray]) -> list[float]:
        return [float(rows["value"][0]), float(rows["value"][-1])]

    def combine(self, left: list[float], right: list[float]) -> list[float]:
        return [left[0], right[1]]

    def advance(self, state: list[float] | None, summary: list[float]) -> list[float]:
        return [summary[1]]

    def scan(
        self, state: list[float] | None, batch: pa.RecordBatch, rows: dict[str, np.ndarray]
    ) -> tuple[pa.RecordBatch | None, list[float]]:
        value = rows["value"].astype(float)
        previous = np.concatenate(([state[0] if state else value[0]], value[:-1]))
        increase = np.where(value >= previous, value - previous, value)
        return _emit(batch, self.output, [pa.array(increase)]), [float(value[-1])]
