"""Step-by-step models in plain Python, written independently of the operators."""

from __future__ import annotations

import math
import re

LIMITS = {
    "latency_ms": 200.0,
    "backpressure_ratio": 0.5,
    "checkpoint_duration_ms": 30000.0,
    "heap_usage_percent": 85.0,
    "consumer_lag": 10000.0,
}


class Series:
    """One key: metric samples move a baseline, logs move an error share."""

    def __init__(self, alpha=0.1, sigma=3.0, warmup=20):
        self.alpha, self.sigma, self.warmup = alpha, sigma, warmup
        self.mean = None
        self.var = 0.0
        self.count = 0
        self.errors = 0

    def metric(self, name, value):
        out = []
        limit = LIMITS.get(name)
        if limit is not None and value > limit:
            out.append(("threshold", limit, value))
        if self.mean is None:
            self.mean, self.var, self.count = value, 0.0, 1
            return out
        sd = math.sqrt(self.var) if self.var == self.var else math.nan
        if self.count >= self.warmup and sd > 1e-9 and abs(value - self.mean) > self.sigma * sd:
            out.append(("deviation", self.mean, value))
        delta = value - self.mean
        self.mean += self.alpha * delta
        self.var = (1 - self.alpha) * (self.var + self.alpha * delta * delta)
        self.count += 1
        return out

    def log(self, severity):
        self.count += 1
        self.errors += severity >= 3
        rate = self.errors / self.count
        return [("errors", 0.2, rate)] if self.count > 10 and rate > 0.2 else []


def number(text):
    if text is None:
        return None
    found = re.search(r"[-+]?\d*\.?\d+", text.replace(",", ""))
    return float(found.group()) if found else None


class Memory:
    """Incident memory over cycles, one detection at a time."""

    def __init__(self, gap=1, worsen=0.25, dedup=True):
        self.gap, self.worsen, self.dedup = gap, worsen, dedup
        self.known = {}

    def resolved(self, cycle, current=()):
        return sorted(f for f, m in self.known.items() if f not in current and cycle - 1 - m["last"] <= self.gap)

    def observe(self, kind, component, observed, cycle, delivered):
        key = f"{kind}:{component or 'unknown'}"
        value = number(observed)
        m = self.known.get(key)
        if m is None or cycle - m["last"] > self.gap:
            status = "new"
            m = self.known[key] = {"n": 1, "reported": False}
        else:
            prior = m["value"]
            worse = prior is not None and value is not None and prior > 0 and (value - prior) / prior >= self.worsen
            status = "worsening" if worse else "ongoing"
            m["n"] += 1
        m["last"], m["value"] = cycle, value
        report = status != "ongoing" or not self.dedup or not m["reported"]
        if report and delivered:
            m["reported"] = True
        return key, status, m["n"], report
