"""Settings that change results, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rules:
    """One frozen rule set, shared by the batch and the streaming operators."""

    # Alerting. A metric without a limit never raises a threshold alert.
    limits: dict[str, float] = field(
        default_factory=lambda: {
            "latency_ms": 200.0,
            "backpressure_ratio": 0.5,
            "checkpoint_duration_ms": 30000.0,
            "heap_usage_percent": 85.0,
            "consumer_lag": 10000.0,
        }
    )
    ema_alpha: float = 0.1
    sigma: float = 3.0
    warmup_samples: int = 20
    error_rate_limit: float = 0.2
    error_rate_min_events: int = 10
    error_severity: int = 3

    # Read limits; None reads everything.
    events_max_count: int | None = None
    events_default_count: int = 20
    log_scan_depth: int | None = None
    metric_max_series: int | None = None
    max_exceptions: int | None = None
    audit_limit: int | None = None

    # Incidents.
    interval_seconds: int = 60
    ongoing_gap: int = 1
    worsen_pct: float = 0.25
    dedup: bool = True
    diagnostic_forks: int = 1
    hypothesis_mode: str = "map"
    # A larger diagnosis is rejected, never cut. The others cut texts where they are set.
    handoff_max_chars: int = 50_000
    summary_max_chars: int | None = None
    sanitize_max_chars: int | None = None

    def __post_init__(self) -> None:
        if not 0.0 <= self.ema_alpha <= 1.0:
            raise ValueError("ema_alpha must lie in [0, 1]")
        if self.hypothesis_mode not in ("map", "static"):
            raise ValueError("hypothesis_mode must be 'map' or 'static'")


MIN_STDDEV = 1e-9
