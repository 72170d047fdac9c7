"""Operational telemetry analytics on Spark DataFrames and Structured Streaming."""

from tidewatch.rules import Rules

__all__ = ["Rules"]
