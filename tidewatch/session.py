"""Session settings for telemetry jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession

STREAM_STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Adaptive plans, UTC times and a spilling state store.

    Partition counts and the checkpoint folder belong to the cluster and are
    left as they are.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": STREAM_STATE_PROVIDER,
        # Segment checkpoints are compressed, and removed once nothing refers to them.
        "spark.checkpoint.compress": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder
