"""Consumer lag and topic throughput from offset snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def consumer_lag(high_watermarks: DataFrame, committed: DataFrame, group: str) -> DataFrame:
    """Lag of one group on every partition of its topics.

    ``high_watermarks`` is (topic, partition, high), ``committed`` is (group,
    topic, partition, committed). A partition without a commit, or with a
    negative one, counts from 0.
    """
    own = committed.filter(F.col("group") == group).select("topic", "partition", "committed")
    start = F.greatest(F.coalesce(F.col("committed"), F.lit(0)), F.lit(0))
    return high_watermarks.join(own, ["topic", "partition"], "left").select(
        F.lit(group).alias("group"),
        "topic",
        "partition",
        start.cast("long").alias("committed_offset"),
        F.col("high").alias("latest_offset"),
        F.greatest(F.lit(0), F.col("high") - start).cast("long").alias("lag"),
    )


def total_lag(lag: DataFrame) -> DataFrame:
    return lag.groupBy("group", "topic").agg(
        F.sum("lag").alias("total_lag"), F.count("*").alias("partitions")
    )


def topic_throughput(watermarks: DataFrame, seconds: int = 60) -> DataFrame:
    """Retained messages per topic, and per second of ``seconds``, to two decimals.

    ``watermarks`` is (topic, partition, low, high).
    """
    total = F.sum(F.col("high") - F.col("low"))
    rate = F.when(total > 0, F.bround(total / F.lit(float(max(1, seconds))), 2)).otherwise(0.0)
    return watermarks.groupBy("topic").agg(
        F.count("*").alias("partition_count"),
        total.alias("total_messages"),
        rate.alias("estimated_rate_per_second"),
        F.lit(seconds).cast("long").alias("sample_window_seconds"),
    )


def topic_partitions(watermarks: DataFrame) -> DataFrame:
    """Retained messages of each partition of a topic."""
    return watermarks.select(
        "topic",
        "partition",
        F.col("low").alias("low_watermark"),
        F.col("high").alias("high_watermark"),
        (F.col("high") - F.col("low")).alias("message_count"),
    )
