"""Joins that spread the rows of very frequent keys over many tasks.

Spark's own skew handling splits a join side only where both sides come
straight from a shuffle; a side that is aggregated first, as below, is left
alone. So frequent keys are found by a sketch, inside the same query, and
salted; a query without frequent keys runs the same plan with an empty list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MAX_HOT_KEYS = 1_000
_MAX_SALTS = 256
_SALT = "_salt"


def hot_keys(df: DataFrame, keys: list[str]) -> Column:
    """Hashes of the keys with more than twice an even share of a task, from one mergeable sketch.

    A scalar subquery: nothing runs while the query is built. It holds fewer
    hashes than there are shuffle partitions. A key that the sketch misses
    costs time, not rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = max(1, min(n, _MAX_HOT_KEYS))
    top = F.call_function("approx_top_k", F.col("h"), F.lit(k), F.lit(max(1000, 20 * k)))
    found = df.select(F.xxhash64(*keys).alias("h")).agg(top.alias("top"), F.count("*").alias("rows"))
    frequent = F.filter("top", lambda t: t["count"] > F.col("rows") * 2 / n)
    return found.select(F.coalesce(F.transform(frequent, lambda t: t["item"]), F.array().cast("array<bigint>"))).scalar()


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join where a few keys may hold a large part of ``left``.

    ``right`` should hold few rows per key: those of frequent keys are repeated
    for each salt, while each row of ``left`` gets one. ``how`` is inner, left,
    left_semi or left_anti.
    """
    salts = min(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), _MAX_SALTS)
    is_hot: Column = F.array_contains(hot_keys(left, keys), F.xxhash64(*keys))
    # The partition is the same when a task is repeated, and differs even between equal rows.
    salted = left.withColumn(_SALT, F.when(is_hot, F.spark_partition_id() % salts).otherwise(F.lit(0)))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = right.withColumn(_SALT, F.explode(every))
    return salted.join(spread, [*keys, _SALT], how).drop(_SALT)
