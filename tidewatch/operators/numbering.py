"""Places of rows within a key, without ever ordering a whole key in one task.

The digits of a whole-number column cut a key into blocks, and these into
blocks of blocks. Rows are ordered inside a block, blocks are counted, and the
counts of earlier blocks are added up level by level, so no window holds more
than 2**bits rows, however many of them share a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows or blocks that one window may hold, as a power of two.
BITS = 20


def numbered(df: DataFrame, key: str, order: str, name: str, bits: int = BITS) -> DataFrame:
    """Add ``name``: 0, 1, ... over the rows of each key, by ``order``.

    ``order`` is a whole number that is unique within a key. Null keys form a
    key of their own, and a null in ``order`` comes before all numbers.
    """

    def earlier(*partition: str) -> Window:
        return Window.partitionBy(*partition[:-1]).orderBy(partition[-1]).rowsBetween(Window.unboundedPreceding, -1)

    # A struct is never null, so null keys meet in the joins as well.
    rows = df.withColumn("_key", F.struct(key)).withColumn("_block", F.struct(F.shiftright(order, bits).alias("at")))
    blocks = rows.groupBy("_key", "_block").agg(F.count("*").alias("n"))
    blocks = blocks.withColumn("_upper", F.struct(F.shiftright("_block.at", bits).alias("at")))
    uppers = blocks.groupBy("_key", "_upper").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(earlier("_key", "_upper")), F.lit(0))
    uppers = uppers.select("_key", "_upper", before.alias("_far"))
    near = F.coalesce(F.sum("n").over(earlier("_key", "_upper", "_block")), F.lit(0))
    offsets = (
        blocks.select("_key", "_upper", "_block", near.alias("_near"))
        .join(uppers, ["_key", "_upper"])
        .select("_key", "_block", (F.col("_near") + F.col("_far")).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy("_key", "_block").orderBy(order)) - 1
    return (
        rows.withColumn("_inside", inside)
        .join(offsets, ["_key", "_block"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .select(*df.columns, name)
    )
