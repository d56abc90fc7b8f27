"""Ranks and running counts that never sort one whole group in one task.

A window over a group puts the group on one task, and a group may hold a third of all rows.
Here the rows are range-partitioned by the order instead; each partition is a numbered block.
A rank is the place inside a block, or the rank inside (group, block), which is bounded by the size of a
partition, plus the total of the earlier blocks, of which there are at most as many as partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duploscope.session import materialize

ROW_BITS = 33  # of an increasing id, below the number of the partition


def with_blocks(df: DataFrame, order: Sequence[Column], name: str = "_block") -> DataFrame:
    """Rows with a block number that grows along `order`. Written, so that all readers see the same blocks."""
    return materialize(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


def global_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """0-based position of each row in the whole table; `order` must be unique.

    Rows are shuffled and written once: Spark's increasing ids are the number of a partition above a row's place in it.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(ranged.withColumn("_row", F.monotonically_increasing_id()))
    blocked = numbered.withColumn("_block", F.shiftright("_row", ROW_BITS))
    totals = blocked.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition of the table: the only global window, over a handful of numbers.
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return blocked.join(F.broadcast(offsets), "_block").withColumn(name, F.col("_offset") + inside).drop("_block", "_row", "_offset")


def running_count(
    blocked: DataFrame, keys: Sequence[str], order: Sequence[Column], flag: Column, name: str
) -> DataFrame:
    """Running sum of an integer flag inside each key, the row itself included.

    `blocked` comes from `with_blocks` with the same order.
    """
    flagged = blocked.withColumn("_flag", flag.cast("long"))
    per_block = flagged.groupBy(*keys, "_block").agg(F.sum("_flag").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    upto = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        flagged.withColumn("_inside", F.sum("_flag").over(upto))
        .join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_flag", "_inside", "_offset")
    )
