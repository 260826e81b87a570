"""Ranks of whole lists without a window: a repository's rows may spread over any number of tasks.

Rows are range partitioned by (group, order keys) and sorted, so each task holds a stretch of the list. Row ids
given after the sort count within a task; one small row per (task, group) says how many came before, and
only those rows meet in a window. The sorted rows are written once, so that ids and counts agree. What came before
is broadcast if it has few rows, so that the list is not shuffled once more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, unbounded

#: Rows of (task, group) that are broadcast; more of them are joined by a shuffle.
MOST_OFFSETS = 100_000


def ranked(df: DataFrame, group: str, order: Sequence[Column | str], name: str = "rank", base: str | None = None) -> DataFrame:
    """``df`` with the 1-based place of each row among the rows of its ``group`` value, by ``order``.

    Rows that tie on all order keys get different places in an arbitrary order; give keys that settle it.
    """
    keys = [F.col(group), *[F.col(c) if isinstance(c, str) else c for c in order]]
    sorted_rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    held = materialize(sorted_rows, "ranked", "write", base)
    # the upper bits of an id number the task, the lower ones its rows
    held = held.withColumn("_part", F.shiftright("_id", 33))
    parts = held.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0).cast("bigint"))
    offsets = parts.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), (before - F.col("_first") + 1).alias("_shift"))
    offsets = materialize(offsets, "offsets", "write", base)
    offsets = F.broadcast(offsets) if offsets.count() <= MOST_OFFSETS else unbounded(offsets)
    return held.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p"))).withColumn(
        name, F.col("_id") + F.col("_shift")).drop("_id", "_part", "_group", "_p", "_shift")
