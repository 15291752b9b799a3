"""The place of each row in its group, for groups of any size: no task sorts a group whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docnest.functions.columns import column
from docnest.session import written

RANK = "__rank"
BEFORE = "__before"
_AT, _PART, _TIE = "__at", "__part", "__tie"
_PART_BITS = 33  # of the ids that Spark numbers rows with, the lower bits count within a partition


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str], weight: Column | None = None) -> DataFrame:
    """``rows`` with RANK, the place in its group (from 0, by ``order``, nulls first), and with ``weight`` also BEFORE, the
    sum of the weights of the rows before it in the group.

    Rows are range-partitioned by group and order and written once, with their place in their partition. A second pass adds up
    what the earlier partitions hold of each group: one row per group and partition, never one per row. Rows alike in all
    of ``order`` may take any order among themselves; the input partition is the last key, so that they do not meet in one task.
    Null group values are one group. The input is read twice (once to find the ranges), so write dear inputs before.
    """
    keys = [column(c) for c in [*group, *order]]
    spread = rows.withColumn(_TIE, F.spark_partition_id())
    sorted_rows = spread.repartitionByRange(*keys, column(_TIE)).sortWithinPartitions(*keys).drop(_TIE)
    placed = written(sorted_rows.withColumn(_AT, F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn(_PART, F.shiftrightunsigned(_AT, _PART_BITS))
    heavy = [] if weight is None else [F.sum(weight).alias("__w")]
    parts = placed.groupBy(*[column(c) for c in group], _PART).agg(F.min(_AT).alias("__first"), F.count(F.lit(1)).alias("__n"), *heavy)
    earlier = W.partitionBy(*[column(c) for c in group]).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    sums = {"__n_before": F.sum("__n").over(earlier)}
    if weight is not None:
        sums["__w_before"] = F.sum("__w").over(earlier)
    parts = parts.withColumns({n: F.coalesce(s, F.lit(0)) for n, s in sums.items()}).drop("__n", "__w")
    for i, c in enumerate(group):
        parts = parts.withColumnRenamed(c, f"__group_{i}")
    parts = parts.withColumnRenamed(_PART, "__in")
    same = F.col(_PART) == F.col("__in")
    for i, c in enumerate(group):
        same &= column(c).eqNullSafe(F.col(f"__group_{i}"))
    found = placed.join(parts, same).withColumn(RANK, F.col("__n_before") + F.col(_AT) - F.col("__first"))
    if weight is not None:
        within = W.partitionBy(*[column(c) for c in group], _PART).orderBy(_AT).rowsBetween(W.unboundedPreceding, -1)
        found = found.withColumn(BEFORE, F.col("__w_before") + F.coalesce(F.sum(weight).over(within), F.lit(0)))
    extra = [RANK] if weight is None else [RANK, BEFORE]
    return found.select(*[column(c) for c in rows.columns], *extra)
