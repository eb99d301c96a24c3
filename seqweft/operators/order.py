"""Positions in an order of all rows, without a task that sees them all.

Rows are dealt to tasks by ranges of the order, whose borders Spark draws from a sample, so tasks are even however the
values lie. A row's position is its place in its range plus what lies in the ranges before; of each range one row goes to
the window that adds these up, so that window is as large as the number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqweft.operators.shared import stored

_PLACE_BITS = 33  # of a generated id, those below the task's number


def in_ranges(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows dealt to tasks by ranges of `by` (equal values stay together) and sorted within by `order`."""
    return df.repartitionByRange(*by).sortWithinPartitions(*order)


def numbered(ranges: DataFrame, name: str = "ranges") -> DataFrame:
    """A written table with part, the range, and at, the place within it from 0. Rows must lie as in_ranges left them."""
    marked = ranges.withColumn("_id", F.monotonically_increasing_id())
    return stored(marked.withColumns({"part": F.shiftright("_id", _PLACE_BITS).cast("int"), "at": F.col("_id").bitwiseAND((1 << _PLACE_BITS) - 1)}).drop("_id"), name)


def starts(table: DataFrame, weight: Column | None = None, *more: Column) -> DataFrame:
    """(part, before, ...): how many rows (or how much weight) lie in the ranges before; one row for each range."""
    sums = table.groupBy("part").agg((F.count("*") if weight is None else F.sum(weight)).alias("_n"), *more)
    before = F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sums.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))).drop("_n")


def with_positions(table: DataFrame) -> DataFrame:
    """Adds pos, the position in the whole order from 0."""
    return table.join(F.broadcast(starts(table)), "part").withColumn("pos", F.col("before") + F.col("at")).drop("before")


def running(groups: DataFrame, by: list[str], count: str) -> DataFrame:
    """groups (different values of `by`) with before: the sum of `count` over all groups that come before in the order."""
    table = numbered(in_ranges(groups, by, by), "groups")
    inner = F.sum(count).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    within = table.withColumn("_own", F.coalesce(inner, F.lit(0).cast("long")))
    return within.join(F.broadcast(starts(table, F.col(count))), "part").withColumn("before", F.col("before") + F.col("_own")).drop("_own", "part", "at")
