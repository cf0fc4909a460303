"""Sorting in slices: what a single-task sort or window would do, spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from txnrisk.sources.workspace import settled

SLICE = "slice_no"


def in_slices(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` range-partitioned by ``order`` as a written table; ``slice_no`` ascends with the order.

    Writing it fixes which rows a slice holds: a range exchange samples its input and may cut a
    recomputed one elsewhere.
    """
    return settled(df.repartitionByRange(*order).withColumn(SLICE, F.spark_partition_id()))


def before_each_slice(per_slice: DataFrame, value: Column, within: list[str] = ()) -> Column:
    """Window over slice totals (one row per slice, and per ``within``), earlier slices only."""
    over = Window.partitionBy(*within).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return value.over(over)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Consecutive row numbers from 0 in the given order, without one task that sees all rows.

    Rows that tie in ``order`` take their numbers in any order, so order by every column that
    matters. A block of equal rows is split over slices by the position they were read from.
    """
    tie = F.xxhash64(F.monotonically_increasing_id())
    slices = in_slices(df.withColumn("tie_break", tie), *order, F.col("tie_break"))
    counts = slices.groupBy(SLICE).agg(F.count("*").alias("n"))
    first = F.coalesce(before_each_slice(counts, F.sum("n")), F.lit(0))
    starts = counts.select(SLICE, first.alias("first_no"))
    inside = F.row_number().over(Window.partitionBy(SLICE).orderBy(*order, F.col("tie_break")))
    return (
        slices.withColumn(name, inside.cast("long") - 1)
        .join(starts, SLICE)
        .withColumn(name, F.col(name) + F.col("first_no"))
        .drop(SLICE, "first_no", "tie_break")
    )
