"""Global order statistics without an unbounded single-task window.

``prefix_sums`` range-partitions rows by the sort order, writes the slices to the shared folder (so
slice numbers cannot change between uses), totals each slice, and adds the totals of earlier slices
to a window that only ever sees one slice. Range partitioning uses the whole sort key, so a value
shared by a third of the rows is still split when a unique key ends the order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from txnrisk.functions.windows import whole
from txnrisk.sources.workspace import settled

SLICE = "_slice"


def sort_columns(order: Sequence[str]) -> list[Column]:
    """``"name"`` ascending, ``"-name"`` descending."""
    return [F.col(n[1:]).desc() if n.startswith("-") else F.col(n).asc() for n in order]


def sliced(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Written rows in contiguous, numbered ranges of the sort order."""
    ranged = df.repartitionByRange(*sort_columns(order))
    return settled(ranged.withColumn(SLICE, F.spark_partition_id()))


def prefix_sums(
    df: DataFrame, order: Sequence[str], sums: Mapping[str, Column], totals: bool = False
) -> DataFrame:
    """Add, per entry of ``sums``, its total over all rows that sort strictly before the row.

    ``order`` must identify rows. With ``totals`` the grand totals come along as ``<name>_total``.
    """
    rows = sliced(df.select("*", *[v.alias(f"_v_{n}") for n, v in sums.items()]), order)
    per_slice = rows.groupBy(SLICE).agg(*[F.sum(f"_v_{n}").alias(n) for n in sums])
    # one row per slice: bounded by the number of shuffle partitions
    earlier = W.orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    carried = per_slice.select(
        SLICE,
        *[F.coalesce(F.sum(n).over(earlier), zero).alias(f"_c_{n}") for n in sums],
        *([F.sum(n).over(whole()).alias(f"{n}_total") for n in sums] if totals else []),
    )

    local = W.partitionBy(SLICE).orderBy(*sort_columns(order))
    before = local.rowsBetween(W.unboundedPreceding, -1)
    joined = rows.join(F.broadcast(carried), SLICE)
    return joined.select(
        *df.columns,
        *[
            (F.coalesce(F.sum(f"_v_{n}").over(before), zero) + F.col(f"_c_{n}")).alias(n)
            for n in sums
        ],
        *([F.col(f"{n}_total") for n in sums] if totals else []),
    )


def position(df: DataFrame, order: Sequence[str], name: str, total: str | None = None) -> DataFrame:
    """Zero-based place of every row in a unique global order, and optionally the row count."""
    out = prefix_sums(df, order, {name: F.lit(1).cast("bigint")}, totals=total is not None)
    return out.withColumnRenamed(f"{name}_total", total) if total else out


def ntile(place: Column, count: Column, tiles: int) -> Column:
    """Tile number from a zero-based place; the first ``count % tiles`` tiles hold one row more."""
    small = F.floor(count / F.lit(tiles))
    extra = count % F.lit(tiles)
    in_large = extra * (small + 1)
    return (
        F.when(place < in_large, F.floor(place / (small + 1)) + 1)
        .otherwise(F.floor((place - in_large) / F.greatest(small, F.lit(1))) + extra + 1)
        .cast("int")
    )


def values_at(
    histogram: DataFrame, before: str, count: str, value: str, places: Mapping[str, Column]
) -> list[Column]:
    """Aggregates that pick the value standing at each zero-based place of a counted, ordered set."""
    return [
        F.max(
            F.when(
                (F.col(before) <= p) & (p < F.col(before) + F.col(count)), F.col(value)
            )
        ).alias(n)
        for n, p in places.items()
    ]


def quantiles(df: DataFrame, value: str, points: Mapping[str, float]) -> DataFrame:
    """One row of exact, linearly interpolated quantiles (numpy's default rule)."""
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    placed = prefix_sums(counted, [value], {"_before": F.col("_n")}, totals=True)
    last = F.col("_before_total") - 1
    places = {}
    for name, q in points.items():
        places[f"_lo_{name}"] = F.floor(last * F.lit(float(q)))
        places[f"_hi_{name}"] = F.ceil(last * F.lit(float(q)))
    picked = placed.agg(
        F.max(last).alias("_last"), *values_at(placed, "_before", "_n", value, places)
    )
    return picked.select(
        *[
            (
                F.col(f"_lo_{n}")
                + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))
                * (F.col("_last") * F.lit(float(q)) - F.floor(F.col("_last") * F.lit(float(q))))
            ).alias(n)
            for n, q in points.items()
        ]
    )
