"""Running per-key columns that stay parallel when one key holds a large share of the rows.

A hashed choice of about one row in ``SLICE_ROWS`` gives cut points: they fall almost only on heavy
keys, whose rows they split into slices, while light keys stay whole. Rows are shuffled once by
(key, slice); a window inside each is completed with what the earlier slices of the same key carry over.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec, Window as W, functions as F

from txnrisk.operators.ordered import SLICE, sort_columns
from txnrisk.sources.workspace import settled

SLICE_ROWS = 50_000  # rows between two cut points of a heavy key, on average
MOST_CUTS = 2_000  # cut points kept in all; beyond it every slice grows with the table
RANGE_CUTS = 4  # cut points per written range, which evens out the ranges' sizes


@dataclass(frozen=True)
class Running:
    """How one running column is computed and carried.

    ``local`` builds it from a window; ``share`` aggregates what a slice hands on;
    ``join`` folds the shares of earlier slices (``sum`` or ``max``); ``add`` merges the carried
    value into the local one.
    """

    local: Callable[[WindowSpec], Column]
    share: Column
    join: Callable[[Column], Column]
    add: Callable[[Column, Column], Column]


def counted() -> Running:
    """1-based place within the key."""
    return Running(
        local=lambda w: F.row_number().over(w).cast("bigint"),
        share=F.count(F.lit(1)),
        join=F.sum,
        add=lambda mine, carried: mine + F.coalesce(carried, F.lit(0)),
    )


def total_before(value: Column) -> Running:
    """Sum over earlier rows of the key; null on the first."""
    return Running(
        local=lambda w: F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1)),
        share=F.sum(value),
        join=F.sum,
        add=lambda mine, carried: F.coalesce(mine + F.coalesce(carried, F.lit(0)), carried),
    )


def previous(value: Column) -> Running:
    """Value on the row before; ``value`` must lead the sort order, so a slice's last is its max."""
    return Running(
        local=lambda w: F.lag(value).over(w),
        share=F.max(value),
        join=F.max,
        add=lambda mine, carried: F.coalesce(mine, carried),
    )


def running_columns(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    columns: Mapping[str, Running],
    source: DataFrame | None = None,
    drawn: DataFrame | None = None,
) -> DataFrame:
    """``df`` with its running columns; rows without a key are left out, ``order`` is ascending.

    Cut points and shares are read from ``source``, a written table with the key, the order and what
    the shares add up (``df`` itself unless given), so a ``df`` still to be computed is computed once.
    ``drawn``: the source's ``cut_rows`` for this and other orders, if they have been drawn already.
    """
    source = df if source is None else source
    known = F.col(key).isNotNull()
    drawn = cut_rows(source, (key, order)) if drawn is None else drawn
    cuts = _cuts(drawn.where(known), key, order)
    if cuts is None:
        window = W.partitionBy(key).orderBy(*sort_columns(order))
        return df.where(known).select(
            "*", *[c.add(c.local(window), F.lit(None)).alias(n) for n, c in columns.items()]
        )
    shares = _numbered(source.where(known), cuts, key, order, "inner")
    shares = shares.groupBy(SLICE, key).agg(*[c.share.alias(n) for n, c in columns.items()])
    # one share per slice of a key that has cut points, at most twice MOST_CUTS
    earlier = W.partitionBy(key).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    carried = shares.select(
        SLICE, key, *[c.join(n).over(earlier).alias(f"_c_{n}") for n, c in columns.items()]
    )
    window = W.partitionBy(key, SLICE).orderBy(*sort_columns(order))
    rows = _numbered(df.where(known), cuts, key, order, "left")
    local = rows.select("*", *[c.local(window).alias(f"_l_{n}") for n, c in columns.items()])
    return local.join(F.broadcast(carried), [SLICE, key], "left").select(
        *df.columns,
        *[c.add(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, c in columns.items()],
    )


def in_ranges(
    df: DataFrame, key: str, order: Sequence[str], source: DataFrame, drawn: DataFrame | None = None
) -> DataFrame:
    """``df`` dealt into contiguous ranges of (key, order), one partition each.

    ``repartitionByRange`` computes its input twice, once to sample it; here the cut points come from
    ``source``, the written table behind ``df``. The distinct values of ``key`` are few (days).
    """
    drawn = cut_rows(source, (key, order)) if drawn is None else drawn
    cuts = _cuts(drawn.where(F.col(key).isNotNull()), key, order)
    if cuts is None:
        return df.repartition(1)
    size = F.coalesce(F.size("_cuts"), F.lit(0))
    upto = W.orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    keys = source.select(key).distinct().join(F.broadcast(cuts), key, "left")
    keys = settled(keys.withColumn("_before", F.coalesce(F.sum(size).over(upto), F.lit(0))))
    total = keys.agg(F.sum(size)).first()[0]
    placed = F.floor((F.coalesce("_before", F.lit(0)) + F.col(SLICE)) / F.lit(RANGE_CUTS)).cast("int")
    rows = _numbered(df, keys, key, order, "left").withColumn(SLICE, placed)
    return rows.repartitionById(total // RANGE_CUTS + 1, F.col(SLICE)).select(*df.columns)


def cut_rows(source: DataFrame, *orders: tuple[str, Sequence[str]]) -> DataFrame:
    """The few rows of ``source`` that are cut points of any of the (key, order) pairs, in one scan."""
    names = dict.fromkeys(name for key, order in orders for name in (key, *order))
    hits = [F.pmod(F.xxhash64(key, *order), F.lit(SLICE_ROWS)) == 0 for key, order in orders]
    return settled(source.select(*names).where(reduce(Column.__or__, hits)))


def _cuts(drawn: DataFrame, key: str, order: Sequence[str]) -> DataFrame | None:
    """Sorted cut points per key that has some, at most about ``MOST_CUTS`` in all; None without any."""
    drawn = drawn.select(key, F.struct(*order).alias("_at"), F.xxhash64(key, *order).alias("_h"))
    drawn = drawn.where(F.pmod("_h", F.lit(SLICE_ROWS)) == 0).distinct()
    found = drawn.count()
    if not found:
        return None
    thinner = SLICE_ROWS * -(-found // MOST_CUTS)
    kept = drawn.where(F.pmod("_h", F.lit(thinner)) == 0)
    cuts = kept.groupBy(key).agg(F.sort_array(F.collect_list("_at")).alias("_cuts"))
    return _with_steps(cuts, found)


def _with_steps(cuts: DataFrame, most: int) -> DataFrame:
    """With the powers of two up to the number of cut points (``most`` at most), greatest first."""
    powers = F.array(*[F.lit(1 << b) for b in reversed(range(most.bit_length()))])
    return cuts.withColumn("_steps", F.filter(powers, lambda step: step <= F.size("_cuts")))


def _numbered(rows: DataFrame, cuts: DataFrame, key: str, order: Sequence[str], how: str) -> DataFrame:
    """Rows with their slice: the number of the key's cut points they have reached, by bisection."""
    at = F.struct(*order)
    reached = F.aggregate(
        "_steps",
        F.lit(0),
        lambda n, step: F.when(F.get("_cuts", n + step - 1) <= at, n + step).otherwise(n),
    )
    joined = rows.join(F.broadcast(cuts), key, how)
    return joined.withColumn(SLICE, F.coalesce(reached, F.lit(0))).drop("_cuts", "_steps")
