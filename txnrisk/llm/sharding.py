"""Sharding by a keyed permutation of row numbers.

Rows get global numbers in a stated order; a Feistel network over a product of two nearly equal
ranges, walked until it falls back into ``0 .. n-1``, permutes the numbers. The permuted number
alone gives shard and slot, so any row's place can be computed, and any slot's row found, without a
table. Counts of shards differ by one at most and slots have no gaps, whatever the rows hold.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, functions as F

from txnrisk.llm.ordering import numbered
from txnrisk.sources.workspace import settled

PRIME = 2**31 - 1
ROUNDS = 8


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Multiplier, offset and added constant of each round's cubic."""

    def draw(i: int, part: int) -> int:
        return 1 + int.from_bytes(hashlib.sha256(f"{seed}/{i}/{part}".encode()).digest()[:8]) % (PRIME - 1)

    return [(draw(i, 0), draw(i, 1), draw(i, 2)) for i in range(rounds)]


def sides(n: int) -> tuple[int, int]:
    """Least ``a * b >= n`` with ``a`` the rounded-up root: less than ``a`` numbers lie outside."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def permuted(number: Column, n: int, seed: int) -> Column:
    """The image of ``number`` (0 .. n-1) under the permutation; products stay below 2**62.

    At most ``a - 1`` of the ``a * b`` numbers lie outside, and a walk visits each of them once at
    most, so up to about 4,000 rows the bound on walks is a certainty; beyond, a walk of 64 steps has a
    chance below ``64 ** -64``.
    """
    if n > 2**52:  # larger quotients are no longer exact doubles
        raise ValueError("more rows than the permutation covers")
    a, b = sides(n)
    keys = F.array(
        *(
            F.struct(F.lit(i % 2).alias("half"), *(F.lit(v).cast("long").alias(f"k{j}") for j, v in enumerate(k)))
            for i, k in enumerate(round_keys(seed))
        )
    )

    def step(s: Column, k: Column) -> Column:
        y = (F.when(k.half == 0, s.r).otherwise(s.l) * k.k0 + k.k1) % PRIME
        mixed = (y * y % PRIME * y + k.k2) % PRIME
        return F.struct(
            F.when(k.half == 0, (s.l + mixed) % a).otherwise(s.l).alias("l"),
            F.when(k.half == 0, s.r).otherwise((s.r + mixed) % b).alias("r"),
        )

    def image(x: Column) -> Column:
        start = F.struct(((x - x % b) / F.lit(b)).cast("long").alias("l"), (x % b).alias("r"))
        return F.aggregate(keys, start, step, lambda s: s.l * b + s.r)

    first = image(number)
    outside = min(a * b - n, 64)
    if outside == 0:
        return first
    walks = F.sequence(F.lit(1), F.lit(outside))
    walked = F.aggregate(walks, first, lambda x, _: F.when(x < n, x).otherwise(image(x)))
    failed = F.raise_error(F.lit(f"a permutation walk of {outside} steps stayed outside 0..{n - 1}"))
    return F.when(first < n, first).when(walked < n, walked).otherwise(failed.cast("long"))


def assign_shards(df: DataFrame, order: list[str], shards: int, seed: int = 1) -> DataFrame:
    """Adds ``shard`` (int, 0 .. shards-1) and ``slot`` (long, from 0, no gaps) to every row.

    The result depends on the rows, ``order``, ``shards`` and ``seed`` only. Rows equal in all
    ``order`` columns are interchangeable. Nulls sort first; an empty table stays empty. Columns
    of ``df`` named shard or slot are replaced; every other column comes back as it was, whatever
    its name (the caller's columns travel in one struct beside the sort keys). Give narrow rows:
    they are sorted once. A walk that stays outside the range (never seen) stops the job.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    keys = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    rows = settled(df.select(F.struct(*[F.col(c) for c in kept]).alias("payload"), *keys))
    n = rows.count()
    placed = numbered(rows, "row_no", *(F.col(f"o{i}") for i in range(len(order))))
    place = settled(placed.select("payload", permuted(F.col("row_no"), n, seed).alias("row_no")))
    return place.select(
        *[F.col("payload").getField(c).alias(c) for c in kept],
        (F.col("row_no") % shards).cast("int").alias("shard"),
        ((F.col("row_no") - F.col("row_no") % shards) / F.lit(shards)).cast("long").alias("slot"),
    )
