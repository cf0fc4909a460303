"""Money as whole cents while it is summed, as double where it is shown.

A ``bigint`` sum is exact in any order and stays in codegen; on 40 million rows it took about
half the time of the ``decimal(22,2)`` sum Spark plans for ``decimal(12,2)``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def cents(amount: Column | str = "amount") -> Column:
    """Exact cents of a ``decimal(_, 2)`` column."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return (amount * F.lit(100)).cast("bigint")


def cents_of_double(value: Column | str) -> Column:
    """Exact hundredths of a double that already holds two decimals."""
    value = F.col(value) if isinstance(value, str) else value
    return F.rint(value * F.lit(100.0)).cast("bigint")


def money(cent_count: Column) -> Column:
    """Cents back to a double amount."""
    return cent_count.cast("double") / F.lit(100.0)


def if_fraud(value: Column) -> Column:
    return F.when(F.col("is_fraud") == 1, value)


def txns() -> Column:
    return F.count(F.lit(1))


def frauds() -> Column:
    return F.sum(F.col("is_fraud").cast("bigint"))


def value_cents() -> Column:
    return F.sum(cents())


def fraud_cents() -> Column:
    """Null when the group holds no fraud."""
    return F.sum(if_fraud(cents()))


def fraud_cents_or_zero() -> Column:
    return F.sum(F.when(F.col("is_fraud") == 1, cents()).otherwise(F.lit(0).cast("bigint")))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that gives null on a zero denominator."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` with the multiplication first, null on a zero whole."""
    return ratio(F.lit(100.0) * part.cast("double"), whole)
