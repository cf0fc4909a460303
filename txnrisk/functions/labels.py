"""Label columns built from the fixed cut-offs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from txnrisk import schema as S


def _first_below(value: Column, steps, last: str) -> Column:
    """Label of the first step whose bound lies above ``value``; ``last`` beyond all of them."""
    chain = reduce(
        lambda acc, step: acc.when(value < F.lit(step[0]), F.lit(step[1])),
        steps[1:],
        F.when(value < F.lit(steps[0][0]), F.lit(steps[0][1])),
    )
    return chain.otherwise(F.lit(last))


def part_of_day(hour: Column) -> Column:
    return F.when(hour.isNotNull(), _first_below(hour, S.DAY_PARTS[:-1], S.DAY_PARTS[-1][1]))


def amount_band(amount: Column) -> Column:
    """Right-closed bands; null for null and for amounts that are not positive."""
    chain = F.when(amount <= 0, F.lit(None).cast("string"))
    for upper, label in zip(S.BAND_UPPER, S.BAND_LABELS):
        chain = chain.when(amount <= F.lit(upper), F.lit(label))
    return chain.when(amount > F.lit(S.BAND_UPPER[-1]), F.lit(S.BAND_LABELS[-1]))


def fraud_type(scenario: Column) -> Column:
    pairs = [F.lit(x) for pair in S.FRAUD_TYPES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), scenario)


def risk_tier(rate_pct: Column) -> Column:
    critical, high = S.RISK_TIER_FLOORS
    return (
        F.when(rate_pct >= critical, F.lit(S.RISK_TIERS[0]))
        .when(rate_pct >= high, F.lit(S.RISK_TIERS[1]))
        .when(rate_pct > 0, F.lit(S.RISK_TIERS[2]))
        .otherwise(F.lit(S.RISK_TIERS[3]))
    )


def gap_bucket(minutes: Column) -> Column:
    return _first_below(minutes, S.GAP_BUCKETS, S.GAP_LONGEST)


def txn_class(is_fraud: Column) -> Column:
    return F.when(is_fraud == 1, F.lit(S.CLASS_LABELS[1])).otherwise(F.lit(S.CLASS_LABELS[0]))


def first_rule(amount: Column, multiple: Column, minutes: Column, limits: dict) -> Column:
    """Layered review rules, first match wins; a null test falls through."""
    high, own, rapid, none = S.RULE_LABELS
    return (
        F.when(amount >= F.lit(limits["amount"]), F.lit(high))
        .when(multiple >= F.lit(limits["multiple"]), F.lit(own))
        .when(
            (minutes < F.lit(limits["minutes"])) & (amount >= F.lit(limits["rapid_amount"])),
            F.lit(rapid),
        )
        .otherwise(F.lit(none))
    )
