"""All test results as one nested row, ready for the JSON sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from txnrisk.functions.one_row import with_row
from txnrisk.operators import significance as A, thresholds as X
from txnrisk.sources.workspace import settled


ROWS = "_rows"


def _nested(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.struct(*df.columns).alias(name))


def _listed(df: DataFrame, name: str, first: str) -> DataFrame:
    """A few rows as one sorted array."""
    ordered = F.struct(first, *[c for c in df.columns if c != first])
    return df.agg(F.sort_array(F.collect_list(ordered)).alias(name))


def _label_cube(fact: DataFrame) -> DataFrame:
    """Counts per label pair and class, as weighted rows: one scan serves every test on labels."""
    return fact.groupBy("part_of_day", "amount_band", "is_fraud").agg(F.count(F.lit(1)).alias(ROWS))


def statistical_results(fact: DataFrame) -> DataFrame:
    """One row: each test a struct. Every part is already down to a handful of rows.

    The fact is read three times for the tests (labels, amounts, thresholds), and for its frauds once
    more for each blind-spot table.
    """
    costs = X.Costs()
    totals = settled(X.sweep_totals(fact))  # one row per threshold
    placed = A.placed_values(fact)
    best = settled(X.optimum(X.threshold_sweep(fact, costs=costs, totals=totals)))  # one row
    grid = settled(X.sensitivity(fact, totals=totals))  # nine rows
    labels = settled(_label_cube(fact))
    timing = settled(A.chi_square(labels, "part_of_day", weight=ROWS))
    periods = A.rate_by(labels, "part_of_day", ROWS).where(F.col("part_of_day").isNotNull())
    rates = periods.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("part_of_day", "fraud_rate_pct")))).alias(
            "fraud_rate_by_period"
        )
    )
    strength = A.association_strength(labels, weight=ROWS).where("dimension = 'amount_band'")
    assumed = F.struct(
        F.lit(costs.review).alias("cost_per_review"),
        F.lit(costs.decline).alias("cost_false_decline"),
        F.lit(costs.recovery).alias("recovery_rate"),
    )
    stable = X.stability(grid)
    parts = [
        _nested(
            with_row(A.class_summary(fact, placed=placed), A.mann_whitney(fact, placed=placed)),
            "test1_amount",
        ),
        _nested(with_row(timing, rates), "test2_timing"),
        _nested(
            with_row(
                A.chi_square(labels, "amount_band", weight=ROWS),
                strength.select(F.col("strength_vs_first").alias("strength_vs_timing")),
            ),
            "test3_amount_band",
        ),
        _nested(A.wilson_interval(labels, weight=ROWS), "test4_fraud_rate_ci"),
        _nested(best.withColumn("assumptions", assumed), "test5_threshold"),
        _nested(
            with_row(
                stable.withColumn("threshold_range", F.array("lowest", "highest")),
                _listed(grid, "scenarios", "review_cost"),
            ),
            "test6_sensitivity",
        ),
        _nested(
            with_row(
                X.blind_spot(fact, best),
                _listed(X.blind_spot_by_type(fact, best), "by_type", "fraud_type"),
            ),
            "test7_blind_spot",
        ),
    ]
    return reduce(with_row, parts)
