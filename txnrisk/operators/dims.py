"""Dimensions derived from the fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from txnrisk import schema as S
from txnrisk.functions import dates, labels
from txnrisk.functions.money import cents, fraud_cents, frauds, money, txns, value_cents
from txnrisk.functions.one_row import with_row
from txnrisk.functions.rounding import round_half_even
from txnrisk.operators.ordered import quantiles
from txnrisk.sources.workspace import settled

QUARTILES = {"q1": 0.25, "q2": 0.5, "q3": 0.75}


def build_dim_date(fact: DataFrame) -> DataFrame:
    """Observed dates only."""
    seen = fact.select("date_key").distinct().withColumn("date", dates.key_to_date(F.col("date_key")))
    weekday = F.weekday("date") + 1
    return seen.select(
        "date_key",
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month_no"),
        F.date_format("date", "MMM yyyy").alias("month_name"),
        F.weekofyear("date").alias("week_no"),
        F.date_format("date", "EEEE").alias("day_name"),
        weekday.alias("day_of_week"),
        F.when(weekday >= 6, F.lit("Weekend")).otherwise(F.lit("Weekday")).alias("is_weekend"),
    )


def customer_totals(fact: DataFrame) -> DataFrame:
    sums = fact.groupBy("customer_id").agg(
        txns().alias("total_txns"),
        value_cents().alias("_cents"),
        F.max(cents()).alias("_max"),
        F.min("txn_datetime").alias("first_seen"),
        F.max("txn_datetime").alias("last_seen"),
        frauds().alias("fraud_txns"),
    )
    spend = money(F.col("_cents"))
    # whole 24-hour periods between first and last sighting, not calendar days
    elapsed = dates.micros(F.col("last_seen")) - dates.micros(F.col("first_seen"))
    active = F.floor(elapsed / F.lit(86_400_000_000)) + 1
    rate = F.col("fraud_txns") / F.col("total_txns") * F.lit(100.0)
    return sums.select(
        "customer_id",
        "total_txns",
        spend.alias("total_spend"),
        round_half_even(spend / F.col("total_txns"), 2).alias("avg_txn_amount"),
        money(F.col("_max")).alias("max_txn_amount"),
        "first_seen",
        "last_seen",
        "fraud_txns",
        round_half_even(rate, 3).alias("fraud_rate_pct"),
        active.alias("active_days"),
        round_half_even(F.col("total_txns") / active, 2).alias("txns_per_day"),
    )


def spend_segments(customers: DataFrame, approximate: bool = False) -> DataFrame:
    """Quartile segment of total spend; right-closed, lowest value included.

    ``approximate`` swaps the exact edges for ``percentile_approx`` (one aggregation, no sort).
    """
    if approximate:
        edges = customers.agg(
            *[F.percentile_approx("total_spend", q, 10000).alias(n) for n, q in QUARTILES.items()]
        )
    else:
        edges = quantiles(customers, "total_spend", QUARTILES)
    ends = customers.agg(F.min("total_spend").alias("q0"), F.max("total_spend").alias("q4"))
    cut = with_row(edges, ends)
    spend = F.col("total_spend")
    repeated = (
        (F.col("q0") >= F.col("q1"))
        | (F.col("q1") >= F.col("q2"))
        | (F.col("q2") >= F.col("q3"))
        | (F.col("q3") >= F.col("q4"))
    )
    low, mid, high, top = S.SEGMENTS
    segment = (
        F.when(repeated, F.raise_error(F.lit("spend quartile edges are not distinct")))
        .when(spend <= F.col("q1"), F.lit(low))
        .when(spend <= F.col("q2"), F.lit(mid))
        .when(spend <= F.col("q3"), F.lit(high))
        .otherwise(F.lit(top))
    )
    return with_row(customers, cut).select(
        *customers.columns, segment.alias("value_segment")
    )


def build_dim_customer(fact: DataFrame, approximate: bool = False) -> DataFrame:
    totals = settled(customer_totals(fact))  # used for the edges and for the rows
    hit = F.when(F.col("fraud_txns") > 0, F.lit("Yes")).otherwise(F.lit("No"))
    return (
        spend_segments(totals, approximate)
        .withColumn("ever_compromised", hit)
        .select(S.DIM_CUSTOMER.fieldNames())
    )


def build_dim_terminal(fact: DataFrame) -> DataFrame:
    """The distinct customer count first groups by (terminal, customer), which spreads hot terminals."""
    sums = fact.groupBy("terminal_id").agg(
        txns().alias("total_txns"),
        value_cents().alias("_cents"),
        F.count_distinct("customer_id").alias("unique_customers"),
        frauds().alias("fraud_txns"),
        F.coalesce(fraud_cents(), F.lit(0)).alias("_fraud_cents"),
    )
    rate = round_half_even(F.col("fraud_txns") / F.col("total_txns") * F.lit(100.0), 3)
    return sums.select(
        "terminal_id",
        "total_txns",
        money(F.col("_cents")).alias("total_volume"),
        round_half_even(money(F.col("_cents")) / F.col("total_txns"), 2).alias("avg_txn_amount"),
        "unique_customers",
        "fraud_txns",
        money(F.col("_fraud_cents")).alias("fraud_volume"),
        rate.alias("fraud_rate_pct"),
        labels.risk_tier(rate).alias("risk_tier"),
    )


def build_dim_amount_band(fact: DataFrame) -> DataFrame:
    sums = fact.groupBy("amount_band").agg(
        txns().alias("txns"), frauds().alias("fraud_txns"), value_cents().alias("_cents")
    )
    every_band = W.partitionBy()  # at most eight rows
    share = F.col("txns") / F.sum("txns").over(every_band) * F.lit(100.0)
    return sums.select(
        "amount_band",
        "txns",
        "fraud_txns",
        money(F.col("_cents")).alias("total_value"),
        round_half_even(F.col("fraud_txns") / F.col("txns") * F.lit(100.0), 3).alias("fraud_rate_pct"),
        round_half_even(share, 2).alias("pct_of_all_txns"),
    )
