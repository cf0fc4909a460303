"""Customer questions: segments, baseline ratios, repeat victims, velocity, triage list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from txnrisk import schema as S
from txnrisk.functions import labels
from txnrisk.functions.money import cents_of_double, frauds, money, percent, txns
from txnrisk.functions.one_row import with_row
from txnrisk.functions.rounding import round_half_up as r
from txnrisk.operators.ordered import ntile, position
from txnrisk.plans.portfolio import rate_pct


def segment_risk(dim_customer: DataFrame) -> DataFrame:
    """Q12. ``customer_id`` is the key of its table, so counting rows counts customers."""
    base = dim_customer.groupBy("value_segment").agg(
        txns().alias("customers"),
        F.sum("total_txns").alias("txns"),
        F.sum(cents_of_double("total_spend")).alias("_spend"),
        F.sum("fraud_txns").alias("fraud_txns"),
        F.count_if(F.col("ever_compromised") == "Yes").alias("customers_hit"),
    )
    return base.select(
        "value_segment",
        "customers",
        "txns",
        r(money(F.col("_spend")), 2).alias("spend"),
        "fraud_txns",
        rate_pct().alias("fraud_rate_pct"),
        "customers_hit",
        r(percent(F.col("customers_hit"), F.col("customers")), 2).alias("pct_customers_hit"),
    ).orderBy("value_segment")


def baseline_ratio(fact: DataFrame, multiple: float = 3) -> DataFrame:
    """Q13. Ratio to the customer's own earlier mean, by class."""
    base = (
        fact.where(F.col("amount_vs_cust_avg").isNotNull())
        .groupBy("is_fraud")
        .agg(
            txns().alias("txns"),
            F.sum(cents_of_double("amount_vs_cust_avg")).alias("_ratio"),
            F.max("amount_vs_cust_avg").alias("_max"),
            F.count_if(F.col("amount_vs_cust_avg") > multiple).alias("over_3x_baseline"),
        )
    )
    return base.select(
        labels.txn_class(F.col("is_fraud")).alias("txn_class"),
        "txns",
        r(money(F.col("_ratio")) / F.col("txns"), 2).alias("avg_ratio_to_own_baseline"),
        r(F.col("_max"), 2).alias("max_ratio"),
        "over_3x_baseline",
        r(percent(F.col("over_3x_baseline"), F.col("txns")), 2).alias("pct_over_3x"),
    )


def repeat_victims(dim_customer: DataFrame) -> DataFrame:
    """Q14. Customers by how often they were defrauded."""
    victims = dim_customer.where(F.col("fraud_txns") > 0)
    base = victims.groupBy("fraud_txns").agg(
        txns().alias("customers"), F.sum(cents_of_double("total_spend")).alias("_spend")
    )
    everyone = victims.agg(txns().alias("_victims"))
    return (
        with_row(base, everyone)
        .select(
            F.col("fraud_txns").alias("times_defrauded"),
            "customers",
            r(money(F.col("_spend")) / F.col("customers"), 2).alias("avg_lifetime_spend"),
            r(percent(F.col("customers"), F.col("_victims")), 2).alias("pct_of_victims"),
        )
        .orderBy(F.desc("times_defrauded"))
    )


def velocity(fact: DataFrame) -> DataFrame:
    """Q15. Rate by time since the customer's previous transaction."""
    base = (
        fact.where(F.col("mins_since_prev_txn").isNotNull())
        .groupBy(labels.gap_bucket(F.col("mins_since_prev_txn")).alias("gap_since_prev_txn"))
        .agg(txns().alias("txns"), frauds().alias("fraud_txns"))
    )
    return base.withColumn("fraud_rate_pct", rate_pct()).orderBy("gap_since_prev_txn")


def triage_list(dim_customer: DataFrame, limit: int = 25) -> DataFrame:
    """Q22. Two quintiles over all victims, added up, highest first.

    The quintiles come from sliced global positions, not from a window over every customer.
    """
    victims = dim_customer.where(F.col("fraud_txns") > 0).select(
        "customer_id",
        "value_segment",
        "total_txns",
        "total_spend",
        "fraud_txns",
        "fraud_rate_pct",
    )
    placed = position(victims, ["total_spend", "customer_id"], "_by_spend", total="_n")
    placed = position(placed, ["fraud_rate_pct", "customer_id"], "_by_rate")
    score = ntile(F.col("_by_spend"), F.col("_n"), 5) + ntile(F.col("_by_rate"), F.col("_n"), 5)
    urgent, soon, watch = S.TRIAGE_LABELS
    action = F.when(score >= 9, F.lit(urgent)).when(score >= 7, F.lit(soon)).otherwise(F.lit(watch))
    return (
        placed.select(
            "customer_id",
            "value_segment",
            "total_txns",
            r(F.col("total_spend"), 2).alias("total_spend"),
            "fraud_txns",
            "fraud_rate_pct",
            score.alias("priority_score"),
            action.alias("action"),
        )
        .orderBy(F.desc("priority_score"), F.desc("total_spend"), "customer_id")
        .limit(limit)
    )
