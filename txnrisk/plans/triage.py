"""Rule questions: layered rules and what an amount rule misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from txnrisk.functions import labels
from txnrisk.functions.money import (
    cents_of_double,
    fraud_cents_or_zero,
    frauds,
    money,
    percent,
    txns,
    value_cents,
)
from txnrisk.functions.rounding import round_half_up as r

# fixed values: published rule limits
RULE_LIMITS = {"amount": 220, "multiple": 4, "minutes": 60, "rapid_amount": 100}
AMOUNT_RULE = 220


def layered_rules(fact: DataFrame, limits: dict = RULE_LIMITS) -> DataFrame:
    """Q20. First matching rule per transaction."""
    rule = labels.first_rule(
        F.col("amount"), F.col("amount_vs_cust_avg"), F.col("mins_since_prev_txn"), limits
    )
    base = fact.groupBy(rule.alias("rule_hit")).agg(
        txns().alias("txns_flagged"),
        frauds().alias("frauds_caught"),
        fraud_cents_or_zero().alias("_loss"),
    )
    all_frauds = F.sum("frauds_caught").over(W.partitionBy())  # four rows
    return base.select(
        "rule_hit",
        "txns_flagged",
        "frauds_caught",
        r(percent(F.col("frauds_caught"), F.col("txns_flagged")), 2).alias("precision_pct"),
        r(money(F.col("_loss")), 2).alias("loss_prevented"),
        r(percent(F.col("frauds_caught"), all_frauds), 2).alias("pct_of_all_fraud"),
    ).orderBy(F.desc("frauds_caught"), "rule_hit")


def missed_by_amount(fact: DataFrame, cutoff: float = AMOUNT_RULE) -> DataFrame:
    """Q21. Fraud below the amount rule, by typology."""
    base = (
        fact.where((F.col("is_fraud") == 1) & (F.col("amount") < cutoff))
        .groupBy("fraud_type")
        .agg(
            txns().alias("frauds_missed"),
            value_cents().alias("_loss"),
            F.sum(cents_of_double("amount_vs_cust_avg")).alias("_ratio"),
            F.count("amount_vs_cust_avg").alias("_known"),
        )
    )
    return base.select(
        "fraud_type",
        "frauds_missed",
        r(money(F.col("_loss")), 2).alias("loss_not_prevented"),
        r(money(F.col("_loss")) / F.col("frauds_missed"), 2).alias("avg_missed_amount"),
        r(money(F.col("_ratio")) / F.nullif(F.col("_known"), F.lit(0).cast("bigint")), 2).alias(
            "avg_ratio_to_baseline"
        ),
    ).orderBy(F.desc("loss_not_prevented"), "fraud_type")
