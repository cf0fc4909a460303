"""Terminal questions: worklist, concentration, tiers, attack windows, detection latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from txnrisk import schema as S
from txnrisk.functions import dates
from txnrisk.functions.money import (

    cents_of_double,
    if_fraud,
    money,
    percent,
    txns,
    value_cents,
)
from txnrisk.functions.one_row import with_row
from txnrisk.functions.rounding import round_half_up as r
from txnrisk.functions.windows import whole



def worklist(dim_terminal: DataFrame, limit: int = 20) -> DataFrame:
    """Q8. Top terminals by loss with their rank.

    Every terminal that outranks a listed one is itself listed, so ranking after the limit gives
    the same numbers as ranking everything.
    """
    top = (
        dim_terminal.where(F.col("fraud_txns") > 0)
        .orderBy(F.desc("fraud_volume"), "terminal_id")
        .limit(limit)
    )
    rank = F.rank().over(W.orderBy(F.desc("fraud_volume")))  # at most ``limit`` rows
    return top.select(
        "terminal_id",
        "total_txns",
        "fraud_txns",
        "fraud_rate_pct",
        r(F.col("fraud_volume"), 2).alias("fraud_volume"),
        "unique_customers",
        "risk_tier",
        rank.alias("loss_rank"),
    ).orderBy("loss_rank", "terminal_id")


def concentration(
    dim_terminal: DataFrame, ranks: Sequence[int] = S.PARETO_RANKS
) -> DataFrame:
    """Q9. Cumulative loss at chosen ranks.

    Only the ``max(ranks)`` worst terminals are ordered; totals come from an aggregate. The running
    sum is taken before the ranks are picked.
    """
    totals = dim_terminal.agg(
        txns().alias("_terminals"), F.sum(cents_of_double("fraud_volume")).alias("_loss")
    )
    worst = (
        dim_terminal.where(F.col("fraud_volume") > 0)
        .select("terminal_id", "fraud_volume")
        .orderBy(F.desc("fraud_volume"), "terminal_id")
        .limit(max(ranks))
    )
    order = W.orderBy(F.desc("fraud_volume"), "terminal_id")
    running = order.rowsBetween(W.unboundedPreceding, 0)
    placed = worst.select(
        F.row_number().over(order).alias("rn"),
        F.sum(cents_of_double("fraud_volume")).over(running).alias("_cum"),
    )
    return (
        with_row(placed.where(F.col("rn").isin(*ranks)), totals)
        .select(
            F.col("rn").alias("terminals_reviewed"),
            r(percent(F.col("rn"), F.col("_terminals")), 2).alias("pct_of_all_terminals"),
            r(money(F.col("_cum")), 2).alias("cum_fraud_recovered"),
            r(percent(F.col("_cum"), F.col("_loss")), 2).alias("cum_pct_of_loss"),
        )
        .orderBy("terminals_reviewed")
    )


def tier_queues(dim_terminal: DataFrame) -> DataFrame:
    """Q10. Queue size and loss share per risk tier."""
    base = dim_terminal.groupBy("risk_tier").agg(
        txns().alias("terminals"),
        F.sum("total_txns").alias("txns_covered"),
        F.sum("fraud_txns").alias("fraud_txns"),
        F.sum(cents_of_double("fraud_volume")).alias("_loss"),
    )
    return base.select(
        "risk_tier",
        "terminals",
        "txns_covered",
        "fraud_txns",
        r(money(F.col("_loss")), 2).alias("fraud_volume"),
        r(percent(F.col("_loss"), F.sum("_loss").over(whole())), 2).alias("pct_of_loss"),
    ).orderBy("risk_tier")


def attack_windows(fact: DataFrame, scenario: int = 2, limit: int = 15) -> DataFrame:
    """Q11. First and last day of one scenario per terminal, calendar days inclusive."""
    day = dates.day(F.col("txn_datetime"))
    base = (
        fact.where(F.col("fraud_scenario") == scenario)
        .groupBy("terminal_id")
        .agg(
            F.min(day).alias("first_fraud_day"),
            F.max(day).alias("last_fraud_day"),
            txns().alias("fraud_txns"),
            r(money(value_cents()), 2).alias("fraud_value"),
        )
        .orderBy(F.desc("fraud_value"), "terminal_id")
        .limit(limit)
    )
    days = F.datediff("last_fraud_day", "first_fraud_day") + 1
    return base.select(
        "terminal_id",
        "first_fraud_day",
        "last_fraud_day",
        days.alias("attack_window_days"),
        "fraud_txns",
        "fraud_value",
        r(F.col("fraud_value") / days, 2).alias("loss_per_day"),
    )


def detection_latency(fact: DataFrame, dim_terminal: DataFrame, limit: int = 15) -> DataFrame:
    """Q23. Rows seen on a terminal before its first fraud, worst terminals first.

    A terminal qualifies when its first row precedes its first fraud, which two minima per
    terminal decide. Only the ``limit`` terminals that will be shown are then looked up in the
    fact, so nothing but narrow aggregates is shuffled.
    """
    firsts = fact.groupBy("terminal_id").agg(
        F.min("txn_datetime").alias("_first_seen"),
        F.min(if_fraud(F.col("txn_datetime"))).alias("first_fraud_at"),
    )
    shown = (
        firsts.where(F.col("_first_seen") < F.col("first_fraud_at"))
        .join(dim_terminal.select("terminal_id", "fraud_txns", "fraud_volume"), "terminal_id")
        .orderBy(F.desc("fraud_volume"), "terminal_id")
        .limit(limit)
    )
    earlier = fact.select("terminal_id", "txn_datetime", "amount").join(
        F.broadcast(shown), "terminal_id"  # ``limit`` rows
    )
    return (
        earlier.where(F.col("txn_datetime") < F.col("first_fraud_at"))
        .groupBy("terminal_id", "first_fraud_at", "fraud_txns", "fraud_volume")
        .agg(txns().alias("clean_txns_before_first_fraud"), value_cents().alias("_clean"))
        .select(
            "terminal_id",
            "first_fraud_at",
            "clean_txns_before_first_fraud",
            r(money(F.col("_clean")), 2).alias("clean_value_before"),
            F.col("fraud_txns").alias("total_frauds_on_terminal"),
            r(F.col("fraud_volume"), 2).alias("total_fraud_loss"),
        )
        .orderBy(F.desc("total_fraud_loss"), "terminal_id")
    )
