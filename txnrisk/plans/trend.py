"""Daily and weekly series. All windows run over the fact rolled up to days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from txnrisk.functions.dates import key_to_date
from txnrisk.functions.money import money, percent, ratio
from txnrisk.functions.one_row import with_row
from txnrisk.functions.rounding import round_half_up as r
from txnrisk.plans.portfolio import by_day


def daily_trend(fact: DataFrame, window: int = 7) -> DataFrame:
    """Q16. Moving averages over the last ``window`` rows, the rate taken unrounded."""
    days = by_day(fact).withColumn("txn_date", key_to_date(F.col("date_key")))
    recent = W.orderBy("txn_date").rowsBetween(1 - window, 0)
    rate = percent(F.col("fraud_txns"), F.col("txns"))
    mean_loss = money(F.sum("_fraud").over(recent)) / F.count(F.lit(1)).over(recent)
    return days.select(
        "txn_date",
        "txns",
        "fraud_txns",
        r(money(F.col("_fraud")), 2).alias("fraud_value"),
        r(rate, 3).alias("fraud_rate_pct"),
        r(F.avg(rate).over(recent), 3).alias("fraud_rate_7d_ma"),
        r(mean_loss, 2).alias("fraud_value_7d_ma"),
    ).orderBy("txn_date")


def weekly_movement(
    fact: DataFrame, dim_date: DataFrame, split_years: bool = False
) -> DataFrame:
    """Q17. Week over week.

    The published form groups by ISO week number alone; ``split_years`` keeps years apart by the
    ISO year, the year of the week's Thursday.
    """
    iso_year = F.year(F.date_add("date", 4 - F.col("day_of_week")))
    keys = ["iso_year", "week_no"] if split_years else ["week_no"]
    weeks = (
        by_day(fact)
        .join(dim_date.withColumn("iso_year", iso_year), "date_key")
        .groupBy(*keys)
        .agg(
            F.min("date").alias("week_start"),
            F.sum("txns").alias("txns"),
            F.sum("fraud_txns").alias("fraud_txns"),
            F.sum("_fraud").alias("_fraud"),
        )
    )
    before = F.lag("fraud_txns").over(W.orderBy(*keys))
    return weeks.select(
        *keys,
        "week_start",
        "txns",
        "fraud_txns",
        r(money(F.col("_fraud")), 2).alias("fraud_value"),
        before.alias("prev_week_fraud"),
        r(percent(F.col("fraud_txns") - before, before), 2).alias("wow_change_pct"),
    ).orderBy(*keys)


def alert_days(fact: DataFrame, k_sigma: float = 2) -> DataFrame:
    """Q18. Days whose loss exceeds mean + k population standard deviations."""
    days = by_day(fact).select(
        key_to_date(F.col("date_key")).alias("txn_date"), money(F.col("_fraud")).alias("_loss")
    )
    moments = days.agg(
        F.avg("_loss").alias("mu"), F.avg(F.col("_loss") * F.col("_loss")).alias("_square")
    ).select("mu", F.sqrt(F.col("_square") - F.col("mu") * F.col("mu")).alias("sigma"))
    limit = F.col("mu") + F.lit(float(k_sigma)) * F.col("sigma")
    return (
        with_row(days, moments)
        .where(F.col("_loss") > limit)
        .select(
            "txn_date",
            r(F.col("_loss"), 2).alias("fraud_value"),
            r(F.col("mu"), 2).alias("mean_daily_loss"),
            r(limit, 2).alias("alert_threshold"),
            r(ratio(F.col("_loss") - F.col("mu"), F.col("sigma")), 2).alias("z_score"),
        )
        .orderBy(F.desc("fraud_value"), "txn_date")
    )
