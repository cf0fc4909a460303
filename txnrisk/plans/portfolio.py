"""Portfolio questions: size, class profile, typology, bands, hours, weekdays, heat map, one-pager."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from txnrisk import schema as S
from txnrisk.functions import labels
from txnrisk.functions.money import (
    cents_of_double,
    fraud_cents,
    fraud_cents_or_zero,
    frauds,
    money,
    percent,
    ratio,
    txns,
    value_cents,
)
from txnrisk.functions.one_row import with_row
from txnrisk.functions.rounding import round_half_up as r
from txnrisk.functions.windows import whole


def rate_pct(fraud: str = "fraud_txns", count: str = "txns", digits: int = 3):
    return r(percent(F.col(fraud), F.col(count)), digits)


def distinct_of(fact: DataFrame, column: str, name: str) -> DataFrame:
    """One row. Two distinct counts in one aggregate would copy every row for each of them, and the
    optimizer merges such aggregates, so the keys are made distinct first."""
    return fact.select(column).distinct().agg(F.count(column).alias(name))


def totals(fact: DataFrame) -> DataFrame:
    """Q1. One row: size and exposure."""
    base = fact.agg(
        txns().alias("total_txns"),
        value_cents().alias("_value"),
        frauds().alias("fraud_txns"),
        fraud_cents().alias("_fraud"),
    )
    base = with_row(base, distinct_of(fact, "customer_id", "customers"))
    base = with_row(base, distinct_of(fact, "terminal_id", "terminals"))
    exposed = F.coalesce(F.col("_fraud"), F.lit(0))
    return base.select(
        "total_txns",
        "customers",
        "terminals",
        r(money(F.col("_value")), 2).alias("total_value"),
        "fraud_txns",
        rate_pct("fraud_txns", "total_txns").alias("fraud_rate_pct"),
        r(money(F.col("_fraud")), 2).alias("fraud_value"),
        r(percent(exposed, F.col("_value")), 3).alias("value_at_risk_pct"),
    )


def totals_from_dimensions(dim_customer: DataFrame, dim_terminal: DataFrame) -> DataFrame:
    """Q1 without a fact scan: terminals hold every row's count, value and fraud once, customers
    are the rows of their dimension. Volumes are exact cents stored as doubles, so sums are exact."""
    base = dim_terminal.agg(
        F.sum("total_txns").alias("total_txns"),
        F.sum(cents_of_double("total_volume")).alias("_value"),
        F.sum("fraud_txns").alias("fraud_txns"),
        F.sum(cents_of_double(F.coalesce("fraud_volume", F.lit(0.0)))).alias("_all_fraud"),
        F.count(F.lit(1)).alias("terminals"),
    )
    base = with_row(base, dim_customer.agg(F.count("customer_id").alias("customers")))
    fraud = F.when(F.col("fraud_txns") > 0, F.col("_all_fraud"))
    exposed = F.coalesce(fraud, F.lit(0))
    return base.select(
        F.coalesce("total_txns", F.lit(0)).alias("total_txns"),
        "customers",
        "terminals",
        r(money(F.col("_value")), 2).alias("total_value"),
        F.coalesce("fraud_txns", F.lit(0)).alias("fraud_txns"),
        rate_pct("fraud_txns", "total_txns").alias("fraud_rate_pct"),
        r(money(fraud), 2).alias("fraud_value"),
        r(percent(exposed, F.col("_value")), 3).alias("value_at_risk_pct"),
    )


def class_profile(fact: DataFrame) -> DataFrame:
    """Q2. Fraudulent against legitimate."""
    base = fact.groupBy("is_fraud").agg(
        txns().alias("txns"),
        value_cents().alias("_value"),
        F.min("amount").cast("double").alias("_min"),
        F.max("amount").cast("double").alias("_max"),
    )
    return base.select(
        labels.txn_class(F.col("is_fraud")).alias("txn_class"),
        "txns",
        r(percent(F.col("txns"), F.sum("txns").over(whole())), 3).alias("pct_of_txns"),
        r(money(F.col("_value")) / F.col("txns"), 2).alias("avg_amount"),
        r(F.col("_min"), 2).alias("min_amount"),
        r(F.col("_max"), 2).alias("max_amount"),
        r(money(F.col("_value")), 2).alias("total_value"),
        r(percent(F.col("_value"), F.sum("_value").over(whole())), 3).alias("pct_of_value"),
    )


def loss_by_type(fact: DataFrame) -> DataFrame:
    """Q3. Fraud only, one row per typology."""
    bad = fact.where(F.col("is_fraud") == 1)
    sums = bad.groupBy("fraud_type").agg(txns().alias("incidents"), value_cents().alias("_loss"))
    hit = bad.groupBy(F.col("fraud_type").alias("_c")).agg(
        F.count_distinct("customer_id").alias("customers_hit")
    )
    used = bad.groupBy(F.col("fraud_type").alias("_t")).agg(
        F.count_distinct("terminal_id").alias("terminals_involved")
    )
    own = F.col("fraud_type")
    base = sums.join(hit, own.eqNullSafe(F.col("_c"))).join(used, own.eqNullSafe(F.col("_t")))
    return base.select(
        "fraud_type",
        "incidents",
        r(money(F.col("_loss")), 2).alias("loss_value"),
        r(money(F.col("_loss")) / F.col("incidents"), 2).alias("avg_loss"),
        "customers_hit",
        "terminals_involved",
        r(percent(F.col("_loss"), F.sum("_loss").over(whole())), 2).alias("pct_of_total_loss"),
    ).orderBy(F.desc("loss_value"), "fraud_type")


def band_lift(fact: DataFrame) -> DataFrame:
    """Q4. Rate per band and lift over the portfolio, from one scan."""
    base = fact.groupBy("amount_band").agg(
        txns().alias("txns"), frauds().alias("fraud_txns"), fraud_cents_or_zero().alias("_fraud")
    )
    baseline = ratio(F.sum("fraud_txns").over(whole()), F.sum("txns").over(whole()))
    own = F.col("fraud_txns").cast("double") / F.col("txns")
    return base.select(
        "amount_band",
        "txns",
        "fraud_txns",
        rate_pct().alias("fraud_rate_pct"),
        r(money(F.col("_fraud")), 2).alias("fraud_value"),
        r(ratio(own, baseline), 2).alias("risk_lift"),
    ).orderBy("amount_band")


def band_coverage(fact: DataFrame) -> DataFrame:
    """Q5. Loss and volume accumulated from the top band down."""
    base = fact.groupBy("amount_band").agg(
        txns().alias("txns"), fraud_cents_or_zero().alias("_fraud")
    )
    down = W.orderBy(F.desc("amount_band")).rangeBetween(W.unboundedPreceding, 0)
    cum_loss, cum_txns = F.sum("_fraud").over(down), F.sum("txns").over(down)
    return base.select(
        "amount_band",
        "txns",
        r(money(F.col("_fraud")), 2).alias("fraud_value"),
        r(money(cum_loss), 2).alias("cum_fraud_value"),
        r(percent(cum_loss, F.sum("_fraud").over(whole())), 2).alias("cum_pct_of_loss"),
        r(percent(cum_txns, F.sum("txns").over(whole())), 2).alias("cum_pct_of_txns"),
    ).orderBy(F.desc("amount_band"))


def hourly_rate(fact: DataFrame) -> DataFrame:
    """Q6. Rate per hour with a flag against the portfolio rate."""
    base = fact.groupBy("txn_hour").agg(
        txns().alias("txns"), frauds().alias("fraud_txns"), fraud_cents().alias("_fraud")
    )
    own = F.col("fraud_txns").cast("double") / F.col("txns")
    baseline = ratio(F.sum("fraud_txns").over(whole()), F.sum("txns").over(whole()))
    return base.select(
        "txn_hour",
        "txns",
        "fraud_txns",
        rate_pct().alias("fraud_rate_pct"),
        r(ratio(money(F.col("_fraud")), F.col("fraud_txns")), 2).alias("avg_fraud_amount"),
        F.when(own > baseline, F.lit("ABOVE BASELINE")).otherwise(F.lit("normal")).alias("status"),
    ).orderBy(F.desc("fraud_rate_pct"), "txn_hour")


def by_day(fact: DataFrame) -> DataFrame:
    """The fact rolled up to its days: one row per calendar day, whatever the volume."""
    return fact.groupBy("date_key").agg(
        txns().alias("txns"),
        frauds().alias("fraud_txns"),
        fraud_cents_or_zero().alias("_fraud"),
        value_cents().alias("_value"),
    )


def weekday_rate(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Q7. Rolled up to days before the calendar join, so the join sees few rows."""
    base = (
        by_day(fact)
        .join(dim_date, "date_key")
        .groupBy("is_weekend", "day_name", "day_of_week")
        .agg(*[F.sum(c).alias(c) for c in ("txns", "fraud_txns", "_fraud")])
    )
    return base.orderBy("day_of_week").select(
        "is_weekend",
        "day_name",
        "txns",
        "fraud_txns",
        rate_pct().alias("fraud_rate_pct"),
        r(money(F.col("_fraud")), 2).alias("fraud_value"),
    )


def heat_map(fact: DataFrame, min_txns: int | None = 100, limit: int | None = 25) -> DataFrame:
    """Q24. Day part by band, groups above ``min_txns`` rows, highest rate first."""
    base = fact.groupBy("part_of_day", "amount_band").agg(
        txns().alias("txns"), frauds().alias("fraud_txns")
    )
    return heat_cells(base, min_txns, limit)


def heat_cells(base: DataFrame, min_txns: int | None = 100, limit: int | None = 25) -> DataFrame:
    """Q24 from (part_of_day, amount_band, txns, fraud_txns) cells."""
    if min_txns is not None:
        base = base.where(F.col("txns") > min_txns)
    cells = base.withColumn("fraud_rate_pct", rate_pct())
    if limit is None:
        return cells.orderBy("part_of_day", "amount_band")
    return cells.orderBy(F.desc("fraud_rate_pct"), "part_of_day", "amount_band").limit(limit)


def headline(fact: DataFrame, dim_terminal: DataFrame, dim_customer: DataFrame) -> DataFrame:
    """Q25. Nine labelled, formatted values."""
    base = fact.agg(
        txns().alias("n"),
        frauds().alias("bad"),
        value_cents().alias("value"),
        fraud_cents_or_zero().alias("loss"),
    )
    risky = dim_terminal.agg(F.count_if(F.col("risk_tier").isin(*S.RISK_TIERS[:2])).alias("risky"))
    hit = dim_customer.agg(F.count_if(F.col("fraud_txns") > 0).alias("hit"))
    row = with_row(with_row(base, risky), hit)
    n, bad, value, loss = (F.col(c) for c in ("n", "bad", "value", "loss"))
    texts = (
        F.format_string("%,d", n),
        F.format_string("%.2f", money(value)),
        F.format_string("%,d", bad),
        F.format_string("%.3f", percent(bad, n)),
        F.format_string("%.2f", money(loss)),
        F.format_string("%.3f", percent(loss, value)),
        F.format_string("%.2f", ratio(money(loss), bad)),
        F.format_string("%,d", F.col("risky")),
        F.format_string("%,d", F.col("hit")),
    )
    pairs = [x for label, text in zip(S.HEADLINE_METRICS, texts) for x in (F.lit(label), text)]
    return row.select(F.stack(F.lit(len(texts)), *pairs).alias("metric", "value"))
