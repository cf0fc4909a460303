"""Report extracts and pre-aggregated slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from txnrisk import schema as S
from txnrisk.functions import labels
from txnrisk.functions.dates import key_to_date
from txnrisk.functions.money import (
    cents,
    cents_of_double,
    fraud_cents_or_zero,
    frauds,
    money,
    percent,
    ratio,
    txns,
    value_cents,
)
from txnrisk.functions.one_row import with_row
from txnrisk.functions.rounding import round_half_even, round_half_up as r
from txnrisk.functions.windows import whole
from txnrisk.operators import measures as M
from txnrisk.operators.ordered import prefix_sums
from txnrisk.plans import portfolio
from txnrisk.plans.portfolio import rate_pct
from txnrisk.plans.star import Star, enriched

HASH_DIGITS = 5


def kpi_source(fact: DataFrame) -> DataFrame:
    """R1."""
    base = fact.agg(
        txns().alias("txns"),
        value_cents().alias("_value"),
        frauds().alias("frauds"),
        fraud_cents_or_zero().alias("_loss"),
    )
    for column, name in (("customer_id", "customers"), ("terminal_id", "terminals")):
        base = with_row(base, portfolio.distinct_of(fact, column, name))
    return base.select(
        "txns",
        "customers",
        "terminals",
        money(F.col("_value")).alias("value"),
        "frauds",
        money(F.col("_loss")).alias("fraud_value"),
        percent(F.col("frauds"), F.col("txns")).alias("fraud_rate_pct"),
        percent(F.col("_loss"), F.col("_value")).alias("value_at_risk_pct"),
    )


def fine_rollup(fact: DataFrame, width: int = 10, top: int = 600, by: Sequence[str] | None = None) -> DataFrame:
    """One roll-up of the fact that R2, R4, R5, R10 and R11 all read: rows and cents per day, hour,
    day part, band, class and histogram bin (left-closed, ``width`` wide, null from ``top`` up).

    It has at most days x 24 x (bands + bins) x 2 rows, whatever the number of transactions, so the
    report reads the fact once for these five slices. ``by`` narrows it to what one slice needs.
    """
    start = F.when(F.col("amount") < top, (F.floor(cents() / F.lit(width * 100)) * width).cast("int"))
    every = ["date_key", "txn_hour", "part_of_day", "amount_band"]
    keys = [F.col(k) for k in (every if by is None else [k for k in by if k != "bin"])] + [F.col("is_fraud")]
    if by is None or "bin" in by:
        keys.append(start.alias("bin"))
    return fact.groupBy(*keys).agg(
        txns().alias("txns"), value_cents().alias("_value"), fraud_cents_or_zero().alias("_loss")
    )


def _rolled_sums(cube: DataFrame, *by: str) -> DataFrame:
    return cube.groupBy(*by).agg(
        F.sum("txns").alias("txns"),
        F.sum(F.col("is_fraud").cast("bigint") * F.col("txns")).alias("fraud_txns"),
        F.sum("_loss").alias("_loss"),
        F.sum("_value").alias("_value"),
    )


def band_slice(fact: DataFrame, cube: DataFrame | None = None) -> DataFrame:
    """R2."""
    base = _rolled_sums(fine_rollup(fact, by=["amount_band"]) if cube is None else cube, "amount_band")
    return base.select(
        "amount_band",
        "txns",
        "fraud_txns",
        rate_pct().alias("fraud_rate_pct"),
        r(money(F.col("_loss")), 2).alias("fraud_value"),
        r(money(F.col("_value")), 2).alias("total_value"),
    ).orderBy("amount_band")


def type_slice(fact: DataFrame) -> DataFrame:
    """R3."""
    return portfolio.loss_by_type(fact).select(
        "fraud_type",
        "incidents",
        "loss_value",
        "avg_loss",
        "customers_hit",
        F.col("terminals_involved").alias("terminals"),
    )


def daily_slice(fact: DataFrame, window: int = 7, cube: DataFrame | None = None) -> DataFrame:
    """R4. The moving average is taken over the already rounded daily rate."""
    rolled = _rolled_sums(fine_rollup(fact, by=["date_key"]) if cube is None else cube, "date_key")
    days = rolled.withColumnRenamed("_loss", "_fraud").select(
        key_to_date(F.col("date_key")).alias("txn_date"),
        "txns",
        "fraud_txns",
        rate_pct().alias("fraud_rate_pct"),
        r(money(F.col("_fraud")), 2).alias("fraud_value"),
        r(money(F.col("_value")), 2).alias("total_value"),
    )
    recent = W.orderBy("txn_date").rowsBetween(1 - window, 0)
    thousandths = F.rint(F.col("fraud_rate_pct") * 1000.0).cast("bigint")
    mean = F.sum(thousandths).over(recent) / F.lit(1000.0) / F.count(F.lit(1)).over(recent)
    return days.withColumn("fraud_rate_7d_ma", round_half_even(mean, 3)).orderBy("txn_date")


def hour_slice(fact: DataFrame, cube: DataFrame | None = None) -> DataFrame:
    """R5."""
    base = _rolled_sums(fine_rollup(fact, by=["txn_hour"]) if cube is None else cube, "txn_hour")
    return base.select(
        "txn_hour",
        labels.part_of_day(F.col("txn_hour")).alias("part_of_day"),
        "txns",
        "fraud_txns",
        rate_pct().alias("fraud_rate_pct"),
    ).orderBy("txn_hour")


# fixed values: columns of the watchlist, in published order
WATCHLIST = (
    "terminal_id",
    "total_txns",
    "fraud_txns",
    "fraud_rate_pct",
    "fraud_volume",
    "unique_customers",
    "risk_tier",
)


def watchlist(dim_terminal: DataFrame, limit: int = 250) -> DataFrame:
    """R6. A top-k report: worst terminals by loss."""
    return (
        dim_terminal.where(F.col("fraud_txns") > 0)
        .withColumn("fraud_volume", r(F.col("fraud_volume"), 2))
        .select(*WATCHLIST)
        .orderBy(F.desc("fraud_volume"), "terminal_id")
        .limit(limit)
    )


def segment_slice(dim_customer: DataFrame) -> DataFrame:
    """R7."""
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
    ).orderBy("value_segment")


def threshold_view(sweep: DataFrame, low: int = 100, high: int = 400) -> DataFrame:
    """R8."""
    return sweep.where(F.col("threshold").between(low, high))


def stratified_extract(star: Star, limit: int = 40_000, seed: int = S.SEED) -> DataFrame:
    """R9. All fraud and exactly ``limit`` legitimate rows of the enriched view, in time order.

    Legitimate rows are drawn by the smallest seeded hash, so a draw can be repeated. A histogram
    over the leading hash digits (a fixed number of cells) finds where the draw ends, so the final
    ordering handles little more than ``limit`` rows instead of ``limit`` rows from every task.
    The dimensions are joined to the drawn rows only.
    """
    drawn = F.md5(F.concat(F.lit(f"{seed}-"), F.col("transaction_id").cast("string")))
    legit = star.fact.where(F.col("is_fraud") == 0).withColumn("_hash", drawn)
    cell = F.substring("_hash", 1, HASH_DIGITS)
    upto = W.orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)  # at most 16**HASH_DIGITS cells
    cells = legit.groupBy(cell.alias("_cell")).agg(txns().alias("_n"))
    end = cells.withColumn("_cum", F.sum("_n").over(upto)).agg(
        F.coalesce(F.min(F.when(F.col("_cum") >= limit, F.col("_cell"))), F.max("_cell"))
    )
    chosen = (
        legit.where(cell <= end.scalar())
        .orderBy("_hash", "transaction_id")
        .limit(limit)
        .select(star.fact.columns)
    )
    rows = star.fact.where(F.col("is_fraud") == 1).unionByName(chosen)
    return enriched(star, rows).orderBy("txn_datetime", "transaction_id")


def heat_slice(fact: DataFrame, cube: DataFrame | None = None) -> DataFrame:
    """R10, long form."""
    day_parts = ["part_of_day", "amount_band"]
    base = _rolled_sums(fine_rollup(fact, by=day_parts) if cube is None else cube, *day_parts)
    return portfolio.heat_cells(base.select("part_of_day", "amount_band", "txns", "fraud_txns"), None, None)


def heat_pivot(fact: DataFrame, bands: Sequence[str] = S.BAND_LABELS) -> DataFrame:
    """R10, day parts down and bands across."""
    wide = heat_slice(fact).groupBy("part_of_day").pivot("amount_band", list(bands))
    names = [f"band_{b[:2]}" for b in bands]
    return wide.agg(F.first("fraud_rate_pct")).toDF("part_of_day", *names).orderBy("part_of_day")


def amount_histogram(fact: DataFrame, width: int = 10, top: int = 600, cube: DataFrame | None = None) -> DataFrame:
    """R11. Left-closed bins below ``top``, with the share inside each class."""
    rolled = fine_rollup(fact, width, top, by=["bin"]) if cube is None else cube
    counts = rolled.where(F.col("bin").isNotNull()).groupBy("is_fraud", "bin").agg(F.sum("txns").alias("n"))
    whole = F.sum("n").over(W.partitionBy("is_fraud"))  # at most top/width rows per class
    return counts.withColumn("pct_of_class", percent(F.col("n"), whole)).orderBy("bin", "is_fraud")


def pareto_curve(dim_terminal: DataFrame) -> DataFrame:
    """R12. Worst terminals first: share of terminals against share of loss, every terminal kept."""
    loss = cents_of_double("fraud_volume")
    one = F.lit(1).cast("bigint")
    placed = prefix_sums(
        dim_terminal.select("terminal_id", "fraud_volume"),
        ["-fraud_volume", "terminal_id"],
        {"_place": one, "_above": loss},
        totals=True,
    )
    return placed.select(
        "terminal_id",
        percent(F.col("_place") + 1, F.col("_place_total")).alias("pct_terminals"),
        percent(F.col("_above") + loss, F.col("_above_total")).alias("cum_pct"),
    )


def pareto_readings(curve: DataFrame, at: Sequence[int] = (5, 10)) -> DataFrame:
    """R12. Share of loss reached at given shares of terminals."""
    return curve.agg(
        *[F.max(F.when(F.col("pct_terminals") <= p, F.col("cum_pct"))).alias(f"at_{p}") for p in at]
    )


def portfolio_header(daily: DataFrame) -> DataFrame:
    """R13. Totals re-derived from the daily slice, with its date range."""
    value, loss = F.sum(cents_of_double("total_value")), F.sum(cents_of_double("fraud_value"))
    sums = daily.agg(
        F.sum("txns").alias("total_txns"),
        F.sum("fraud_txns").alias("total_fraud"),
        value.alias("_value"),
        loss.alias("_loss"),
        F.min("txn_date").alias("first_day"),
        F.max("txn_date").alias("last_day"),
    )
    return sums.select(
        "total_txns",
        "total_fraud",
        money(F.col("_value")).alias("total_value"),
        money(F.col("_loss")).alias("fraud_value"),
        percent(F.col("total_fraud"), F.col("total_txns")).alias("fraud_rate_pct"),
        percent(F.col("_loss"), F.col("_value")).alias("value_at_risk_pct"),
        "first_day",
        "last_day",
    )


def headline_shares(types: DataFrame, class_means: DataFrame) -> DataFrame:
    """R14. Share of loss and of incidents per typology, the top one marked, with the mean ratio."""
    loss = cents_of_double("loss_value")
    top = F.row_number().over(W.orderBy(F.desc("loss_value"), "fraud_type")) == 1  # a few rows
    return with_row(types, class_means.select("ratio_of_means")).select(
        "fraud_type",
        round_half_even(percent(loss, F.sum(loss).over(whole())), 1).alias("share_of_loss_pct"),
        percent(F.col("incidents"), F.sum("incidents").over(whole())).alias("share_of_incidents_pct"),
        top.alias("is_top"),
        "ratio_of_means",
    )


# fixed values: levels of the three-way rate flag
RATE_FLAGS = ("above twice portfolio", "above portfolio", "at or below portfolio")


def band_levels(bands: DataFrame, header: DataFrame, lowest: int = 3) -> DataFrame:
    """R15. Lift and flag per band, with the share of the lowest bands."""
    base = F.col("_rate")
    own = F.col("fraud_rate_pct")
    place = F.row_number().over(W.orderBy("amount_band"))  # at most seven rows
    low = bands.withColumn("_place", place)
    lows = F.col("_place") <= lowest
    low_txns = F.sum(F.when(lows, F.col("txns"))).over(whole())
    flag = (
        F.when(own > base * 2, F.lit(RATE_FLAGS[0]))
        .when(own > base, F.lit(RATE_FLAGS[1]))
        .otherwise(F.lit(RATE_FLAGS[2]))
    )
    one = header.select(F.col("fraud_rate_pct").alias("_rate"))
    return with_row(low, one).select(
        "amount_band",
        own.alias("fraud_rate_pct"),
        round_half_even(ratio(own, base), 1).alias("lift"),
        flag.alias("flag"),
        percent(low_txns, F.sum("txns").over(whole())).alias("lowest_bands_pct_of_txns"),
        F.sum(F.when(lows, F.col("fraud_txns"))).over(whole()).alias("lowest_bands_fraud_txns"),
    )


def watchlist_view(listed: DataFrame, tiers: Sequence[str] = (), limit: int = 60) -> DataFrame:
    """R16. Chosen tiers of the watchlist; an empty choice means all."""
    kept = listed.where(F.col("risk_tier").isin(*tiers)) if tiers else listed
    return kept.orderBy(F.desc("fraud_volume"), "terminal_id").limit(limit)


def segment_matrix(star: Star) -> DataFrame:
    """R17."""
    names = ["customers_affected", "customer_impact_rate_pct", "fraud_rate_pct", "risk_lift"]
    return M.evaluate(star, names, by=["value_segment"])


def executive_view(star: Star, filters: M.Filters) -> DataFrame:
    """R18. Six headline measures under date, segment and tier filters."""
    names = [
        "total_transactions",
        "total_value",
        "fraud_transactions",
        "fraud_rate_pct",
        "fraud_loss",
        "value_at_risk_pct",
    ]
    return M.evaluate(star, names, filters=filters)


def terminal_table(star: Star) -> DataFrame:
    """R19. Per-terminal measures with the tier."""
    names = [
        "total_transactions",
        "fraud_transactions",
        "fraud_rate_pct",
        "fraud_loss",
        "risk_lift_label",
    ]
    rows = M.evaluate(star, names, by=["terminal_id"])
    return rows.join(star.terminal.select("terminal_id", "risk_tier"), "terminal_id")


def terminal_pareto_top(star: Star, limit: int = 100) -> DataFrame:
    """R19. The share is computed over the whole selection before the top is taken."""
    return (
        M.terminal_pareto(star)
        .select("terminal_id", "fraud_loss", "cumulative_loss_pct")
        .orderBy(F.desc("fraud_loss"), "terminal_id")
        .limit(limit)
    )
