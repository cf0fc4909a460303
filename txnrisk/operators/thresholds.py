"""Review thresholds: sweep, cost model, optimum, sensitivity, blind spot, live re-costing.

The fact is read once per sweep. Each row falls into the bucket of the highest threshold it
reaches; the few bucket rows are then spread over the thresholds they satisfy.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from txnrisk import schema as S
from txnrisk.functions.money import (
    cents,
    fraud_cents_or_zero,
    frauds,
    money,
    percent,
    ratio_or_zero,
    txns,
)
from txnrisk.functions.one_row import with_row
from txnrisk.functions.rounding import round_half_even, round_half_up

NO_THRESHOLD = -1


@dataclass(frozen=True)
class Costs:
    review: float = S.REVIEW_COST
    decline: float = S.DECLINE_COST
    recovery: float = S.RECOVERY_RATE


def _bucket(thresholds: Sequence[float]) -> Column:
    """Index of the highest threshold reached, -1 below the lowest."""
    if isinstance(thresholds, range):
        span = F.floor((cents() - thresholds.start * 100) / F.lit(thresholds.step * 100))
        top = F.lit(len(thresholds) - 1)
        return F.greatest(F.least(span, top), F.lit(NO_THRESHOLD)).cast("int")
    chain = F.when(F.col("amount") < F.lit(thresholds[0]), F.lit(NO_THRESHOLD))
    for place, upper in enumerate(thresholds[1:]):
        chain = chain.when(F.col("amount") < F.lit(upper), F.lit(place))
    return chain.otherwise(F.lit(len(thresholds) - 1))


SUMS = ("_n", "_bad", "_loss")


def sweep_buckets(rows: DataFrame, thresholds: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Counts and cents per key and bucket, combined before the shuffle."""
    return rows.groupBy(*keys, _bucket(thresholds).alias("_bucket")).agg(
        txns().alias("_n"), frauds().alias("_bad"), fraud_cents_or_zero().alias("_loss")
    )


def sweep_spread(
    buckets: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Per slice and threshold, from bucket rows: sums over the buckets at or above the threshold.

    A slice has at most one cell per threshold and one below them, so its cells fit in one row.
    """
    single = buckets.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(c) for c in SUMS])
    slices = single.groupBy(*by).agg(F.collect_list(F.struct("_bucket", *SUMS)).alias("_cells"))
    if isinstance(thresholds, range):
        steps = F.sequence(F.lit(thresholds.start), F.lit(thresholds[-1]), F.lit(thresholds.step))
    else:
        steps = F.array(*[F.lit(t) for t in thresholds])
    spread = slices.where(F.size("_cells") > 0).select(
        *by, "_cells", F.posexplode(steps).alias("_step", "threshold")
    )

    def added(column: str, reached: bool) -> Column:
        lowest = F.col("_step") if reached else F.lit(NO_THRESHOLD)
        return F.aggregate(
            "_cells",
            F.lit(0).cast("bigint"),
            lambda total, c: total + F.when(c["_bucket"] >= lowest, c[column]).otherwise(F.lit(0)),
        )

    return spread.select(
        *by,
        "threshold",
        added("_n", True).alias("flagged"),
        added("_bad", True).alias("caught"),
        added("_loss", True).alias("caught_cents"),
        added("_n", False).alias("txns"),
        added("_bad", False).alias("frauds"),
        added("_loss", False).alias("fraud_cents"),
    )


def sweep_totals(
    fact: DataFrame, thresholds: Sequence[float] = S.REVIEW_SWEEP, by: Sequence[str] = ()
) -> DataFrame:
    """Per slice and threshold: flagged, caught and totals, in counts and cents."""
    if not isinstance(thresholds, range):
        thresholds = sorted(thresholds)
    return sweep_spread(sweep_buckets(fact, thresholds, by), thresholds, by)


def net_benefit(costs_review: Column, costs_decline: Column, recovery: Column) -> dict[str, Column]:
    """Cost model over ``sweep_totals`` columns."""
    false_alarms = F.col("flagged") - F.col("caught")
    prevented = money(F.col("caught_cents")) * recovery
    operating = F.col("flagged") * costs_review + false_alarms * costs_decline
    missed = money(F.col("fraud_cents") - F.col("caught_cents"))
    return {
        "prevented": prevented,
        "operating": operating,
        "missed": missed,
        "net": prevented - operating - missed,
    }


def threshold_sweep(
    fact: DataFrame,
    thresholds: Sequence[float] = S.REVIEW_SWEEP,
    costs: Costs = Costs(),
    totals: DataFrame | None = None,
) -> DataFrame:
    """X1 with X2. ``loss_prevented`` here is after recovery. ``totals`` are ``sweep_totals`` at hand."""
    base = sweep_totals(fact, thresholds) if totals is None else totals
    model = net_benefit(F.lit(costs.review), F.lit(costs.decline), F.lit(costs.recovery))
    hundred = F.lit(100.0)
    return base.select(
        "threshold",
        F.col("flagged").alias("txns_flagged"),
        F.col("caught").alias("frauds_caught"),
        (F.col("flagged") - F.col("caught")).alias("false_positives"),
        round_half_even(hundred * F.col("caught") / F.col("frauds"), 2).alias("recall_pct"),
        round_half_even(ratio_or_zero(hundred * F.col("caught"), F.col("flagged")), 2).alias(
            "precision_pct"
        ),
        round_half_even(model["prevented"], 2).alias("loss_prevented"),
        round_half_even(model["operating"], 2).alias("operating_cost"),
        round_half_even(model["missed"], 2).alias("residual_loss"),
        round_half_even(model["net"], 2).alias("net_benefit"),
    ).orderBy("threshold")


def optimum(sweep: DataFrame, naive: int = S.NAIVE_THRESHOLD) -> DataFrame:
    """X3. Highest rounded net benefit, lowest threshold on ties, and the gain over ``naive``."""
    row = F.struct(*sweep.columns)
    best = sweep.agg(
        F.max_by(row, F.struct(F.col("net_benefit"), -F.col("threshold"))).alias("best"),
        F.max(F.when(F.col("threshold") == naive, F.col("net_benefit"))).alias("_naive"),
    )
    return best.select(
        F.col("best.threshold").alias("optimal_threshold"),
        *[F.col(f"best.{c}").alias(c) for c in sweep.columns if c != "threshold"],
        round_half_even(F.col("best.net_benefit") - F.col("_naive"), 2).alias(
            "improvement_vs_naive"
        ),
    )


def sensitivity(
    fact: DataFrame,
    thresholds: Sequence[float] = S.REVIEW_SWEEP,
    reviews: Sequence[float] = S.REVIEW_COST_GRID,
    declines: Sequence[float] = S.DECLINE_COST_GRID,
    recovery: float = S.RECOVERY_RATE,
    totals: DataFrame | None = None,
) -> DataFrame:
    """X4. Optimum per cost pair, decided on the unrounded net; one scan for all pairs."""
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("review_cost"), F.lit(b).alias("false_decline_cost"))
            for a in reviews
            for b in declines
        ]
    )
    base = sweep_totals(fact, thresholds) if totals is None else totals
    grid = base.select("*", F.inline(pairs))
    net = net_benefit(F.col("review_cost"), F.col("false_decline_cost"), F.lit(recovery))["net"]
    best = (
        grid.withColumn("net", net)
        .groupBy("review_cost", "false_decline_cost")
        .agg(
            F.max_by(
                F.struct("threshold", "net"), F.struct(F.col("net"), -F.col("threshold"))
            ).alias("best")
        )
    )
    return best.select(
        "review_cost",
        "false_decline_cost",
        F.col("best.threshold").alias("optimal_threshold"),
        round_half_even(F.col("best.net"), 2).alias("net_benefit"),
    ).orderBy("review_cost", "false_decline_cost")


def stability(grid: DataFrame, allowed: int = S.STABLE_RANGE) -> DataFrame:
    """X5. Spread of the optima over the cost grid."""
    low, high = F.min("optimal_threshold"), F.max("optimal_threshold")
    return grid.agg(
        F.count_distinct("optimal_threshold").alias("distinct_optima"),
        low.alias("lowest"),
        high.alias("highest"),
        (high - low <= allowed).alias("stable"),
    )


def sensitivity_pivot(
    grid: DataFrame, declines: Sequence[float] = S.DECLINE_COST_GRID
) -> DataFrame:
    """X6. Review cost down, decline cost across."""
    wide = grid.groupBy("review_cost").pivot("false_decline_cost", list(declines))
    table = wide.agg(F.first("optimal_threshold"))
    names = [f"decline_{d:g}" for d in declines]
    return table.toDF("review_cost", *names).orderBy("review_cost")


def _missed(fact: DataFrame, best: DataFrame) -> DataFrame:
    cut = best.select(F.col("optimal_threshold").alias("threshold"))
    bad = fact.where(F.col("is_fraud") == 1).select("fraud_type", "amount", "amount_vs_cust_avg")
    return with_row(bad, cut)


def blind_spot(fact: DataFrame, best: DataFrame) -> DataFrame:
    """X7. What the amount rule at the optimum does not see."""
    below = F.col("amount") < F.col("threshold")
    return (
        _missed(fact, best)
        .groupBy("threshold")
        .agg(
            F.count_if(below).alias("frauds_missed"),
            percent(F.count_if(below), txns()).alias("pct_of_all_fraud_missed"),
            money(F.coalesce(F.sum(F.when(below, cents())), F.lit(0))).alias("unprevented_loss"),
        )
    )


def blind_spot_by_type(fact: DataFrame, best: DataFrame) -> DataFrame:
    """X7 by typology."""
    hundredths = F.rint(F.col("amount_vs_cust_avg") * 100.0).cast("bigint")
    mean_ratio = money(F.sum(hundredths)) / F.nullif(
        F.count("amount_vs_cust_avg"), F.lit(0).cast("bigint")
    )
    return (
        _missed(fact, best)
        .where(F.col("amount") < F.col("threshold"))
        .groupBy("fraud_type")
        .agg(
            txns().alias("incidents"),
            money(F.sum(cents())).alias("loss"),
            round_half_even(mean_ratio, 2).alias("avg_ratio_to_baseline"),
        )
        .orderBy(F.desc("loss"), "fraud_type")
    )


def recost(
    sweep: DataFrame,
    total_frauds: DataFrame,
    costs: Costs = Costs(),
    stored_recovery: float = S.RECOVERY_RATE,
) -> DataFrame:
    """X8. Stored sweep under other costs; the stored, rounded prevention is scaled back first.

    ``total_frauds`` is the one-row fraud count, since the sweep stores only what was caught.
    """
    prevented = F.col("loss_prevented") / F.lit(stored_recovery) * F.lit(costs.recovery)
    operating = F.col("txns_flagged") * F.lit(costs.review) + F.col("false_positives") * F.lit(
        costs.decline
    )
    all_frauds = F.col("_all_frauds")
    return with_row(sweep, total_frauds.toDF("_all_frauds")).select(
        *sweep.columns,
        (all_frauds - F.col("frauds_caught")).alias("frauds_missed"),
        operating.alias("op_cost_live"),
        prevented.alias("prevented_live"),
        (prevented - operating - F.col("residual_loss")).alias("net_live"),
    )


def chosen_setting(live: DataFrame, chosen: float, tolerance: float = 10) -> DataFrame:
    """X8. The row nearest to the chosen threshold, the live optimum, and the verdict."""
    distance = F.abs(F.col("threshold") - F.lit(chosen))
    picked = live.agg(
        F.min_by(F.struct(*live.columns), F.struct(distance, F.col("threshold"))).alias("now"),
        F.max_by(
            F.struct("threshold", "net_live"), F.struct(F.col("net_live"), -F.col("threshold"))
        ).alias("best"),
    )
    gap = F.lit(chosen) - F.col("best.threshold")
    verdict = (
        F.when(F.abs(gap) <= tolerance, F.lit("matches"))
        .when(gap < 0, F.lit("sits below"))
        .otherwise(F.lit("sits above"))
    )
    return picked.select(
        *[F.col(f"now.{c}").alias(c) for c in live.columns],
        F.col("best.threshold").alias("optimum"),
        F.col("best.net_live").alias("optimum_net"),
        verdict.alias("verdict"),
    )


def review_simulation(
    fact: DataFrame, cutoffs: Sequence[float] = S.REVIEW_CUTOFFS
) -> DataFrame:
    """Q19. Review everything at or above each cut-off; prevention before recovery."""
    base = sweep_totals(fact, cutoffs)
    return base.select(
        F.col("threshold").alias("review_above"),
        F.col("flagged").alias("txns_for_review"),
        round_half_up(percent(F.col("flagged"), F.col("txns")), 2).alias("pct_txns_reviewed"),
        F.col("caught").alias("frauds_caught"),
        (F.col("frauds") - F.col("caught")).alias("frauds_missed"),
        round_half_up(percent(F.col("caught"), F.col("frauds")), 2).alias("recall_pct"),
        round_half_up(percent(F.col("caught"), F.col("flagged")), 2).alias("precision_pct"),
        round_half_up(money(F.col("caught_cents")), 2).alias("loss_prevented"),
        (F.col("flagged") - F.col("caught")).alias("good_customers_stopped"),
    ).orderBy("review_above")
