"""Significance tests and intervals as distributed aggregates.

Rank statistics work on the counted distinct values: rows are collapsed map-side first, and the
ordering of those values is sliced, so nothing depends on how often one value occurs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from txnrisk import schema as S
from txnrisk.functions.money import cents, money, ratio, txns
from txnrisk.functions.one_row import with_row
from txnrisk.functions.rounding import round_half_even
from txnrisk.functions.windows import whole
from txnrisk.functions.tails import chi_square_p, two_sided_normal_p
from txnrisk.operators.ordered import prefix_sums, values_at

WIDE = "decimal(38,0)"
HASH_DIGITS = 13  # 52 bits, exact in a double
CELL_DIGITS = 4


def placed_values(
    fact: DataFrame, value: str = "amount", flag: str = "is_fraud"
) -> DataFrame:
    """Distinct values with counts per class and how many rows of each class lie below."""
    bad = F.col(flag).cast("bigint")
    counted = fact.groupBy(value).agg(F.count(F.lit(1)).alias("_n"), F.sum(bad).alias("_bad"))
    counted = counted.withColumn("_good", F.col("_n") - F.col("_bad"))
    return prefix_sums(
        counted,
        [value],
        {"_bad_below": F.col("_bad"), "_good_below": F.col("_good")},
        totals=True,
    )


def _median_places(total: str, name: str) -> dict[str, Column]:
    last = F.col(total) - 1
    return {f"_lo_{name}": F.floor(last / 2), f"_hi_{name}": F.ceil(last / 2)}


def class_summary(
    fact: DataFrame,
    value: str = "amount",
    flag: str = "is_fraud",
    placed: DataFrame | None = None,
) -> DataFrame:
    """A1. Exact medians, means and the ratio of means. ``placed`` are ``placed_values`` at hand."""
    placed = placed_values(fact, value, flag) if placed is None else placed
    number = F.col(value).cast("double")
    placed = placed.withColumn("_value", number)
    bad = values_at(
        placed, "_bad_below", "_bad", "_value", _median_places("_bad_below_total", "bad")
    )
    good = values_at(
        placed, "_good_below", "_good", "_value", _median_places("_good_below_total", "good")
    )
    weighted = cents(value)
    sums = placed.agg(
        *bad,
        *good,
        F.sum(weighted * F.col("_bad")).alias("_bad_sum"),
        F.sum(weighted * F.col("_good")).alias("_good_sum"),
        F.max("_bad_below_total").alias("_bad_n"),
        F.max("_good_below_total").alias("_good_n"),
    )
    mean_bad = ratio(money(F.col("_bad_sum")), F.col("_bad_n"))
    mean_good = ratio(money(F.col("_good_sum")), F.col("_good_n"))
    return sums.select(
        ((F.col("_lo_bad") + F.col("_hi_bad")) / 2).alias("median_fraud"),
        ((F.col("_lo_good") + F.col("_hi_good")) / 2).alias("median_legit"),
        mean_bad.alias("mean_fraud"),
        mean_good.alias("mean_legit"),
        ratio(mean_bad, mean_good).alias("ratio_of_means"),
    )


def skew_by_class(fact: DataFrame, value: str = "amount", flag: str = "is_fraud") -> DataFrame:
    """A2. Population skewness per class."""
    return fact.groupBy(flag).agg(F.skewness(F.col(value).cast("double")).alias("skew"))


def normality(
    fact: DataFrame,
    value: str = "amount",
    flag: str = "is_fraud",
    draws: int | None = S.NORMALITY_DRAWS,
    seed: int = S.SEED,
) -> DataFrame:
    """A3. D'Agostino-Pearson K2 of legitimate amounts.

    With ``draws`` the moments come from exactly that many seeded draws with replacement (none if
    there is no legitimate row), without it from every row. The p-value is the chi-square tail for
    two degrees of freedom.
    """
    legit = fact.where(F.col(flag) == 0)
    number = F.col(value).cast("double").alias("_x")
    chosen = legit.select(number) if draws is None else _drawn(legit, number, draws, seed)
    moments = chosen.agg(
        F.count("_x").cast("double").alias("n"),
        F.skewness("_x").alias("skew"),
        (F.kurtosis("_x") + 3.0).alias("kurt"),
    )
    scored = moments.select("n", _skew_score().alias("zs"), _kurtosis_score().alias("zk"))
    k2 = F.col("zs") * F.col("zs") + F.col("zk") * F.col("zk")
    return scored.select(
        F.col("n").cast("bigint").alias("n"),
        k2.alias("k2"),
        F.exp(-k2 / 2.0).alias("p_value"),
    )


def _drawn(rows: DataFrame, value: Column, draws: int, seed: int) -> DataFrame:
    """The value ``_x`` at ``draws`` seeded places, repeats allowed, of the rows in hashed order.

    A histogram over the leading hash digits (a fixed number of cells) tells which cells hold a
    drawn place; only their rows, at most one cell per draw, are ordered. Draws and order depend on
    keys and seed alone, so they are the same for any file layout and any retry.
    """
    key = F.concat(F.lit(f"{seed}-"), F.col("transaction_id").cast("string"))
    hashed = rows.select("transaction_id", value, F.md5(key).alias("_hash"))
    cell = F.substring("_hash", 1, CELL_DIGITS)
    upto = W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)  # at most 16**CELL_DIGITS rows
    counts = hashed.groupBy(cell.alias("_cell")).agg(txns().alias("_in"))
    cells = counts.withColumn("_first", F.coalesce(F.sum("_in").over(upto), F.lit(0)))
    total = counts.agg(F.coalesce(F.sum("_in"), F.lit(0)).alias("_all"))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, HASH_DIGITS)
    share = F.conv(digits, 16, 10).cast("double") / F.lit(float(16**HASH_DIGITS))
    spark = rows.sparkSession
    places = with_row(spark.range(draws), total).where("_all > 0").select(
        F.floor(share * F.col("_all")).alias("_place")
    )
    # each place beside the cell it falls into: the last cell that starts at or before it
    marks = cells.select(F.col("_first").alias("_place"), F.lit(0).alias("_kind"), "_cell", "_first")
    asked = places.select("_place", F.lit(1), F.lit(None).cast("string"), F.lit(None).cast("bigint"))
    seen = W.orderBy("_place", "_kind").rowsBetween(W.unboundedPreceding, 0)
    held = marks.union(asked).select(
        "_place",
        "_kind",
        F.last("_cell", ignorenulls=True).over(seen).alias("_cell"),
        F.last("_first", ignorenulls=True).over(seen).alias("_first"),
    ).where("_kind = 1")
    wanted = held.select("_cell", "_first").distinct()
    inside = F.row_number().over(W.partitionBy("_cell").orderBy("_hash", "transaction_id"))
    ordered = (
        hashed.withColumn("_cell", cell)
        .join(F.broadcast(wanted), "_cell")  # at most one row per draw
        .select("_x", (F.col("_first") + inside - 1).alias("_place"))
    )
    return ordered.join(held.select("_place"), "_place").select("_x")


def _skew_score() -> Column:
    """Normal score of the sample skewness (D'Agostino 1970)."""
    n, b = F.col("n"), F.col("skew")
    y = b * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    top = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)
    beta = top / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2.0 * (beta - 1)) - 1.0
    scaled = y * F.sqrt((w2 - 1.0) / 2.0)
    return F.asinh(scaled) / F.sqrt(0.5 * F.log(w2))


def _kurtosis_score() -> Column:
    """Normal score of the sample kurtosis (Anscombe and Glynn 1983)."""
    n, b = F.col("n"), F.col("kurt")
    mean = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b - mean) / F.sqrt(var)
    third = (
        6.0
        * (n * n - 5 * n + 2)
        / ((n + 7) * (n + 9))
        * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    )
    a = 6.0 + 8.0 / third * (2.0 / third + F.sqrt(1.0 + 4.0 / (third * third)))
    below = 1.0 + x * F.sqrt(2.0 / (a - 4.0))
    root = F.signum(below) * F.cbrt((1.0 - 2.0 / a) / F.abs(below))
    return (1.0 - 2.0 / (9.0 * a) - root) / F.sqrt(2.0 / (9.0 * a))


def mann_whitney(
    fact: DataFrame,
    value: str = "amount",
    flag: str = "is_fraud",
    with_p: bool = True,
    placed: DataFrame | None = None,
) -> DataFrame:
    """A4 and A5. U of the flagged class with mid-ranks, rank-biserial effect, normal p-value.

    Twice the rank sum is added as whole numbers, so U is exact. With an empty class the effect and
    the p-value are null.
    """
    placed = placed_values(fact, value, flag) if placed is None else placed
    below = (F.col("_bad_below") + F.col("_good_below")).cast(WIDE)
    twice_rank = below * 2 + F.col("_n") + 1
    t = F.col("_n").cast("double")
    sums = placed.agg(
        F.sum((F.col("_bad").cast("decimal(18,0)") * twice_rank.cast("decimal(20,0)"))).alias("_r2"),
        F.sum(t * t * t - t).alias("_ties"),
        F.max("_bad_below_total").alias("_n1"),
        F.max("_good_below_total").alias("_n2"),
    )
    n1, n2 = F.col("_n1").cast("double"), F.col("_n2").cast("double")
    n = n1 + n2
    u = (F.col("_r2") - F.col("_n1").cast("decimal(18,0)") * (F.col("_n1") + 1)).cast("double") / 2.0
    effect = F.abs(1.0 - ratio(2.0 * u, n1 * n2))
    scored = sums.select(
        u.alias("u_statistic"),
        effect.alias("effect_size_rank_biserial"),
        ratio(
            F.greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5,
            F.sqrt(n1 * n2 / 12.0 * (n + 1.0 - ratio(F.col("_ties"), n * (n - 1.0)))),
        ).alias("_z"),
    )
    if not with_p:
        return scored.drop("_z")
    p = two_sided_normal_p(F.col("_z"))
    return scored.select(
        "u_statistic", "effect_size_rank_biserial", p.alias("p_value")
    ).withColumn("significant_at_5pct", F.col("p_value") < 0.05)


def _rows_and_hits(flag: str, weight: str | None) -> tuple[Column, Column]:
    """Number of rows and of flagged rows; each row stands for ``weight`` rows if that is named."""
    hit = F.col(flag).cast("bigint")
    if weight is None:
        return txns(), F.sum(hit)
    return F.sum(weight), F.sum(hit * F.col(weight))


def chi_square(
    fact: DataFrame,
    dimension: str,
    flag: str = "is_fraud",
    with_p: bool = True,
    weight: str | None = None,
) -> DataFrame:
    """A6 and A7. Independence of a label and the flag, from one grouped count.

    Continuity correction applies to 2x2 tables only. The smallest expected cell comes along with
    a validity mark, since the approximation needs more than five everywhere.
    """
    rows = fact.where(F.col(dimension).isNotNull())
    n, hits = _rows_and_hits(flag, weight)
    table = rows.groupBy(dimension).agg(n.alias("_n"), hits.alias("_bad"))
    cells = table.select(
        F.col("_n"),
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("_flag"), F.col("_bad").alias("_seen")),
                F.struct(F.lit(0).alias("_flag"), (F.col("_n") - F.col("_bad")).alias("_seen")),
            )
        ),
    )
    column_total = F.sum("_seen").over(W.partitionBy("_flag"))
    grand = F.sum("_seen").over(whole())
    cells = cells.select(
        "_seen",
        grand.alias("_grand"),
        (F.col("_n").cast("double") * column_total / grand).alias("_expected"),
        (column_total > 0).cast("int").alias("_used"),
        F.col("_flag"),
        F.count(F.lit(1)).over(W.partitionBy("_flag")).alias("_levels"),
    ).where(F.col("_used") == 1)
    gap = F.abs(F.col("_seen") - F.col("_expected"))
    shift = F.when(F.col("_levels") == 2, F.least(gap, F.lit(0.5))).otherwise(F.lit(0.0))
    sums = cells.agg(
        F.sum((gap - shift) * (gap - shift) / F.col("_expected")).alias("chi2"),
        F.min("_expected").alias("min_expected"),
        F.max("_levels").alias("_r"),
        F.count_distinct("_flag").alias("_c"),
        F.max("_grand").alias("_grand"),
    )
    smaller = F.least(F.col("_r"), F.col("_c")) - 1
    v = F.sqrt(ratio(F.col("chi2"), F.col("_grand") * smaller))
    out = sums.select(
        F.lit(dimension).alias("dimension"),
        "chi2",
        ((F.col("_r") - 1) * (F.col("_c") - 1)).cast("int").alias("dof"),
        v.alias("cramers_v"),
        "min_expected",
        (F.col("min_expected") > 5).alias("valid"),
        F.when(v < 0.1, F.lit("weak")).otherwise(F.lit("material")).alias("practical_significance"),
        F.when(v > 0.3, F.lit("STRONG"))
        .when(v > 0.1, F.lit("moderate"))
        .otherwise(F.lit("weak"))
        .alias("strength"),
    )
    if not with_p:
        return out
    tested = out.withColumn("p_value", chi_square_p(F.col("chi2"), F.col("dof")))
    return tested.withColumn("significant_at_5pct", F.col("p_value") < 0.05)


def association_strength(
    fact: DataFrame,
    dimensions: Sequence[str] = ("part_of_day", "amount_band"),
    weight: str | None = None,
) -> DataFrame:
    """A7. Cramer's V per dimension and its ratio to the first one."""
    every = reduce(
        DataFrame.unionByName,
        [chi_square(fact, d, with_p=False, weight=weight) for d in dimensions],
    )
    # one row per dimension
    base = F.max(F.when(F.col("dimension") == dimensions[0], F.col("cramers_v"))).over(whole())
    return every.select(
        "dimension",
        "chi2",
        "cramers_v",
        "strength",
        "practical_significance",
        ratio(F.col("cramers_v"), base).alias("strength_vs_first"),
    )


def rate_by(
    fact: DataFrame, dimension: str = "part_of_day", weight: str | None = None
) -> DataFrame:
    """A8. Fraud rate per label, 3 decimals."""
    n, hits = _rows_and_hits("is_fraud", weight)
    base = fact.groupBy(dimension).agg(n.alias("_n"), hits.alias("_bad"))
    rate = F.col("_bad").cast("double") / F.col("_n") * F.lit(100.0)
    return base.select(dimension, round_half_even(rate, 3).alias("fraud_rate_pct")).orderBy(
        dimension
    )


def wilson_interval(
    fact: DataFrame, by: Sequence[str] = (), z: float = S.WILSON_Z, weight: str | None = None
) -> DataFrame:
    """A9. Wilson score interval of the fraud rate, overall or per group."""
    rows, hits = _rows_and_hits("is_fraud", weight)
    base = fact.groupBy(*by).agg(rows.alias("n"), hits.alias("successes"))
    n = F.col("n").cast("double")
    p = F.col("successes").cast("double") / n
    zz = F.lit(z * z)
    shrink = 1.0 + zz / n
    centre = (p + zz / (2.0 * n)) / shrink
    half = F.lit(z) * F.sqrt(p * (1.0 - p) / n + zz / (4.0 * n * n)) / shrink
    return base.select(
        *by,
        (p * 100.0).alias("point_estimate_pct"),
        ((centre - half) * 100.0).alias("ci_lower_pct"),
        ((centre + half) * 100.0).alias("ci_upper_pct"),
        "n",
        "successes",
    )
