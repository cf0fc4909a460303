import pytest
from pyspark.sql import functions as F

from txnrisk import schema as S
from txnrisk.operators import measures as M
from txnrisk.plans.star import Star


def small_star(spark, rows, terminals=None):
    """(day, customer, terminal, amount, is_fraud); dimensions from what occurs."""
    made = [(i, int(d.replace("-", "")), c, t, a, f) for i, (d, c, t, a, f) in enumerate(rows)]
    fact = spark.createDataFrame(
        made, "transaction_id long, date_key int, customer_id long, terminal_id long, a string, is_fraud int"
    ).withColumn("amount", F.col("a").cast("decimal(12,2)"))
    from txnrisk.operators.dims import build_dim_date

    ids = sorted({r[2] for r in rows})
    tiers = terminals or {t: S.RISK_TIERS[t % 4] for t in ids}
    terminal = spark.createDataFrame(sorted(tiers.items()), "terminal_id long, risk_tier string")
    customers = sorted({r[1] for r in rows})
    customer = spark.createDataFrame(
        [(c, S.SEGMENTS[c % 4], "No") for c in customers], "customer_id long, value_segment string, ever_compromised string"
    )
    return Star(fact, build_dim_date(fact), customer, terminal, None)


ROWS = [
    ("2024-01-30", 1, 1, "10.00", 1),
    ("2024-01-31", 2, 1, "30.00", 0),
    ("2024-02-28", 1, 2, "20.00", 1),
    ("2024-02-29", 3, 2, "40.00", 1),
    ("2024-03-05", 3, 3, "50.00", 0),
]


@pytest.fixture(scope="module")
def tiny(spark):
    return small_star(spark, ROWS)


def test_every_simple_measure(tiny):
    names = list(M._simple()) + list(M._distinct())
    got = M.evaluate(tiny, names).first().asDict()
    assert got == {
        "total_transactions": 5, "total_value": 150.0, "fraud_transactions": 3, "legit_transactions": 2,
        "fraud_loss": 70.0, "fraud_rate_pct": 60.0, "value_at_risk_pct": pytest.approx(70 / 150 * 100),
        "avg_loss_per_incident": pytest.approx(70 / 3), "avg_transaction_value": 30.0,
        "terminals_affected": 2, "customers_affected": 2, "customer_impact_rate_pct": pytest.approx(200 / 3),
    }


def test_an_empty_selection_gives_zero_rates(tiny):
    got = M.evaluate(tiny, ["total_transactions", "fraud_rate_pct", "fraud_loss"], filters={"risk_tier": ["none"]}).first()
    assert tuple(got) == (0, 0.0, 0.0)


def test_filters_reach_every_dimension(tiny):
    filters = {"date": ("2024-02-01", "2024-03-31"), "value_segment": [S.SEGMENTS[3]], "risk_tier": [S.RISK_TIERS[2], S.RISK_TIERS[3]]}
    got = M.evaluate(tiny, ["total_transactions", "fraud_loss"], filters=filters).first()
    assert tuple(got) == (2, 40.0)


def test_a_date_range_prunes_partitions(spark, star, tmp_path):
    from txnrisk.sources import files

    files.write_fact(star.fact, str(tmp_path / "fact"))
    stored = Star(files.read_fact(spark, str(tmp_path / "fact")), star.date, star.customer, star.terminal, star.band)
    plan = M.context(stored, filters={"date": ("2024-03-01", "2024-03-01")})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date_key" in plan and "20240301" in plan


@pytest.mark.parametrize("by", [["value_segment"], ["risk_tier"], ["month_name"], ["value_segment", "risk_tier"], ["amount_band", "value_segment"], ["month_name", "value_segment", "risk_tier"], ["day_name", "risk_tier", "amount_band"]])
def test_rolling_up_before_the_join_changes_nothing(star, by):
    names = ["total_transactions", "total_value", "fraud_transactions", "fraud_loss"]
    got = sorted(map(tuple, M.evaluate(star, names, by=by).collect()))
    direct = M.context(star, by).groupBy(*by).agg(
        F.count("*"), F.sum("amount").cast("double"), F.sum("is_fraud"),
        F.sum(F.when(F.col("is_fraud") == 1, F.col("amount")).otherwise(0)).cast("double"),
    )
    assert got == sorted(map(tuple, direct.collect()))


def test_baseline_keeps_only_dates(tiny):
    filters = {"date": ("2024-02-01", "2024-03-31"), "risk_tier": [S.RISK_TIERS[3]]}
    kept = M.evaluate(tiny, ["fraud_rate_pct", "portfolio_fraud_rate_pct", "risk_lift"], filters=filters).first()
    assert kept[0] == 0.0 and kept[1] == pytest.approx(200 / 3) and kept[2] == 0.0
    dropped = M.evaluate(tiny, ["portfolio_fraud_rate_pct"], filters=filters, keep_date_filter=False).first()
    assert dropped[0] == 60.0


@pytest.mark.parametrize(
    "lift, text",
    [(None, "-"), (5.0, "Critical (5.0x)"), (4.99, "High (5.0x)"), (2.0, "High (2.0x)"), (1.2, "Elevated (1.2x)"), (1.19, "Normal (1.2x)"), (0.0, "Normal (0.0x)")],
)
def test_lift_labels(spark, lift, text):
    assert spark.range(1).select(M.lift_label(F.lit(lift).cast("double"))).first()[0] == text


def test_previous_month(tiny):
    got = {(r["year"], r["month_no"]): r for r in M.previous_month_loss(tiny).collect()}
    assert got[(2024, 1)]["fraud_loss_pm"] is None
    # 28 February reaches back to 28 January; 29 February ends its month and reaches 29 to 31 January
    assert got[(2024, 2)]["fraud_loss_pm"] == 10.0
    assert got[(2024, 3)]["fraud_loss_pm"] is None
    moved = small_star(tiny.fact.sparkSession, ROWS + [("2024-01-29", 1, 1, "8.00", 1), ("2024-02-05", 1, 1, "5.00", 1)])
    got = {r["month_no"]: r for r in M.previous_month_loss(moved).collect()}
    assert (got[2]["fraud_loss_pm"], got[3]["fraud_loss_pm"]) == (18.0, 5.0)
    assert got[2]["fraud_loss_mom_pct"] == pytest.approx((65 - 18) / 18 * 100)
    by_tier = M.previous_month_loss(moved, by=["year", "month_no", "risk_tier"]).collect()
    assert {(r["month_no"], r["risk_tier"]): r["fraud_loss_pm"] for r in by_tier}[(2, S.RISK_TIERS[1])] == 18.0


@pytest.mark.parametrize("month, days, before", [("2023-02", 28, 31), ("2024-03", 31, 29), ("2024-06", 30, 31), ("2023-03", 31, 28)])
def test_a_complete_month_stands_beside_the_complete_previous_one(spark, month, days, before):
    year, number = map(int, month.split("-"))
    rows = [(f"{year}-{number - 1:02}-{d:02}", 1, 1, "1.00", 1) for d in range(1, before + 1)]
    rows += [(f"{month}-{d:02}", 1, 1, "2.00", 1) for d in range(1, days + 1)]
    got = {r["month_no"]: r for r in M.previous_month_loss(small_star(spark, rows)).collect()}
    assert (got[number]["fraud_loss"], got[number]["fraud_loss_pm"]) == (2.0 * days, 1.0 * before)


def test_rolling_rate_counts_calendar_days(spark):
    star = small_star(
        spark,
        [("2024-01-01", 1, 1, "1.00", 1), ("2024-01-03", 1, 2, "1.00", 0), ("2024-01-08", 1, 1, "1.00", 1), ("2024-01-08", 1, 1, "1.00", 0)],
    )
    got = {str(r[0]): r[1] for r in M.rolling_rate(star).collect()}
    assert got == {"2024-01-01": 100.0, "2024-01-03": 50.0, "2024-01-08": 25.0}
    # the terminal has no rows on the 3rd: that day counts zero; the period reaches before the filter
    one = M.rolling_rate(star, {"terminal_id": [1], "date": ("2024-01-03", "2024-01-08")}).collect()
    assert {str(r[0]): r[1] for r in one} == {"2024-01-03": 50.0, "2024-01-08": 25.0}


def test_running_loss_starts_at_the_selection(tiny):
    got = M.running_loss(tiny, {"date": ("2024-02-01", "2024-12-31")}).orderBy("date").collect()
    assert [r[1] for r in got] == [20.0, 60.0, 60.0]


def test_high_risk_terminals(tiny):
    assert M.high_risk_terminals(tiny).first()[0] == 1


def test_pareto_includes_peers_and_terminals_without_loss(spark):
    rows = [("2024-01-01", 1, t, a, f) for t, a, f in [(1, "5.00", 1), (2, "5.00", 1), (3, "9.00", 1), (4, "7.00", 0)]]
    star = small_star(spark, rows, {t: S.RISK_TIERS[0] for t in (1, 2, 3, 4, 5)})
    got = {r["terminal_id"]: tuple(r)[1:] for r in M.terminal_pareto(star).collect()}
    assert got[3] == (9.0, 1, 9.0, pytest.approx(900 / 19))
    assert got[1] == got[2] == (5.0, 2, 19.0, 100.0)
    assert got[4] == got[5] == (0.0, 3, 19.0, 100.0)


def test_threshold_measures_are_before_recovery(tiny):
    got = M.threshold_measures(tiny, (25,)).first()
    assert (got["txns_flagged"], got["frauds_caught"], got["frauds_missed"], got["false_positives"]) == (3, 1, 2, 2)
    assert (got["loss_prevented"], got["residual_loss"], got["operating_cost"]) == (40.0, 30.0, 33.0)
    assert got["net_benefit"] == 40 * 0.75 - 33 - 30
    nothing = M.threshold_measures(tiny, (500,)).first()
    assert (nothing["precision_pct"], nothing["recall_pct"]) == (0.0, 0.0)


def test_selected_threshold(spark):
    options = M.threshold_options(spark)
    assert options.count() == 59
    assert M.selected_threshold(options).first()[0] == 200
    assert M.selected_threshold(options.where("threshold = 350")).first()[0] == 350


def test_approximate_distinct_is_offered(tiny):
    assert M.evaluate(tiny, ["terminals_affected"], approximate=True).first()[0] == 2


def test_no_fact_row_meets_a_join_with_three_dimensions(spark, star):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        names = ["total_transactions", "fraud_rate_pct"]
        result = M.evaluate(star, names, by=["month_name", "value_segment", "risk_tier"], filters={"is_weekend": [0, 1]})
        plan = result._jdf.queryExecution().optimizedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    fact_scans = [i for i, line in enumerate(plan) if "Relation" in line and "transaction_id" in line]
    assert fact_scans
    for at in fact_scans:
        above = [plan[j].strip(" :+-") for j in range(at - 1, -1, -1) if depth(plan[j]) < depth(plan[at])]
        nearest = next(op for op in above if not op.startswith(("Project", "Filter")))
        assert nearest.startswith("Aggregate"), nearest


def test_sketches_estimate_the_distinct_counts(spark):
    from txnrisk.sources.workspace import settled

    fact = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    import __spark_entry__ as entry

    star = entry.star_of(spark, "/root/testdata/sf0.01")
    sketches = settled(M.sketch_slice(star.fact))
    got = M.affected_from_sketches(sketches).first()
    bad = star.fact.where("is_fraud = 1")
    exact = (bad.select("terminal_id").distinct().count(), bad.select("customer_id").distinct().count())
    for estimate, count in zip((got["terminals_affected"], got["customers_affected"]), exact):
        assert abs(estimate - count) <= 0.047 * count + 1
    days = sorted(r[0] for r in star.date.select("date").collect())
    span = (str(days[3]), str(days[10]))
    part = M.affected_from_sketches(sketches, span).first()
    keys = star.date.where(F.col("date").between(*span)).select("date_key")
    inside = bad.join(keys, "date_key", "left_semi")
    assert abs(part["terminals_affected"] - inside.select("terminal_id").distinct().count()) <= 0.047 * inside.count() + 1
    assert fact.count() > 0 and sketches.count() <= 2 * star.date.count()
