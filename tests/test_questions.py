"""Business questions against plain Python over the same rows."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from txnrisk import schema as S
from txnrisk.operators import thresholds as X
from txnrisk.plans import customers, portfolio, terminals, trend, triage


@pytest.fixture(scope="module")
def rows(star):
    return [r.asDict() for r in star.fact.collect()]


def terminal_frame(spark, losses):
    made = [(i, 10, 1 if v else 0, 10.0, float(v), 3, S.RISK_TIERS[0]) for i, v in enumerate(losses)]
    return spark.createDataFrame(
        made,
        "terminal_id long, total_txns long, fraud_txns long, fraud_rate_pct double, fraud_volume double, "
        "unique_customers long, risk_tier string",
    )


def test_portfolio_totals(star, rows):
    got = portfolio.totals(star.fact).first()
    loss = sum(float(r["amount"]) for r in rows if r["is_fraud"])
    value = sum(float(r["amount"]) for r in rows)
    assert got["total_txns"] == len(rows)
    assert got["customers"] == len({r["customer_id"] for r in rows})
    assert got["fraud_value"] == pytest.approx(loss, abs=0.005)
    assert got["value_at_risk_pct"] == pytest.approx(100 * loss / value, abs=0.0005)


def test_totals_from_dimensions_equal_the_fact_scan(spark, star, clean_frame):
    from txnrisk.operators import dims
    from txnrisk.operators.features import build_fact

    assert portfolio.totals_from_dimensions(star.customer, star.terminal).collect() == portfolio.totals(star.fact).collect()
    fact = build_fact(clean_frame([(1, "2024-01-01 10:00:00", 1, 1, "5.10", 0), (2, "2024-01-02 10:00:00", 2, 1, "7.25", 0)]))
    quiet = (dims.build_dim_customer(fact), dims.build_dim_terminal(fact))
    assert portfolio.totals_from_dimensions(*quiet).collect() == portfolio.totals(fact).collect()


def test_no_fraud_leaves_the_fraud_value_null(clean_frame):
    one = clean_frame([(1, "2024-03-01 10:00:00", 1, 5, "10.00", 0)])
    got = portfolio.totals(one).first()
    assert (got["fraud_value"], got["value_at_risk_pct"], got["fraud_rate_pct"]) == (None, 0.0, 0.0)


def test_band_counts_sum_to_the_fact(star, rows):
    assert sum(r["txns"] for r in portfolio.band_lift(star.fact).collect()) == len(rows)
    top = portfolio.band_coverage(star.fact).collect()[-1]
    assert (top["cum_pct_of_loss"], top["cum_pct_of_txns"]) == (100.0, 100.0)


def test_tied_losses_share_a_rank(spark):
    got = terminals.worklist(terminal_frame(spark, [5, 9, 9, 0, 7]), limit=4).collect()
    assert [(r["terminal_id"], r["loss_rank"]) for r in got] == [(1, 1), (2, 1), (4, 3), (0, 4)]


def test_running_sum_is_taken_before_ranks_are_picked(spark):
    dim = terminal_frame(spark, [10, 20, 30, 40, 0])
    got = terminals.concentration(dim, ranks=(2, 4)).collect()
    assert [(r["terminals_reviewed"], r["cum_fraud_recovered"], r["cum_pct_of_loss"]) for r in got] == [
        (2, 70.0, 70.0), (4, 100.0, 100.0)]
    assert got[0]["pct_of_all_terminals"] == 40.0


def test_attack_window_counts_calendar_days(clean_frame):
    fact = clean_frame(
        [(1, "2024-03-01 23:00:00", 1, 5, "10.00", 2), (2, "2024-03-02 01:00:00", 1, 5, "11.00", 2),
         (3, "2024-03-09 01:00:00", 1, 5, "99.00", 1)]
    )
    got = terminals.attack_windows(fact).collect()
    assert len(got) == 1
    assert (got[0]["attack_window_days"], got[0]["fraud_value"], got[0]["loss_per_day"]) == (2, 21.0, 10.5)


def test_latency_equals_the_self_join(star, rows):
    first = {}
    for r in rows:
        if r["is_fraud"]:
            t = r["terminal_id"]
            first[t] = min(first.get(t, r["txn_datetime"]), r["txn_datetime"])
    seen = defaultdict(lambda: [0, 0.0])
    for r in rows:
        at = first.get(r["terminal_id"])
        if at is not None and r["txn_datetime"] < at:
            seen[r["terminal_id"]][0] += 1
            seen[r["terminal_id"]][1] += float(r["amount"])
    got = terminals.detection_latency(star.fact, star.terminal, limit=1000).collect()
    assert {r["terminal_id"]: r["clean_txns_before_first_fraud"] for r in got} == {k: v[0] for k, v in seen.items()}
    for r in got:
        assert r["clean_value_before"] == pytest.approx(seen[r["terminal_id"]][1], abs=0.005)


def test_a_terminal_that_starts_with_fraud_vanishes(clean_frame, spark):
    fact = clean_frame([(1, "2024-03-01 10:00:00", 1, 0, "10.00", 1), (2, "2024-03-01 11:00:00", 1, 0, "10.00", 0)])
    assert terminals.detection_latency(fact, terminal_frame(spark, [10])).count() == 0


def test_triage_score_matches_sorted_fifths(spark):
    made = [(i, "C - Mid Value", 10, float((i * 37) % 23), 1 + i % 3, float(i % 4)) for i in range(23)]
    dim = spark.createDataFrame(
        made + [(99, "D - Low Value", 5, 1.0, 0, 0.0)],
        "customer_id long, value_segment string, total_txns long, total_spend double, fraud_txns long, fraud_rate_pct double",
    )
    def fifths(key):
        order = sorted(made, key=key)
        sizes = [5, 5, 5, 4, 4]
        tiles = [t + 1 for t, s in enumerate(sizes) for _ in range(s)]
        return {r[0]: t for r, t in zip(order, tiles)}

    spend, rate = fifths(lambda r: (r[3], r[0])), fifths(lambda r: (r[5], r[0]))
    got = {r["customer_id"]: r["priority_score"] for r in customers.triage_list(dim, limit=100).collect()}
    assert got == {i: spend[i] + rate[i] for i in spend}


def test_layered_rules_fall_through_null_history(clean_frame):
    from txnrisk.operators.features import customer_history

    fact = customer_history(
        clean_frame(
            [
                (1, "2024-03-01 10:00:00", 1, 1, "220.00", 1),  # at the limit: first rule
                (2, "2024-03-01 10:00:00", 2, 1, "219.99", 0),  # no history: nothing
                (3, "2024-03-01 10:00:00", 3, 1, "10.00", 0),
                (4, "2024-03-02 10:00:00", 3, 1, "40.00", 1),  # four times the mean
                (5, "2024-03-02 10:00:00", 4, 1, "100.00", 0),
                (6, "2024-03-02 10:59:00", 4, 1, "100.00", 1),  # within the hour
            ]
        )
    )
    got = {r["rule_hit"]: r["txns_flagged"] for r in triage.layered_rules(fact).collect()}
    assert got == {S.RULE_LABELS[0]: 1, S.RULE_LABELS[1]: 1, S.RULE_LABELS[2]: 1, S.RULE_LABELS[3]: 3}


def test_weeks_of_two_years_can_be_kept_apart(clean_frame):
    from txnrisk.operators import dims
    from txnrisk.operators.features import time_features

    fact = time_features(
        clean_frame(
            [(1, "2018-01-03 10:00:00", 1, 1, "10.00", 1), (2, "2018-12-31 10:00:00", 1, 1, "10.00", 1),
             (3, "2019-01-08 10:00:00", 1, 1, "10.00", 0)]
        )
    )
    days = dims.build_dim_date(fact)
    assert [r["week_no"] for r in trend.weekly_movement(fact, days).collect()] == [1, 2]
    apart = trend.weekly_movement(fact, days, split_years=True).collect()
    assert [(r["iso_year"], r["week_no"], r["prev_week_fraud"]) for r in apart] == [(2018, 1, None), (2019, 1, 1), (2019, 2, 1)]
    assert apart[2]["wow_change_pct"] == -100.0


def test_alert_days_use_population_sigma(spark):
    losses = [100.0] * 30 + [400.0]
    made = [(i + 1, 20240101 + i, 1, l) for i, l in enumerate(losses)]
    fact = spark.createDataFrame(made, "transaction_id long, date_key int, is_fraud int, a double").withColumn(
        "amount", F.col("a").cast("decimal(12,2)")
    )
    got = trend.alert_days(fact).collect()
    mu = sum(losses) / 31
    sigma = (sum(x * x for x in losses) / 31 - mu * mu) ** 0.5
    assert len(got) == 1
    assert got[0]["alert_threshold"] == pytest.approx(mu + 2 * sigma, abs=0.005)
    assert got[0]["z_score"] == pytest.approx((400 - mu) / sigma, abs=0.005)


def test_moving_average_is_over_rows_not_days(spark):
    keys = [20240101, 20240102, 20240110, 20240111]
    made = [(k, int(i == 0), "10.00") for i, k in enumerate(keys)]
    fact = spark.createDataFrame(made, "date_key int, is_fraud int, a string").withColumn(
        "amount", F.col("a").cast("decimal(12,2)")
    )
    got = trend.daily_trend(fact, window=2).collect()
    assert [r["fraud_rate_7d_ma"] for r in got] == [100.0, 50.0, 0.0, 0.0]


def test_sweep_equals_the_naive_loop(star, rows):
    got = {r["threshold"]: r for r in X.threshold_sweep(star.fact).collect()}
    assert sorted(got) == list(range(20, 601, 10))
    for t, r in got.items():
        flagged = [x for x in rows if float(x["amount"]) >= t]
        caught = [x for x in flagged if x["is_fraud"]]
        assert (r["txns_flagged"], r["frauds_caught"]) == (len(flagged), len(caught))
        saved = sum(float(x["amount"]) for x in caught)
        assert r["loss_prevented"] == pytest.approx(0.75 * saved, abs=0.006)
    flags = [got[t]["txns_flagged"] for t in sorted(got)]
    assert flags == sorted(flags, reverse=True)


def test_simulation_agrees_with_the_sweep(star):
    sweep = {r["threshold"]: r for r in X.threshold_sweep(star.fact).collect()}
    for r in X.review_simulation(star.fact).collect():
        if r["review_above"] in sweep:
            s = sweep[r["review_above"]]
            assert r["txns_for_review"] == s["txns_flagged"]
            assert r["loss_prevented"] * 0.75 == pytest.approx(s["loss_prevented"], abs=0.01)


def test_thresholds_nothing_reaches_are_kept(clean_frame):
    fact = clean_frame([(1, "2024-03-01 10:00:00", 1, 1, "25.00", 1), (2, "2024-03-01 10:00:00", 1, 1, "20.00", 0)])
    got = {r["threshold"]: r for r in X.threshold_sweep(fact).collect()}
    assert (got[20]["txns_flagged"], got[30]["txns_flagged"], got[600]["precision_pct"]) == (2, 0, 0.0)
    assert got[600]["residual_loss"] == 25.0


def test_lowest_threshold_wins_a_tie(spark):
    sweep = spark.createDataFrame([(20, 1.0), (30, 5.0), (40, 5.0), (100, -2.0)], "threshold int, net_benefit double")
    got = X.optimum(sweep).first()
    assert (got["optimal_threshold"], got["net_benefit"], got["improvement_vs_naive"]) == (30, 5.0, 7.0)


@pytest.mark.parametrize("optima, stable", [((180, 220), True), ((180, 230), False)])
def test_stability_limit(spark, optima, stable):
    got = X.stability(spark.createDataFrame([(o,) for o in optima], "optimal_threshold int")).first()
    assert (got["distinct_optima"], got["stable"]) == (2, stable)


@pytest.mark.parametrize("chosen, verdict", [(200, "matches"), (206, "matches"), (180, "sits below"), (215, "sits above")])
def test_verdict_tolerance(spark, chosen, verdict):
    live = spark.createDataFrame([(190, 1.0), (200, 9.0), (210, 2.0)], "threshold int, net_live double")
    got = X.chosen_setting(live, chosen).first()
    assert (got["optimum"], got["verdict"]) == (200, verdict)


def test_headline_formats(star):
    got = {r["metric"]: r["value"] for r in portfolio.headline(star.fact, star.terminal, star.customer).collect()}
    assert list(got) == list(S.HEADLINE_METRICS) and got["Total transactions"] == "900"
