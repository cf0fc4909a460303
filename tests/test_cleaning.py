import datetime as dt

import pytest
from pyspark.sql import functions as F

from txnrisk import schema as S
from txnrisk.operators import dims, features, quality

T0 = dt.datetime(2024, 3, 1, 10, 0)
TEXT = (
    "TRANSACTION_ID string, TX_DATETIME timestamp_ntz, CUSTOMER_ID string, TERMINAL_ID string, "
    "TX_AMOUNT double, TX_FRAUD int, TX_FRAUD_SCENARIO int, NOTE string"
)


def raw_row(i, at=T0, amount=10.0, customer="1"):
    return (i, at, customer, "7", amount, 0, 0, "x")


def test_rename_drops_other_columns(spark):
    raw = spark.createDataFrame([raw_row("1")], TEXT)
    assert quality.rename_and_prune(raw).columns == quality.CLEAN_COLUMNS


def test_text_ids_are_converted_and_amounts_rounded(spark):
    raw = spark.createDataFrame([raw_row("12", amount=10.126)], TEXT)
    row = quality.typed(quality.rename_and_prune(raw)).first()
    assert (row["transaction_id"], row["terminal_id"], str(row["amount"])) == (12, 7, "10.13")


@pytest.mark.parametrize("bad", ["abc", None])
def test_a_bad_id_fails_the_job(spark, bad):
    raw = spark.createDataFrame([raw_row("1"), raw_row(bad)], TEXT)
    with pytest.raises(Exception, match="bad transaction_id"):
        quality.typed(quality.rename_and_prune(raw)).collect()


def test_quarantine_keeps_both_sides(spark):
    raw = spark.createDataFrame([raw_row("1"), raw_row("abc"), raw_row("2", amount=None)], TEXT)
    good, bad = quality.typed_with_quarantine(quality.rename_and_prune(raw))
    assert sorted(r[0] for r in good.collect()) == [1, 2]
    assert [r[0] for r in bad.collect()] == ["abc"]


def test_audit_counts_before_cleaning(spark):
    rows = [raw_row("1"), raw_row("1"), raw_row("1"), raw_row("2", at=None), raw_row("3", amount=0.0), raw_row("4", amount=-2.0)]
    typed = quality.typed(quality.rename_and_prune(spark.createDataFrame(rows, TEXT)))
    assert quality.audit(typed).first().asDict() == {
        "duplicate_txn_ids": 2, "null_rows": 1, "zero_amount_txns": 2, "negative_amounts": 1,
    }
    kept = quality.positive_amounts(quality.keep_first(typed)).collect()
    assert [r["transaction_id"] for r in kept] == [1]


def test_first_file_wins(spark):
    rows = [raw_row("1", amount=5.0) + ("day2",), raw_row("1", amount=9.0) + ("day1",)]
    raw = spark.createDataFrame(rows, TEXT + f", {quality.SOURCE_FILE} string")
    kept = quality.keep_first(quality.typed(quality.rename_and_prune(raw))).collect()
    assert [float(r["amount"]) for r in kept] == [9.0]


def test_a_null_first_copy_drops_the_id(spark):
    rows = [raw_row("1", amount=None) + ("day1",), raw_row("1", amount=9.0) + ("day2",)]
    raw = spark.createDataFrame(rows, TEXT + f", {quality.SOURCE_FILE} string")
    assert quality.keep_first(quality.typed(quality.rename_and_prune(raw))).count() == 0


def test_duplicates_shrink_before_the_shuffle(spark):
    raw = spark.createDataFrame([raw_row("1")], TEXT)
    kept = quality.keep_first(quality.typed(quality.rename_and_prune(raw)))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


HISTORY = [
    (1, "2024-03-01 10:00:00", 1, 5, "10.00", 0),
    (2, "2024-03-01 10:00:00", 1, 5, "20.00", 0),  # same instant, id breaks the tie
    (3, "2024-03-01 11:30:00", 1, 6, "40.00", 1),
    (4, "2024-03-02 00:00:00", 2, 5, "7.50", 0),
]


def test_customer_history(clean_frame):
    rows = features.customer_history(clean_frame(HISTORY)).orderBy("transaction_id").collect()
    assert [r["cust_txn_seq"] for r in rows] == [1, 2, 3, 1]
    assert [r["mins_since_prev_txn"] for r in rows] == [None, 0.0, 90.0, None]
    assert [r["cust_avg_amount_todate"] for r in rows] == [None, 10.0, 15.0, None]
    assert [r["amount_vs_cust_avg"] for r in rows] == [None, 2.0, 2.67, None]


def test_mean_never_reads_the_current_row(clean_frame):
    changed = [r if r[0] != 3 else r[:4] + ("4000.00", 1) for r in HISTORY]
    pick = lambda rows: {
        r["transaction_id"]: r["cust_avg_amount_todate"]
        for r in features.customer_history(clean_frame(rows)).collect()
    }
    assert pick(HISTORY) == pick(changed)


def test_terminal_sequence_walks_customers_first(clean_frame):
    rows = HISTORY + [(5, "2024-03-01 09:00:00", 2, 5, "1.00", 0)]
    seq = lambda order: {
        r["transaction_id"]: r["terminal_txn_seq"]
        for r in features.terminal_sequence(clean_frame(rows), order).collect()
    }
    assert seq("customer") == {1: 1, 2: 2, 5: 3, 4: 4, 3: 1}
    assert seq("time") == {5: 1, 1: 2, 2: 3, 4: 4, 3: 1}


def test_fact_is_the_same_however_keys_are_split(spark, many):
    plain = features.build_fact(many)
    assert plain.columns == S.FACT.fieldNames()
    whole = sorted(map(str, plain.collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(str, features.build_fact(many.repartition(5)).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_date_dimension(spark):
    keys = spark.createDataFrame([(20180401,), (20180401,), (20181231,)], "date_key int")
    rows = {r["date_key"]: r for r in dims.build_dim_date(keys).collect()}
    assert len(rows) == 2
    first, last = rows[20180401], rows[20181231]
    assert (first["week_no"], first["day_of_week"], first["is_weekend"]) == (13, 7, "Weekend")
    assert (first["month_name"], first["day_name"]) == ("Apr 2018", "Sunday")
    assert (last["week_no"], last["day_of_week"]) == (1, 1)  # ISO week 1 in December


def test_active_days_are_elapsed_days(clean_frame):
    rows = clean_frame(
        [
            (1, "2024-03-01 23:00:00", 1, 5, "10.00", 0),
            (2, "2024-03-02 01:00:00", 1, 5, "10.00", 0),  # next calendar day, two hours later
            (3, "2024-03-01 01:00:00", 2, 5, "10.00", 0),
            (4, "2024-03-02 01:00:00", 2, 5, "30.00", 2),
        ]
    )
    got = {r["customer_id"]: r for r in dims.customer_totals(rows).collect()}
    assert (got[1]["active_days"], got[2]["active_days"]) == (1, 2)
    assert (got[2]["total_spend"], got[2]["fraud_rate_pct"], got[2]["max_txn_amount"]) == (40.0, 50.0, 30.0)


def customers(spark, spends):
    return spark.createDataFrame(list(enumerate(spends)), "customer_id long, total_spend double")


def test_segments_are_right_closed_quartiles(spark):
    got = dims.spend_segments(customers(spark, [1.0, 2.0, 3.0, 4.0, 5.0])).collect()
    by_spend = {r["total_spend"]: r["value_segment"][0] for r in got}
    assert by_spend == {1.0: "D", 2.0: "D", 3.0: "C", 4.0: "B", 5.0: "A"}


def test_repeated_edges_are_an_error(spark):
    with pytest.raises(Exception, match="not distinct"):
        dims.spend_segments(customers(spark, [1.0, 1.0, 1.0, 1.0, 9.0])).collect()


def test_approximate_segments_agree_on_small_data(spark):
    data = customers(spark, [float(x) for x in range(1, 102)])
    exact = dims.spend_segments(data).collect()
    rough = dims.spend_segments(data, approximate=True).collect()
    assert sorted(map(str, exact)) == sorted(map(str, rough))


def test_dimension_totals_equal_the_fact(star):
    fact = star.fact.agg(F.count("*"), F.sum("amount").cast("double"), F.sum("is_fraud")).first()
    for dim, value in ((star.customer, "total_spend"), (star.terminal, "total_volume")):
        sums = dim.agg(F.sum("total_txns"), F.sum(value), F.sum("fraud_txns")).first()
        assert (sums[0], sums[2]) == (fact[0], fact[2])
        assert sums[1] == pytest.approx(fact[1], abs=1e-6)
    bands = star.band.agg(F.sum("txns"), F.sum("fraud_txns")).first()
    assert tuple(bands) == (fact[0], fact[2])


def test_constraints(star):
    report = quality.constraint_report(star.tables()).collect()
    assert {r["violations"] for r in report} == {0}
    broken = star.tables() | {"dim_customer": star.customer.where("customer_id <> 1")}
    broken["fact_transactions"] = star.fact.unionByName(star.fact.where("transaction_id < 4"))
    bad = {(r["rule"], r["column_name"]): r["violations"] for r in quality.constraint_report(broken).collect() if r["violations"]}
    assert bad == {("unique", "transaction_id"): 3, ("reference", "customer_id"): 1}
